"""From files to a queryable study."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.bins import Partitioning
from kinfold.operators import pedigree, variants
from kinfold.plans.study import Study
from kinfold.session import written

NO_EFFECT = "array(named_struct('effect_gene_symbols', CAST(NULL AS STRING), 'effect_types', CAST(NULL AS STRING)))"


def build_study(
    sites: DataFrame, calls: DataFrame, ped: DataFrame, partitioning: Partitioning = Partitioning(),
    annotations: DataFrame | None = None, frequencies: bool = True,
    include_reference: bool = False, scratch: str | None = None, absent_are_reference: bool = False, **modes,
) -> Study:
    """Alleles, frequencies, counters and annotations of called family genotypes.

    ``annotations`` is keyed by ``chromosome, position, reference, alternative`` and should bring
    ``effect_gene``; alleles without effects get one pair of missing values. ``frequencies`` is
    switched off for de-novo sources, whose frequency columns stay missing; they count families
    without a row as reference with ``absent_are_reference``, as calls filled with reference need.
    Other keywords go to ``variants.family_alleles``.

    Sites and calls feed several tables. With ``scratch``, a new path in the shared folder (see
    ``session.scratch_dir``), both are written there first, so files are parsed once.
    """
    if scratch is not None:
        sites, calls = written(sites, f"{scratch}/sites"), written(calls, f"{scratch}/calls")
    fa = variants.family_alleles(calls, include_reference=include_reference, **modes)
    sa = variants.summary_alleles(sites, include_reference)
    if annotations is not None:
        sa = variants.annotate(sa, annotations)
    if "effect_gene" not in sa.columns:
        sa = sa.withColumn("effect_gene", F.expr(NO_EFFECT))
    else:
        sa = sa.withColumn("effect_gene", F.coalesce("effect_gene", F.expr(NO_EFFECT)))
    if frequencies:
        founders = pedigree.with_parent_flags(ped).filter("is_founder").agg(F.count("*").alias("founders"))
        sa = variants.with_frequency(sa, variants.allele_frequencies(calls, founders, absent_are_reference))
    else:
        for name, kind in (
                ("af_parents_called_count", "bigint"), ("af_parents_called_percent", "double"),
                ("af_allele_count", "bigint"), ("af_allele_freq", "double")):
            sa = sa.withColumn(name, F.lit(None).cast(kind))
    return Study(ped, variants.stored_summary(sa, fa), fa, partitioning)
