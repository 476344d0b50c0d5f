"""Registered queries against their SQL on the smallest tables.

A selection runs by default; set ``ALL_QUERIES=1`` for every one.
"""

import os

import duckdb
import pytest

import checks.queries  # noqa: F401
from checks import compare
from checks.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SELECTION = [
    "denovo_by_gene_and_status", "p04_genes_and_effects_same_pair", "p17_expression_forms", "p24_person_set_of_two_fields",
    "x11_member_inheritance", "x15_zygosity_masks", "j12_region_table_overlap", "a01_allele_frequencies", "a11_denovo_report",
    "d03_one_event_per_family", "d17_denovo_gene_set_cache", "d20_gene_profile_counts", "d29_family_tags", "d30_inferred_roles",
    "a20_measure_report", "d12_association", "s03_vcf_sample_calls", "w02_merged_intervals",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ALL_QUERIES") else SELECTION)
def test_query_equals_sql(spark, con, name):
    ok, note = compare.run(spark, con, SF, name, allow_empty=True)
    assert ok, note


def test_entry_points():
    import __spark_entry__
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries()) and len(ORACLES) > 200
