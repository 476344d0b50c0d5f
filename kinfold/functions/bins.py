"""Partition bins of the stored study layout."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions import codes

INTEGER_BIN_STRIDE = 10_000
INTEGER_OTHER_BIN = 10_000_000
#: Rows longer than a bin are apart from the others, so that those reach into the next bin at most.
LONG = "long"


@dataclass(frozen=True)
class Partitioning:
    """How a study is cut into directories; unset parts are not used."""

    region_length: int = 0
    chromosomes: tuple[str, ...] = ()
    integer_region_bins: bool = False
    rare_boundary: float = 0.0
    coding_effects: tuple[str, ...] = ()
    family_bins: int = 0
    chromosome_lengths: dict = field(default_factory=dict)

    @property
    def summary_columns(self) -> list[str]:
        return [
            name for name, used in (
                ("region_bin", self.region_length > 0), ("frequency_bin", self.rare_boundary > 0),
                ("coding_bin", bool(self.coding_effects))) if used]

    @property
    def family_columns(self) -> list[str]:
        return self.summary_columns + (["family_bin"] if self.family_bins > 0 else [])

    def bin_name(self, chrom: str, index: int) -> str:
        if self.integer_region_bins:
            if chrom in self.chromosomes:
                return str(self.chromosomes.index(chrom) * INTEGER_BIN_STRIDE + index)
            return str(INTEGER_OTHER_BIN + index)
        return f"{chrom if chrom in self.chromosomes else 'other'}_{index}"

    def long_bin_name(self, chrom: str) -> str:
        """The bin of a chromosome's rows that are longer than a bin."""
        if self.integer_region_bins:
            if chrom in self.chromosomes:
                return str(self.chromosomes.index(chrom) * INTEGER_BIN_STRIDE + INTEGER_BIN_STRIDE - 1)
            return str(INTEGER_OTHER_BIN - 1)
        return f"{chrom if chrom in self.chromosomes else 'other'}_{LONG}"

    def region_bins_of(self, chrom: str, start: int | None, stop: int | None) -> list[str]:
        """Bins of the positions of a region."""
        first = max(start or 1, 1)
        last = stop or self.chromosome_lengths.get(chrom) or first
        if chrom in self.chromosome_lengths:
            last = min(last, self.chromosome_lengths[chrom])
        return [
            self.bin_name(chrom, i)
            for i in range((first - 1) // self.region_length, (last - 1) // self.region_length + 1)]

    def all_region_bins(self) -> list[str]:
        """Every bin of the genome; unlisted chromosomes share the ``other`` bins."""
        listed = [c for c in self.chromosome_lengths if c in self.chromosomes]
        others = [n for c, n in self.chromosome_lengths.items() if c not in self.chromosomes]
        names = [name for c in listed for name in self.region_bins_of(c, 1, self.chromosome_lengths[c])]
        if others:
            names += [
                self.bin_name("", i) for i in range((max(others) - 1) // self.region_length + 1)]
        return names


def region_bin(chrom: Column, pos: Column, partitioning: Partitioning) -> Column:
    """Directory name of a position: ``chrom_index``, ``other_index`` or the integer form."""
    index = F.floor((pos - 1) / partitioning.region_length).cast("int")
    listed = chrom.isin(list(partitioning.chromosomes))
    if partitioning.integer_region_bins:
        order = F.array_position(F.array(*[F.lit(c) for c in partitioning.chromosomes]), chrom) - 1
        return F.when(listed, order * INTEGER_BIN_STRIDE + index).otherwise(
            INTEGER_OTHER_BIN + index).cast("string")
    return F.concat(F.when(listed, chrom).otherwise(F.lit("other")), F.lit("_"), index.cast("string"))


def row_region_bin(chrom: Column, pos: Column, end: Column, partitioning: Partitioning) -> Column:
    """Directory name of a row: the bin of its start, or its chromosome's bin of long rows."""
    listed = F.when(F.lit(False), F.lit(""))
    for name in partitioning.chromosomes:
        listed = listed.when(chrom == name, partitioning.long_bin_name(name))
    return F.when(
        F.coalesce(end, pos) - pos >= partitioning.region_length, listed.otherwise(partitioning.long_bin_name(""))
    ).otherwise(region_bin(chrom, pos, partitioning))


def region_bins(chrom: Column, start: Column, stop: Column, partitioning: Partitioning) -> Column:
    """Array of the bins between two positions."""
    length = partitioning.region_length
    indexes = F.sequence(F.floor((start - 1) / length), F.floor((stop - 1) / length))
    return F.transform(
        indexes, lambda i: region_bin(chrom, i * length + 1, partitioning))


def frequency_bin(count: Column, freq: Column, denovo: Column, rare_boundary: float) -> Column:
    """0 de novo, 1 ultra rare, 2 rare, 3 common; missing counts are ultra rare."""
    return (
        F.when(denovo, 0)
        .when(F.coalesce(count, F.lit(0)) <= 1, 1)
        .when(F.coalesce(freq, F.lit(0.0)) <= rare_boundary, 2)
        .otherwise(3))


def coding_bin(effect_gene: Column, allele_index: Column, coding_effects: tuple[str, ...]) -> Column:
    """1 when an alternative allele has any coding effect."""
    coding = F.exists(effect_gene, lambda g: g["effect_types"].isin(list(coding_effects)))
    return F.when((allele_index > 0) & F.coalesce(coding, F.lit(False)), 1).otherwise(0)


def family_bin(family_id: Column, bins: int) -> Column:
    """SHA-256 of the family id modulo the number of bins, folded 32 bits at a time."""
    digest = F.sha2(family_id.cast("string"), 256)
    chunk = lambda i: F.conv(F.substring(digest, i * 8 + 1, 8), 16, 10).cast("long")
    folded = F.lit(0).cast("long")
    for i in range(8):
        folded = (folded * F.lit(4294967296) + chunk(i)) % bins
    return folded.cast("int")


def family_bin_of(family_id: str, bins: int) -> int:
    """``family_bin`` for one literal id."""
    import hashlib
    return int(hashlib.sha256(family_id.encode()).hexdigest(), 16) % bins


def coding_effects(groups: list[str]) -> tuple[str, ...]:
    return tuple(codes.expand_effects(groups))
