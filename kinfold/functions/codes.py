"""Numeric codes of the data model and the lookups that decode them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: enum codes -------------------------------------------------------------
ROLES = {
    "maternal_grandmother": 1 << 0,
    "maternal_grandfather": 1 << 1,
    "paternal_grandmother": 1 << 2,
    "paternal_grandfather": 1 << 3,
    "mom": 1 << 4,
    "dad": 1 << 5,
    "parent": 1 << 6,
    "prb": 1 << 7,
    "sib": 1 << 8,
    "child": 1 << 9,
    "maternal_half_sibling": 1 << 10,
    "paternal_half_sibling": 1 << 11,
    "half_sibling": 1 << 12,
    "maternal_aunt": 1 << 16,
    "maternal_uncle": 1 << 17,
    "paternal_aunt": 1 << 18,
    "paternal_uncle": 1 << 19,
    "maternal_cousin": 1 << 20,
    "paternal_cousin": 1 << 21,
    "step_mom": 1 << 22,
    "step_dad": 1 << 23,
    "spouse": 1 << 24,
    "unknown": 1 << 25,
}
ROLE_SYNONYMS = {
    "maternal grandmother": "maternal_grandmother",
    "maternal grandfather": "maternal_grandfather",
    "paternal grandmother": "paternal_grandmother",
    "paternal grandfather": "paternal_grandfather",
    "mother": "mom",
    "father": "dad",
    "proband": "prb",
    "initially identified proband": "prb",
    "sibling": "sib",
    "younger sibling": "sib",
    "older sibling": "sib",
    "maternal half sibling": "maternal_half_sibling",
    "paternal half sibling": "paternal_half_sibling",
    "maternal aunt": "maternal_aunt",
    "maternal uncle": "maternal_uncle",
    "paternal aunt": "paternal_aunt",
    "paternal uncle": "paternal_uncle",
    "maternal cousin": "maternal_cousin",
    "paternal cousin": "paternal_cousin",
    "step mom": "step_mom",
    "step dad": "step_dad",
    "step mother": "step_mom",
    "step father": "step_dad",
}
SEXES = {"M": 1, "F": 2, "U": 4}
SEX_ALIASES = {"male": 1, "female": 2, "unspecified": 4}
SEX_WORDS = {
    "male": 1, "m": 1, "1": 1,
    "female": 2, "f": 2, "2": 2,
    "unspecified": 4, "u": 4, "0": 4, "unknown": 4,
}
STATUSES = {"unaffected": 1, "affected": 2, "unspecified": 4}
STATUS_WORDS = {
    "unaffected": 1, "1": 1, "false": 1,
    "affected": 2, "2": 2, "true": 2,
    "unspecified": 4, "-": 4, "0": 4, "unknown": 4,
}
INHERITANCE = {
    "reference": 1 << 0,
    "mendelian": 1 << 1,
    "denovo": 1 << 2,
    "possible_denovo": 1 << 3,
    "omission": 1 << 4,
    "possible_omission": 1 << 5,
    "other": 1 << 6,
    "missing": 1 << 7,
    "unknown": 1 << 8,
}
ZYGOSITY = {"homozygous": 1, "heterozygous": 2}
ALLELE_TYPES = {
    "position": 0,
    "substitution": 1 << 0,
    "small_insertion": 1 << 1,
    "small_deletion": 1 << 2,
    "complex": 1 << 3,
    "indel": (1 << 1) | (1 << 2) | (1 << 3),
    "large_deletion": 1 << 4,
    "large_duplication": 1 << 5,
    "cnv": (1 << 4) | (1 << 5),
    "tandem_repeat": 1 << 6,
    "tandem_repeat_ins": (1 << 6) | (1 << 1),
    "tandem_repeat_del": (1 << 6) | (1 << 2),
}
ALLELE_TYPE_ALIASES = {
    "sub": 1 << 0,
    "ins": 1 << 1,
    "del": 1 << 2,
    "comp": 1 << 3,
    "cnv+": 1 << 5,
    "cnv-": 1 << 4,
}
ALLELE_TYPE_WORDS = {
    "sub": 1, "substitution": 1,
    "ins": 2, "insertion": 2,
    "del": 4, "deletion": 4,
    "comp": 8, "complex": 8,
    "cnv_p": 32, "cnv+": 32, "large_duplication": 32,
    "cnv_m": 16, "cnv-": 16, "large_deletion": 16,
    "tr": 64, "tandem_repeat": 64,
}
GENETIC_MODELS = {
    "autosomal": 1, "autosomal_broken": 2, "pseudo_autosomal": 3, "X": 4, "X_broken": 5,
}
TRANSMISSION = {"unknown": 0, "transmitted": 1, "denovo": 2}

# ---- fixed values: effect types and their groups ------------------------------------------
EFFECT_GROUPS = {
    "lgds": ["frame-shift", "nonsense", "splice-site", "no-frame-shift-newStop"],
    "coding": [
        "nonsense", "frame-shift", "splice-site", "no-frame-shift-newStop", "missense",
        "no-frame-shift", "noStart", "noEnd", "synonymous",
    ],
    "nonsynonymous": [
        "nonsense", "frame-shift", "splice-site", "no-frame-shift-newStop", "missense",
        "no-frame-shift", "noStart", "noEnd",
    ],
    "noncoding": ["non-coding", "intron", "intergenic", "3'UTR", "5'UTR"],
    "utrs": ["3'UTR", "5'UTR"],
    "cnv": ["CNV+", "CNV-"],
    "all": [
        "3'UTR", "3'UTR-intron", "5'UTR", "5'UTR-intron", "frame-shift", "intergenic", "intron",
        "missense", "no-frame-shift", "no-frame-shift-newStop", "noEnd", "noStart", "non-coding",
        "non-coding-intron", "nonsense", "splice-site", "synonymous", "CDS", "CNV+", "CNV-",
    ],
}
# most to least severe, used for the "worst effect" columns
EFFECT_SEVERITY = [
    "CNV+", "CNV-", "splice-site", "frame-shift", "nonsense", "no-frame-shift-newStop",
    "noStart", "noEnd", "missense", "no-frame-shift", "CDS", "synonymous", "non-coding",
    "intron", "non-coding-intron", "5'UTR-intron", "3'UTR-intron", "5'UTR", "3'UTR", "intergenic",
]
# ---- fixed values: genotype codes ---------------------------------------------------------
UNKNOWN_CALL = -1
HAPLOID_FILLER = -2
SEX_CHROMOSOMES = ["chrX", "X", "chrY", "Y"]
X_CHROMOSOMES = ["chrX", "X"]
TRUE_WORDS = ["true", "1", "yes", "y", "t", "1.0"]


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, for expressions that repeat a costly part."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bit_offset(flag: int) -> int:
    """Position of the single bit set in ``flag``."""
    return flag.bit_length() - 1


def zygosity_mask(flag: int, zygosity: int) -> int:
    """Zygosity bits of one role, sex or status inside a packed zygosity column."""
    return zygosity << (2 * bit_offset(flag))


def expand_effects(effects: str | list[str]) -> list[str]:
    """Effect groups replaced by their members; names of groups and types ignore case."""
    names = [effects] if isinstance(effects, str) else list(effects)
    types = {effect.lower(): effect for effect in EFFECT_GROUPS["all"]}
    expanded: dict[str, None] = {}
    for name in names:
        known = types.get(name.lower(), name)
        for effect in EFFECT_GROUPS.get(name.lower(), [known]):
            expanded[effect] = None
    return list(expanded)


def lookup(words: dict[str, int], column: Column, default: int | None) -> Column:
    """Case-insensitive word to code translation."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(column))), F.lit(default)).cast("int")


def decode(codes: dict[str, int], column: Column, default: str | None = None) -> Column:
    """Code to name translation; the first name of a code wins."""
    names: dict[int, str] = {}
    for name, code in codes.items():
        names.setdefault(code, name)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column.cast("int")), F.lit(default))


def role_code(column: Column) -> Column:
    """Role names, synonyms or numeric codes to the role flag; anything else is ``unknown``."""
    words = dict(ROLES)
    words.update({word: ROLES[name] for word, name in ROLE_SYNONYMS.items()})
    numeric = column.try_cast("int")
    by_number = F.when(numeric == 0, ROLES["unknown"]).when(
        numeric.isin(list(ROLES.values())), numeric)
    return F.coalesce(by_number, lookup(words, column, ROLES["unknown"]))


def sex_code(column: Column) -> Column:
    """Sex words or numbers to the sex flag; NULL is unspecified, other words are NULL."""
    return F.when(column.isNull(), F.lit(4)).otherwise(lookup(SEX_WORDS, column, None))


def status_code(column: Column) -> Column:
    """Status words or numbers to the status flag; NULL is unspecified, other words are NULL."""
    return F.when(column.isNull(), F.lit(4)).otherwise(lookup(STATUS_WORDS, column, None))


def external(column: Column) -> Column:
    """Stored form of sex and status flags: unspecified is 0 on disk."""
    return F.when(column == 4, F.lit(0)).otherwise(column)


def internal(column: Column) -> Column:
    """In-memory form of stored sex and status flags: 0 on disk is unspecified."""
    return F.when(column == 0, F.lit(4)).otherwise(column)


def boolean_word(column: Column) -> Column:
    """Text flags to BOOLEAN; NULL is false."""
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin(TRUE_WORDS), F.lit(False))
