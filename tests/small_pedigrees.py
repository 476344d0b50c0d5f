"""Small pedigrees that several test files share."""


def ped_rows(spark, text):
    """Pedigree from lines ``family person mom dad sex status role``; 0 is no parent."""
    from kinfold.functions import codes
    rows = []
    for i, line in enumerate(t for t in text.strip().splitlines()):
        family, person, mom, dad, sex, status, role = line.split()
        rows.append((
            family, person, None if mom == "0" else mom, None if dad == "0" else dad, codes.SEXES[sex],
            codes.STATUSES[status], codes.ROLES.get(role), person, False, False, i))
    return spark.createDataFrame(rows, (
        "family_id string, person_id string, mom_id string, dad_id string, sex int, status int, role int, "
        "sample_id string, generated boolean, not_sequenced boolean, member_index int"))


QUAD = """
f1 mom1 0 0 F unaffected mom
f1 dad1 0 0 M unaffected dad
f1 prb1 mom1 dad1 F affected prb
f1 sib1 mom1 dad1 M unaffected sib
"""
TWO_QUADS = QUAD + """f2 mom2 0 0 F unaffected mom
f2 dad2 0 0 M unaffected dad
f2 prb2 mom2 dad2 M affected prb
f2 sib2 mom2 dad2 F affected sib
"""
