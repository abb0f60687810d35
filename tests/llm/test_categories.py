import pytest

from tallyloom.llm import categories as C

NAMES = [(1, "gases - argon"), (2, "gases - helium"), (3, "hand tools"), (4, "chromatography - solvent filter"), (5, "instrument part - rotor lid"), (6, "x-ray film"), (7, "lab furniture - stool"), (8, "electronics - thermocouple"), (9, "instrument - centrifuge"), (10, "microscopy - coverslips"), (11, "secondary antibody - goat host"), (12, "secondary antibody - donkey host")]


@pytest.mark.parametrize(
    ("typed", "want"),
    [("Gases - Argon", 1), ("argon, gases", 1), ("gasesargon", 1), ("gaes - srgon", 1), ("new: gases - helium for rm 214", 2), ("HAND TOOLS", 3), ("hand otols", 3), ("chrom - solvnt fltr", 4), ("inst. part (rotor lids)", 5), ("film, x-ray", 6), ("labfurniture stool", 7), ("elec - the", 8), ("microscopy - cover glasses", 10), ("scndry antbdy - dnky host", 12), ("secondary_antibody_-_goat_hosts", 11), ("instrument - telescope", 0), ("gases - propane for grill", 0), ("parade float", 0), ("12345", 0), ("lab", 0), ("gases", 0)],
)
def test_matches(typed, want):
    assert C.evaluate([typed], tuple(NAMES))[typed][0] == want


def test_table_cases(spark):
    cats = spark.createDataFrame(NAMES, "category_id long, category string")
    rows = [(1, "gases - argon"), (2, None), (3, ""), (4, " -- "), (5, "argon gases"), (5, "argon gases"), (6, "nothing of it"), (7, "word " * 30_000), (8, "gases - helium " + "x" * 100_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "entry_id long, category string, how string")
    got = sorted((r.entry_id, r.category_id, r.how) for r in C.map_values(df, cats).collect())
    assert got[:7] == sorted([(1, 1, "exact"), (2, None, "blank"), (3, None, "blank"), (4, None, "blank"), (5, 1, "mention"), (5, 1, "mention"), (6, 0, "none")])
    assert [g[:2] for g in got[7:]] == [(7, 0), (8, 2)]
    assert {(r.category, r.n) for r in C.unmatched(C.map_values(df, cats)).collect() if len(r.category) < 50} == {("nothing of it", 1)}
    assert C.map_values(df.limit(0), cats).count() == 0
    assert {r.category_id for r in C.map_values(df.filter("entry_id = 1"), cats.limit(0)).collect()} == {0}


def test_edit_distance_counts_transpositions():
    assert C.edits("argon", "agron", 2) == 1 and C.edits("abc", "abc", 1) == 0 and C.edits("abc", "xyz", 1) == 2


def test_only_entries_are_named(spark):
    from tallyloom.llm.queries_categories import p1_found

    d = "/root/testdata/sf0.001"
    got = p1_found(spark, d).collect()
    ids = {r.category_id for r in spark.read.parquet(f"{d}/categories.parquet").collect()} | {0}
    assert got and {r.category_id for r in got} <= ids


def test_prefix_index_misses_nothing():
    import random

    from tallyloom.llm.spelling import Near, edits

    random.seed(12)
    words = ["".join(random.choice("abc") for _ in range(random.randint(1, 12))) for _ in range(300)]
    near = Near(words, 3, prefix=7)
    for w in words[:60]:
        assert near.find(w) == sorted((edits(w, v, 3), v) for v in set(words) if edits(w, v, 3) <= 3)


def test_synonyms_are_a_parameter(spark):
    cats = spark.createDataFrame(NAMES, "category_id long, category string")
    df = spark.createDataFrame([(1, "implements for the hand")], "entry_id long, category string")
    assert C.map_values(df, cats).first().category_id == 0
    assert C.map_values(df, cats, synonyms=[("hand tools", "implements for the hand")]).first().category_id == 3
