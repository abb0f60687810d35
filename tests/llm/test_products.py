import pytest

from tallyloom.llm import products as P

KINDS = P.same_kinds({"stir bar": "stir bars", "stirring bar": "stir bars", "bar for stirring": "stir bars", "zelanine dye": "dyes", "dye zelanine": "dyes", "sample jar": "boxes", "specimen jar": "boxes"})
READER = P.Reader(("stirring", "zelanine", "sample", "specimen"), ("velquor", "orvantis"), tuple(sorted(KINDS.items())))


def key(text):
    g = READER.read(text)
    return tuple(g.get(a) for a in P.ATTRIBUTES)


@pytest.mark.parametrize(
    "texts",
    [
        ("stir bar; 0.2 meter; pack of 24; s/s; curved; velquor model k", "BY VELQUOR SERIES K - 24 CT - BENT TIP - STAINLESS STEEL - 20-cm. - TOP QUALITY - BAR FOR STIRRING - cat 12345", "stirrng bar inox steel 200mm curved shape 2 dozen velqour brand mdl.k limited stock"),
        ("zelanine dye, 0.75-kilo, 20 bags of 25, hplc grade, water free, mfr Orvantis m", "grade: hplc | dye, zelanine | 750 gm | case/500 | anhyd. | orvantis mdl.m | stock no 998877"),
        ("sample jar; 1 ml; single; hd polyethylene; with lid; orvantis b", "speicmen jar 1,000 ul 1/ea hdpe lid included ORVANTIS B"),
        ("dey zelanine 20 mg purity 99% qty 4 powder velquor a", "zelanine dye >=99% 20milligram pk4 in powder form by velquor a"),
    ],
)
def test_one_product(texts):
    assert len({key(t) for t in texts}) == 1, [key(t) for t in texts]
    # all attributes are stated and no word is left over
    assert None not in key(texts[0])[:-1] and key(texts[0])[-1] is None


def test_variants_differ():
    base = "stir bar; 20 cm; pack of 24; stainless; curved; velquor model k"
    for a, b in (("20 cm", "20 mm"), ("24", "12"), ("stainless", "titanium"), ("curved", "straight"), ("velquor", "orvantis"), ("model k", "model l"), ("stir bar", "sample jar")):
        assert key(base) != key(base.replace(a, b))


def test_tables(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/catalog_listings.parquet").withColumnRenamed("sku", "kind")
    read = P.attributes(rows)
    assert read.count() == rows.count()
    assert P.grouped(read).count() > 0.97 * rows.count()
    odd = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "| " * 5000, "a"), (4, "x" * 50_000, None)], "listing_id long, cleaned_description string, category string")
    assert [r.kind for r in P.attributes(odd).collect()] == [None] * 4
    # only the unknown word of the last is anything to compare
    assert [r.listing_id for r in P.grouped(P.attributes(odd)).collect()] == [4]
    assert P.attributes(odd.limit(0)).count() == 0


def test_rare_makers_and_kinds_in_a_long_table(spark):
    # 8,000 listings of one maker; another maker and kind have four, less than 0.05 %
    rows = [(f"stir bar; 20 cm; pack of {i % 90 + 1}; stainless; curved; velquor model k", "bars") for i in range(8000)]
    rare = ["flux vial; 5 ml; pack of 4; pp; sterile; mfr nastrix c", "by nastrix series c | sterile | pp | 4 ct | 5 ml | flux vial", "flux vial; 5 cc; qty 4; pp; sterile; nastrix mdl.c", "nastrix model c - flux vial - 5000 ul - 4/pk - pp - sterilized"]
    plain = ["flux vial 5 ml nastrix c polypropylene 4 pcs sterile"]
    misspelt = [("stir bra; 20 cm; pack of 3; stainless; curved; velqour model k", "bars")] * 4
    rows = [(i, t, c) for i, (t, c) in enumerate(rows + misspelt + [(t, "vials") for t in rare + plain])]
    df = spark.createDataFrame(rows, "listing_id long, cleaned_description string, category string")
    found = P.mine(df)
    assert found["makers"] == ["nastrix", "velquor"] and set(found["kinds"]) == {"flux vial", "stir bar"}
    got = P.grouped(P.attributes(df.filter("listing_id >= 8000"))).select("listing_id", "product").collect()
    assert len(got) == 9
    read = P.attributes(df).filter("listing_id >= 8004").select(*P.ATTRIBUTES).distinct().collect()
    assert [(r.kind, r.maker, r.model, r.size, r["pack"]) for r in read] == [("flux vial", "nastrix", "c", "v5000", "4")]


def test_unread_attributes_and_makers():
    assert READER.read("stir bar; 20 cm; pack of 24; stainless; mfr nosuch c")["maker"] == "nosuch"
    assert P.right_words({"support": 500, "suport": 4, "nastrix": 4, "for": 900, "ofr": 30}) == {"support", "nastrix", "for"}


def test_listings_group_by_what_they_state(spark):
    cols = ["listing_id", *P.ATTRIBUTES]
    rows = [(i, None, "d200", "50", "stainless", "left", "ombrelin", "g", None) for i in (1, 2)] + [(3, None, "d200", "50", "stainless", "right", "ombrelin", "g", None), (4, *[None] * 8)]
    got = P.grouped(spark.createDataFrame(rows, "listing_id long, " + ", ".join(f"{c} string" for c in cols[1:]))).collect()
    by = {r.listing_id: bytes(r["product"]) for r in got}
    assert set(by) == {1, 2, 3} and by[1] == by[2] != by[3]


MORE = P.Reader(("velquor",), ("velquor", "thermo fisher", "3m"), (("stir bar", "stir bar"), ("filter pad", "filter pad")), (("velquor", "x200"), ("3m", "a b")), ("now cheaper",))


def more(text):
    g = MORE.read(text)
    return tuple(g.get(a) for a in P.ATTRIBUTES)


def test_models_and_makers_of_any_form():
    base = "stir bar; 20 cm; pack of 24; stainless; velquor model X200"
    assert MORE.read(base)["model"] == "x200" == MORE.read("velquor X-200 stir bar 20 cm pack of 24 stainless")["model"]
    assert len({more(base), more(base.replace("X200", "X500")), more(base.replace("X200", "X")), more(base.replace("model X200", "series 500"))}) == 4
    for text in ("stir bar by 3M model 7; 12 mm; pack of 2", "3M series 7 stir bar pack of 2 12 mm", "12 mm - stir bar - 3M brand mdl.7 - 2/pk"):
        assert more(text) == ("stir bar", "d12", "2", None, None, "3m", "7", None)
    assert MORE.read("stir bar thermo fisher model k")["maker"] == "thermo fisher"
    assert more("stir bar; by acme labware model q7") == ("stir bar", None, None, None, None, "acme labware", "q7", None)


def test_unknown_words_keep_listings_apart():
    base = "stir bar; 20 cm; pack of 24; nylon; velquor model X200"
    assert len({more(base.replace("nylon", m)) for m in ("nylon", "ceramic", "magnetic nylon", "stainless")}) == 4
    assert more(base) == more("NOW CHEAPER - velquor X200 - nylon - stir bar - 24 ct - 200 mm")
    assert more("filter pad; 2 inch; velquor x200") != more("filter pad; 3 inch; velquor x200")
    # two materials are not the first of them
    assert more("stir bar; stainless; titanium; velquor x200") != more("stir bar; stainless; velquor x200")
    assert more("stir bar foor stainless; velquor x200") == more("stir bar for stainless; velquor x200")


def test_kinds_that_never_meet_differ():
    of = {"sodium velate": "salts", "sodium dormate": "salts", "velate sodium": "salts"}
    assert len(set(P.same_kinds(of).values())) == 1
    meets = {("sodium velate", "sodium velate"): 40, ("sodium dormate", "sodium dormate"): 30, ("velate sodium", "velate sodium"): 40, ("sodium velate", "velate sodium"): 35}
    got = P.same_kinds({"sodium velate": "salts", "sodium dormate": "salts"}, meets)
    assert got["sodium velate"] != got["sodium dormate"]
    assert P.same_kinds({"sodium velate": "salts", "velate sodium": "salts"}, meets)["velate sodium"] == "sodium velate"


def test_repeated_listings_are_no_evidence_against_a_synonym(spark):
    # most products are listed once, by either name; a table of twelve copies of each listing says no more than one copy
    name = lambda i, k: f"{k}; {i + 1} cm; pack of 4; by velquor model x{i % 7}"
    once = [name(i, "stir bar" if i < 70 else "bar for stirring") for i in range(130)] + [name(i, "bar for stirring") for i in range(10)]
    for copy in (lambda t, k: t, lambda t, k: " - ".join(reversed(t.split("; "))) + f" - item no {1000 + k}" if k % 2 else t):
        df = spark.createDataFrame([(1000 * k + i, copy(t, k), "bars") for k in range(12) for i, t in enumerate(once)], "listing_id long, cleaned_description string, category string")
        assert set(P.mine(df)["kinds"]) == {"stir bar", "bar for stirring"} and len(set(P.mine(df)["kinds"].values())) == 1


def test_a_misspelling_of_two_words_is_read_as_the_kinds_own():
    kinds = tuple(sorted(P.same_kinds({"quintose": "sugars", "quintose sugar": "sugars", "nuvarose agar": "agars", "agar nuvarose": "agars"}).items()))
    r = P.Reader((), ("velquor",), kinds)
    right = r.read("quintose sugar; 20 mg; velquor k")
    for w in ("ugar", "sgar"):  # one edit from agar too
        assert r.read(f"quintose {w}; 20 mg; velquor k") == right == r.read(f"{w}, quintose, 20 mg, velquor k")
    assert r.read("quintose; agar; 20 mg; velquor k")["rest"] == "agar" == r.read("quintose ugar; agar; 20 mg; velquor k")["rest"].split()[0]


def test_a_model_before_a_dozen():
    right = READER.read("stir bar; 20 cm; 12 ct; velquor model a")
    assert READER.read("stir bar 20 cm velquor a dozen") == right == READER.read("stir bar 20 cm a dozen velquor a")
    assert READER.read("velquor a; stir bar a dozen; 20 cm") == right == READER.read("stir bar; 20 cm; velquor a; a dozen")


def test_mined_phrases(spark):
    makers = ["thermo fisher", "3m", "velquor"]
    kinds = [f"{a} {b}" for a in ("stir", "foam", "sand") for b in ("bar", "pad", "lid", "cup")]
    rows = [(f"{k}; {i % 7 + 1} ml; pack of 4; by {m} model x{i % 3}" + ("; super cheap stuff" if i % 3 else ""), f"{k} goods") for i in range(12) for m in makers for k in kinds]
    rows = [(i, *r) for i, r in enumerate(rows)]
    found = P.mine(spark.createDataFrame(rows, "listing_id long, cleaned_description string, category string"))
    assert found["makers"] == sorted(makers) and ("thermo fisher", "x1") in found["models"] and len(found["models"]) == 9
    assert set(found["kinds"]) == set(kinds) and found["praise"] == ["super cheap stuff"]


def test_near_index_against_brute_force():
    import random

    from tallyloom.llm.spelling import Near, edits

    random.seed(8)
    words = ["".join(random.choice("abcd") for _ in range(random.randint(1, 9))) for _ in range(300)]
    near = Near(words, 2)
    for w in words[:40] + ["", "abcdabcd", "zzzz"]:
        for most in (1, 2):
            assert near.find(w, most) == sorted((edits(w, v, most), v) for v in set(words) if edits(w, v, most) <= most)


def test_unread(spark):
    read = P.attributes(spark.createDataFrame([(1, "stir bar; 20 cm; velquor model k", "bars"), (2, None, None)], "listing_id long, cleaned_description string, category string"))
    assert {r.listing_id for r in P.unread(read).collect()} >= {2}
