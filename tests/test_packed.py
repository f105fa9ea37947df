import pytest

from lychnos.operators.packed import resolve, split_packed


def split(spark, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"record_id bigint, f {kind}")
    out = {}
    for r in split_packed(df, "record_id", ["f"]).orderBy("record_id", "pos").collect():
        out.setdefault(r.record_id, []).append((r.pos, r.item_text))
    return [[t for _, t in out.get(i, [])] for i in range(len(values))]


CASES = {
    "Βιβλία, Μουσεία": ["Βιβλία", "Μουσεία"],
    'Α | "Βιβλιοθήκες, Μουσεία"': ["Α", "Βιβλιοθήκες, Μουσεία"],
    '["Α, Β", "Γ"]': ["Α, Β", "Γ"],
    "['https://a.b/c', 'τηλ. 200-555-1111', 'Δήμοι (νησιωτικοί, ορεινοί)']": ["https://a.b/c", "τηλ. 200-555-1111", "Δήμοι (νησιωτικοί, ορεινοί)"],
    "1) email: a@b.example 2) +30 200 555 1234": ["email: a@b.example", "+30 200 555 1234"],
    "α) Ξενώνες (έως 12; χωρίς)\nβ) Β": ["Ξενώνες (έως 12; χωρίς)", "Β"],
    "a@b.example c@d.example https://e.f": ["a@b.example", "c@d.example", "https://e.f"],
    'https://e.f "a@b.example"': ["https://e.f", "a@b.example"],
    "Κλήρος 61,5%, Άλλο 3%": ["Κλήρος 61,5%", "Άλλο 3%"],
    "Σωματείο «Πράσινη Αυλή»;; «Όλο»": ["Σωματείο «Πράσινη Αυλή»", "Όλο"],
    "- A\n- B": ["A", "B"],
    "• A • B": ["A", "B"],
    "A|| || B||": ["A", "B"],
    "A / B και/ή Γ": ["A", "B και/ή Γ"],
    "  ": [],
    "": [],
    'unclosed "quote, here': ['unclosed "quote', "here"],
    "same; same": ["same", "same"],
    "don't; l'eau": ["don't", "l'eau"],
    "|;,": [],
    "a@b.example;https://e.f/g\u00a0": ["a@b.example", "https://e.f/g"],
    "\u2009https://e.f\u202f; x\u00a0y\u3000": ["https://e.f", "x\u00a0y"],
    "\u00a0\u2003": [],
}


def test_values(spark):
    assert split(spark, [*CASES, None]) == [*CASES.values(), []]


def test_positions_run_on_across_elements(spark):
    got = split(spark, [["a; b", None, " ", "c"], [], None, ["x"]], "array<string>")
    assert got == [["a", "b", "c"], [], [], ["x"]]


def test_latest_delivery_counts_once_and_other_columns_do_not_matter(spark):
    rows = [(1, "old", "2024-01-01 00:00:00", 1), (1, "new; er", "2024-01-02 00:00:00", 2), (1, "new; er", "2024-01-02 00:00:00", 2)]
    df = spark.createDataFrame(rows, "record_id bigint, f string, v string, toks int").selectExpr("record_id", "f", "to_timestamp(v) AS v", "toks", "toks AS skeleton", "toks AS rid", "toks AS part")
    got = sorted((r.pos, r.item_text) for r in split_packed(df, "record_id", ["f"], "v").collect())
    assert got == [(1, "new"), (2, "er")]


def test_long_text_and_empty_table(spark):
    assert len(split(spark, ["; ".join(["word " * 40] * 2000)])[0]) == 2000
    assert [len(x) for x in split(spark, ["word " * 100_000])[0]] == [499_999]  # no recursion in the token pattern
    assert [len(x) for x in split(spark, ["x" * 300_000 + ";" + "1,5 " * 100_000])[0]] == [300_000, 399_999]
    assert split_packed(spark.createDataFrame([], "record_id bigint, f string"), "record_id", ["f"]).count() == 0


@pytest.mark.parametrize("s", ["((((", '"""', "[[]", "", "«»", ")(", "a" * 3000 + ";" * 3000])
def test_resolve_never_fails(s):
    for at, n in resolve(s):
        assert 1 <= at <= len(s) and n > 0


@pytest.mark.parametrize("common", [1, 3, 10_000])
def test_rules_beyond_the_broadcast_limit(spark, monkeypatch, common):
    from lychnos.operators import packed

    monkeypatch.setattr(packed, "fits_broadcast", lambda _: False)
    monkeypatch.setattr(packed, "COMMON", common)
    values = ["one"] * 20 + ["a; b"] * 4 + ["x, y, z", '"q; r"; s']
    assert split(spark, values) == [["one"]] * 20 + [["a", "b"]] * 4 + [["x", "y", "z"], ["q; r", "s"]]
