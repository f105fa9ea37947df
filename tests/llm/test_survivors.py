import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lychnos.llm.survivors import best_representatives, claims, drop_beginnings, stem, usable, value_support

RECORDS = "record_id bigint, call_id string, site_key string, extracted_at timestamp, description string, eligibility_criteria array<string>, trust int"
ORDER = ("n_items", "trust", "extracted_at")


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("good", 5), ("bad", 1), ("unrated", None)], "site_key string, trust_level int")


def records(spark, rows):
    df = spark.createDataFrame([(i, c, s, f"2024-01-{t:02d} 00:00:00", d, e, 1) for i, c, s, t, d, e in rows], RECORDS.replace("timestamp", "string"))
    return df.withColumn("extracted_at", F.to_timestamp("extracted_at"))


def best(spark, sources, rows, order=ORDER):
    got = best_representatives([(records(spark, rows), ["description", "eligibility_criteria"])], sources, order, ["description"])
    return {(r.call_id, r.field_name): r.record_id for r in got.collect()}


def test_order(spark, sources):
    rows = [
        (1, "c", "bad", 9, "The whole text of it.", ["a"]),
        (2, "c", "good", 1, "The whole text…", ["A ", "a", None, "n/a"]),
        (3, "c", "good", 2, "n/a", ["a", "b", "not  specified "]),
        (4, "c", None, 3, "Something else", None),
        (5, "alone", "good", 1, "text", ["x"]),
        (6, None, "good", 1, "text", ["x"]),
        (7, None, "good", 1, "text", ["x"]),
        (8, "empty", "good", 1, "—", []),
        (9, "empty", "bad", 1, None, [None, " "]),
        (10, "twice", "good", 1, "t", ["x"]),
        (10, "twice", "good", 1, "t", ["x"]),
        (12, "tie", "good", 1, "t", ["x"]),
        (11, "tie", "good", 1, "t", ["x"]),
    ]
    assert best(spark, sources, rows) == {("c", "description"): 1, ("c", "eligibility_criteria"): 3, ("tie", "description"): 11, ("tie", "eligibility_criteria"): 11}


def test_support_follows_agreeing_sources(spark, sources):
    rows = [(i, "c", s, 1, d, None) for i, (s, d) in enumerate([("good", "right"), ("good", "right"), ("unrated", "right"), ("bad", "wrong")], 1)]
    assert best(spark, sources, rows, ("support",))["c", "description"] == 1
    found = claims(records(spark, rows), sources, ["description"])
    support, weights = value_support(found)
    w = {r.source: r.reliability for r in weights.collect()}
    assert w["good"] > w["bad"]
    assert len({r.support for r in support.collect()}) == 2


def test_beginnings_against_all_pairs(spark, sources):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    rows = [(i, "hot" if i % 3 else "other", "good", 1, t, None) for i, t in enumerate(texts)]
    found = claims(records(spark, rows), sources, ["description"])
    got = {r.record_id for r in drop_beginnings(found, ["description"]).collect()}
    want = {i for i, c, _, _, t, _ in rows if not any(u != t and u.startswith(t) and d == c for _, d, _, _, u, _ in rows)}
    assert got == want


def test_expressions(spark):
    df = spark.createDataFrame([("N/A",), ("(κενό)",), ("Δεν  βρέθηκαν στοιχεία ",), ("?",), ("",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(usable(F.col("t"))).collect()] == [False] * 6 + [True]
    cut = spark.createDataFrame([("a b (…)",), (" a b. [...]",), ("a b",), ("a b).",)], "t string")
    assert {r[0] for r in cut.select(stem(F.col("t"))).collect()} == {"a b"}


def test_empty(spark, sources):
    assert best_representatives([(records(spark, []), ["description"])], sources, ORDER, ["description"]).count() == 0


def test_truth_discovery_reaches_its_fixed_point(spark):
    rows = [("f", f"c{g}", i, s, 3, v) for g in range(30) for i, (s, v) in enumerate([("a", 1), ("b", 1 if g % 3 else 2), ("c", 2), ("d", 2 if g % 2 else 3)])]
    found = spark.createDataFrame(rows, "field_name string, call_id string, record_id bigint, source string, trust int, value_key bigint")
    got = {r.source: r.reliability for r in value_support(found)[1].collect()}
    want = dict.fromkeys("abcd", 4 / 6)
    for _ in range(1000):
        reached = dict.fromkeys("abcd", 0.0)
        for g in range(30):
            said = [(s, v) for f, c, i, s, t, v in rows if c == f"c{g}"]
            total = sum(want[s] for s, _ in said)
            for s, v in said:
                reached[s] += sum(want[x] for x, y in said if y == v) / total
        want = {s: (reached[s] + 4 * 4 / 6) / 34 for s in want}
    assert all(abs(got[s] - want[s]) < 0.001 for s in want)
    with pytest.raises(RuntimeError, match="converge"):
        value_support(found, rounds=1)


def test_support_finds_planted_values_better_than_a_count(spark):
    """Sources of planted reliability: the highest-supported value is right more often than the most frequent one, and reliabilities follow the plant."""
    rng = random.Random(9)
    planted = {"a": 0.95, "b": 0.9, "c": 0.35, "d": 0.3, "e": 0.25}
    rows = []
    for g in range(400):
        for i, (s, r) in enumerate(planted.items()):
            rows.append(("f", f"c{g}", 10 * g + i, s, 3, 0 if rng.random() < r else rng.randrange(1, 4)))
    found = spark.createDataFrame(rows, "field_name string, call_id string, record_id bigint, source string, trust int, value_key bigint")
    support, weights = value_support(found)
    w = {r.source: r.reliability for r in weights.collect()}
    assert min(w["a"], w["b"]) > max(w["c"], w["d"], w["e"])
    best, by = {}, {}
    for r in support.collect():
        best[r.call_id] = max(best.get(r.call_id, (0, 0)), (round(r.support, 9), -r.value_key))
    for _, c, _, _, _, v in rows:
        by.setdefault(c, []).append(v)
    supported = sum(v == 0 for _, v in best.values())
    counted = sum(max(set(v), key=lambda x: (v.count(x), -x)) == 0 for v in by.values())
    assert supported > counted > 200


def test_support_changes_survivors(spark, sf_dir):
    """Ablation: with truth discovery switched off other records survive."""
    from lychnos.llm.queries import p2_found, p2_supported

    a = {tuple(r) for r in p2_found(spark, sf_dir).collect()}
    b = {tuple(r)[:3] for r in p2_supported(spark, sf_dir).select("call_id", "field_name", "record_id").collect()}
    assert {r[:2] for r in a} == {r[:2] for r in b} and a != b


def p2_tables(spark, tmp_path, anav, ideal=(), sites=(("good", 5), ("bad", 1), ("low", 2), ("odd", -1), ("unrated", None))):
    """A data folder with the tables of p2; anav: (record_id, call_id, site_key, day, programme_name), ideal: with description and eligibility_criteria instead."""
    at = "record_id bigint, call_id string, site_key string, extracted_at string, "
    stamped = lambda rows: [(i, c, s, f"2024-01-{t:02d} 00:00:00", *rest) for i, c, s, t, *rest in rows]
    for name, df in (
        ("anav_llama3b", spark.createDataFrame(stamped(anav), at + "programme_name string")),
        ("ideal_anav", spark.createDataFrame(stamped(ideal), at + "description string, eligibility_criteria array<string>")),
        ("trusted_sources", spark.createDataFrame(list(sites), "site_key string, trust_level int")),
    ):
        if "extracted_at" in df.columns:
            df = df.withColumn("extracted_at", F.to_timestamp("extracted_at"))
        pq.write_table(df.toArrow(), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_p2_found_runs_truth_discovery_over_all_claims(spark, sf_dir, monkeypatch):
    from lychnos.llm import queries, survivors

    seen = []

    def estimated(found, *a, **k):
        seen.append((found.count(), value_support(found, *a, **k)))
        return seen[-1][1]

    monkeypatch.setattr(survivors, "value_support", estimated)
    assert queries.p2_found(spark, sf_dir).count()
    anav, ideal, sources = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("anav_llama3b", "ideal_anav", "trusted_sources"))
    assert [n for n, _ in seen] == [claims(anav, sources, ["programme_name"]).count() + claims(ideal, sources, ["description", "eligibility_criteria"]).count()]
    reliabilities = [r.reliability for r in seen[0][1][1].collect()]
    assert len(set(reliabilities)) > 6 and all(0 < r <= 1 for r in reliabilities)  # more than the priors


@pytest.mark.parametrize(("right", "wrong"), [("Alpha", "Beta"), ("Beta", "Alpha")])
def test_support_decides_between_values_of_the_surviving_record(spark, tmp_path, right, wrong):
    """Record 1 is delivered twice with other values: the one that other sources claim stands; without support it is the same one either way."""
    from lychnos.llm.queries import FIXED_ORDER, FOUND_ORDER, _survivors, p2_found

    d = p2_tables(spark, tmp_path, [(1, "c", "good", 1, wrong), (1, "c", "good", 1, right), (2, "c", "low", 1, right), (3, "c", "bad", 9, right), (4, "c", "unrated", 9, "Gamma")])
    key = lambda value: spark.range(1).select(F.xxhash64(F.lit(value.lower()))).first()[0]
    assert [(r.record_id, r.value_key) for r in _survivors(spark, d, FOUND_ORDER).collect()] == [(1, key(right))]
    assert [r.value_key for r in _survivors(spark, d, FIXED_ORDER).collect()] == [max(key(right), key(wrong))]
    assert [tuple(r) for r in p2_found(spark, d).collect()] == [("c", "programme_name", 1)]


def test_p2_found_equals_its_sql_where_support_would_choose_otherwise(spark, tmp_path):
    """Values that tie in trust and time go by the smaller record id, however many sources claim the other; trusts out of range."""
    from lychnos.llm.queries import ORACLES, p2_found, p2_supported
    from tests.oracle import connect, rows

    anav = [(1, "c", "good", 5, "Alone"), (2, "c", "good", 5, "Claimed"), (3, "c", "low", 4, "Claimed"), (4, "c", "bad", 4, "Claimed"), (5, "odd", "odd", 1, "x"), (6, "odd", "odd", 1, "y"), (7, "none", None, 1, "x"), (8, "none", "unrated", 2, "n/a")]
    ideal = [(11, "c", "good", 1, "A text (…)", ["a", "A "]), (12, "c", "good", 1, "A text of more", ["a", "b"]), (13, "c", "low", 1, "A text of more", ["b", "a"]), (14, "c", None, 3, None, None)]
    d = p2_tables(spark, tmp_path, anav, ideal)
    got = p2_found(spark, d).toPandas()
    assert rows(got) == rows(connect(d).execute(ORACLES["p2_found"]).df())
    assert ("c", "programme_name", 1) in set(got.itertuples(index=False, name=None))
    assert ("c", "programme_name", 2) in {tuple(r)[:3] for r in p2_supported(spark, d).collect()}


def test_slow_reliabilities_lose_no_row_of_a_fixed_order(spark, sources, monkeypatch):
    from lychnos.llm import survivors

    monkeypatch.setattr(survivors, "value_support", lambda found, strict: value_support(found, rounds=1, strict=strict))
    rows = [(i, f"c{g}", s, 1, d, None) for g in range(20) for i, (s, d) in enumerate([("good", "right"), ("bad", "wrong" if g % 3 else "right"), ("unrated", "wrong")], 10 * g)]
    with pytest.warns(RuntimeWarning, match="converge"):
        assert best(spark, sources, rows, (*ORDER, "record_id", "support")) == {(f"c{g}", "description"): 10 * g for g in range(20)}
    with pytest.raises(RuntimeError, match="converge"):
        best(spark, sources, rows, ("support", *ORDER))
