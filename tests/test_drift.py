import json
import random

import pytest

from lychnos.operators.drift import line_counts, schema_changes, type_alternatives, union_records
from lychnos.operators.neighbours import with_next

KINDS = "feed_id string, file_id bigint, exported_at timestamp, line_no int, raw_json string"


def files(spark, per_file, feed="f"):
    rows = []
    for i, lines in enumerate(per_file):
        for n, line in enumerate(lines):
            rows.append((feed, i + 1, f"2024-01-{i + 1:02d} 00:00:00", n, line if isinstance(line, str) else json.dumps(line)))
    df = spark.createDataFrame(rows, "feed_id string, file_id bigint, t string, line_no int, raw_json string")
    return df.selectExpr("feed_id", "file_id", "to_timestamp(t) AS exported_at", "line_no", "raw_json")


def changes(df):
    return sorted((r.file_id, r.change_kind, r.old_name, r.new_name) for r in schema_changes(df).collect())


MAILS = [f"info{i}@a.example" for i in range(6)]
WORDS = ["grant for houses", "soft loan", "guarantee for loans"]


def rec(**kw):
    return {"call_id": "AN-1", **kw}


def test_changes(spark):
    one = [rec(contact_info=[m], funding_type=w) for m, w in zip(MAILS, WORDS * 2, strict=True)]
    two = [rec(contacts=[m], funding_type=w, page_views=5) for m, w in zip(MAILS, WORDS * 2, strict=True)]
    three = [rec(contacts="; ".join(MAILS), funding_type=[w]) for w in WORDS]
    four = [rec(contact_info=None, funding_type=[w], page_views=7) for w in WORDS]
    got = changes(files(spark, [one, two, three, four]))
    assert got == [
        (2, "added", "", "page_views"), (2, "renamed", "contact_info", "contacts"),
        (3, "removed", "page_views", ""), (3, "retyped", "contacts", "contacts"), (3, "retyped", "funding_type", "funding_type"),
        (4, "added", "", "page_views"), (4, "renamed", "contacts", "contact_info"),
    ]


def test_renamed_and_retyped_gives_two_rows(spark):
    one = [rec(contact_info=[m]) for m in MAILS]
    two = [rec(reach={"main": m}) for m in MAILS]
    assert changes(files(spark, [one, two])) == [(2, "renamed", "contact_info", "reach"), (2, "retyped", "contact_info", "reach")]


def test_unreadable_repeated_and_empty(spark):
    one = [rec(a="x"), '{"call_id": "cut', "[1]", "", rec(a="x")]
    two = [rec(a=None), rec(a=[])]
    assert changes(files(spark, [one, two])) == []
    assert schema_changes(spark.createDataFrame([], KINDS)).count() == 0
    assert line_counts(files(spark, [one])).where("feature is null and name = 'a'").groupBy().sum("n").first()[0] == 2


def test_union(spark):
    df = files(spark, [[rec(contact_info=[m], n=3) for m in MAILS], [rec(kontakte=[m]) for m in MAILS]])
    rows = union_records(df, ["contact_info"]).collect()
    assert {r.field_name for r in rows if r.written_name == "kontakte"} == {"contact_info"}
    assert [r.as_number for r in rows if r.written_name == "n"] == [3.0] * 6
    kinds = {(r.name, r.kind) for r in type_alternatives(df).collect()}
    assert ("n", "number") in kinds and ("kontakte", "list of texts") in kinds


def test_union_keeps_inner_values(spark):
    parties = {"main": "Halls (big, small)", "other": "Forest, Water and Soil Services, Clubs"}
    one = [
        rec(funding_type={"label": "grant", "repayable": True}, eligible_parties=[{"name": "Clinics", "rank": 1}, {"name": "Clubs", "rank": 2}], is_open=False),
        rec(funding_type="grant", eligible_parties=["Forest, Water and Soil Services"], contact_info=[{"channel": "web", "address": MAILS[0]}]),
        rec(eligible_parties=parties, contact_info={"first": MAILS[0], "rest": [MAILS[1]]}),
        rec(eligible_parties="Halls (big; small); Clubs", contact_info=f"{MAILS[0]} | {MAILS[1]}"),
    ]
    df = files(spark, [one])
    got = {(r.line_no, r.field_name): r for r in union_records(df, ["funding_type", "eligible_parties", "contact_info"]).collect()}
    assert (got[0, "funding_type"].as_text, got[0, "funding_type"].as_object) == ("grant", {"label": "grant", "repayable": "true"})
    assert [(x.path, x.kind, x.as_text, x.as_boolean) for x in got[0, "funding_type"].leaves] == [(".label", "text", "grant", None), (".repayable", "true/false", "true", True)]
    assert got[0, "eligible_parties"].as_list == ["Clinics", "Clubs"]
    assert got[0, "eligible_parties"].as_objects == [{"name": "Clinics", "rank": "1"}, {"name": "Clubs", "rank": "2"}]
    assert [(x.path, x.place, x.as_number) for x in got[0, "eligible_parties"].leaves if x.kind == "number"] == [("[].rank", "[0].rank", 1.0), ("[].rank", "[1].rank", 2.0)]
    assert got[0, "is_open"].as_boolean is False and got[1, "funding_type"].as_boolean is None
    assert got[1, "contact_info"].as_list == [MAILS[0]]
    assert got[2, "eligible_parties"].as_list == ["Halls (big, small)", "Forest, Water and Soil Services", "Clubs"]
    assert got[2, "contact_info"].as_list == got[3, "contact_info"].as_list == MAILS[:2]
    assert got[3, "eligible_parties"].as_list == ["Halls (big; small)", "Clubs"]
    assert {len(v.leaves) for (_, f), v in got.items() if f == "call_id"} == {1}
    paths = {(r.name, r.path, r.kind, r.n_files) for r in type_alternatives(df).collect()}
    assert {("eligible_parties", "[].rank", "number", 1), ("eligible_parties", "", "list of objects", 1), ("funding_type", ".repayable", "true/false", 1)} <= paths


@pytest.mark.parametrize("seed", [1, 2])
def test_next_row_across_partitions(spark, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(50), i) for i in range(300)] + [(None, 1, 900), (None, 2, 901)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r.k, r.o, r.v): r.next_v for r in with_next(df, ["k"], ["o", "v"], ["v"]).collect()}
    order = sorted(rows, key=lambda r: (r[0] or "", r[1], r[2]))
    want = {a: (b[2] if b and b[0] == a[0] else None) for a, b in zip(order, [*order[1:], None], strict=True)}
    assert got == want
    assert with_next(df.limit(0), ["k"], ["o"], ["v"]).count() == 0


def test_like_fields_renamed_in_one_step(spark):
    from lychnos.operators.drift import _features

    sums = ["5.000 EUR", "7.000 EUR", "9.500 EUR"]
    one = [rec(least=a, most=a) for a in sums]
    two = [rec(from_sum=a, to_sum=a) for a in sums]
    assert changes(files(spark, [one, two])) == [(2, "renamed", "least", "from_sum"), (2, "renamed", "most", "to_sum")]
    assert "#n5" in _features(["1 2 3 4 5 6 7 8 10000"])
    assert ("9", "€") in _features(["up to " + "many " * 400 + "5 €"])  # long values have a shape too


def test_seams_beyond_the_broadcast_limit(spark, monkeypatch):
    from lychnos.operators import neighbours

    df = spark.createDataFrame([("hot", i) for i in range(200)], "k string, o int")
    monkeypatch.setattr(neighbours, "fits_broadcast", lambda _: False)
    got = {r.o: r.next_o for r in with_next(df, ["k"], ["o"], ["o"]).collect()}
    assert got == {i: i + 1 if i < 199 else None for i in range(200)}
