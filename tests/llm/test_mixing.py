import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lychnos.llm.mixing import mix_sources, water_fill
from lychnos.llm.tokens import VOCABULARIES

TARGETS = "mix_name string, source string, target_share double, max_repeats int, size_factor double"


def test_water_fill():
    assert water_fill(100, {"a": 0.5, "b": 0.5}, {"a": 1000, "b": 1000}) == {"a": 50, "b": 50}
    assert water_fill(100, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}) == {"a": 10, "b": 54, "c": 36}
    assert water_fill(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}) == {"a": 10, "b": 20}
    assert water_fill(100, {"a": 1.0, "b": 0.0}, {"a": 0.0}) == {"a": 0.0, "b": 0.0}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0, 1), st.floats(0, 100)), min_size=1), st.floats(0, 200))
def test_water_fill_is_feasible_and_complete(sources, total):
    shares, caps = {s: w for s, (w, _) in sources.items()}, {s: c for s, (_, c) in sources.items()}
    got = water_fill(total, shares, caps)
    assert all(0 <= got[s] <= caps[s] + 1e-6 for s in got)
    able = sum(caps[s] for s in got if shares[s] > 0)
    if any(w > 1e-9 for w in shares.values()):
        assert sum(got.values()) == pytest.approx(min(total, able), rel=1e-6, abs=1e-6) or min(w for w in shares.values() if w > 0) < 1e-9


@pytest.mark.skipif(not os.path.isdir(VOCABULARIES), reason="no vocabularies here")
def test_mix(spark):
    docs = [(i, "word " * 20, "hot" if i % 3 else "small") for i in range(600)] + [(900, None, "hot"), (901, "", "hot"), (902, "lost", None), (903, "other words", "unasked")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("m", "hot", 0.5, 1, 0.9), ("m", "small", 0.4, 2, 0.9), ("m", "none", 0.1, 3, 0.9)], TARGETS)
    mix, shares = mix_sources(df, t)
    rows = mix.collect()
    assert {r.source for r in rows} == {"hot", "small"}
    assert max(r.copies for r in rows if r.source == "small") <= 2 and max(r.copies for r in rows if r.source == "hot") == 1
    by = {r.source: r for r in shares.collect()}
    assert by["none"].actual_tokens == 0 and by["none"].actual_share == 0
    for s in ("hot", "small"):
        assert abs(by[s].actual_tokens - by[s].allowed_tokens) <= 21
    again = {(r.doc_id, r.copies) for r in mix_sources(df.repartition(7), t)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    assert {(r.doc_id, r.copies) for r in mix_sources(df, t, seed=5)[0].collect()} != again
    assert mix_sources(df.limit(0), t)[0].count() == 0
    odd = spark.createDataFrame([("m", None, 0.5, 1, 0.9), ("m", "small", None, 2, 0.9), (None, "hot", 1.0, None, None), (None, "hot", 0.5, 3, 1.0)], TARGETS)
    mix, shares = mix_sources(df, odd)
    assert {(r.mix_name, r.source) for r in shares.collect()} == {("m", "small"), ("", "hot")}
    assert {r.source for r in mix.collect()} == {"hot"}
    assert mix_sources(df, t.limit(0))[0].count() == 0
