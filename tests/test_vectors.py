import numpy as np
import pytest

from lychnos.functions import vectors
from lychnos.functions.vectors import top_k, top_k_per_query


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, [0.0] * 8)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3), dict(rows)


def brute(data, q, k):
    def sim(v):
        a, b = np.array(v, np.float32).astype(float), np.array(q, np.float32).astype(float)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / n) if n else 0.0

    return [i for _, i in sorted(((sim(v), i) for i, v in data.items()), reverse=True)[:k]]


def test_top_k(points):
    df, data = points
    assert [r.vec_id for r in top_k(df, data[7], 5).collect()] == brute(data, data[7], 5)
    assert top_k(df, data[7], 500).count() == len(data)
    with pytest.raises(ValueError):
        top_k(df, data[7], 0)


def test_top_k_per_query_over_several_blocks(points, monkeypatch):
    df, data = points
    monkeypatch.setattr(vectors, "BLOCK", 16)
    asked = df.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    got = {}
    for r in top_k_per_query(df, asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {i: brute(data, data[i], 4) for i in range(0, 61, 10)}
