"""Similarity of vectors and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def top_k(pairs: DataFrame, query: list[float], k: int, vec_col: str = "embedding", order_col: str = "vec_id") -> DataFrame:
    """The ``k`` rows most like ``query`` with column ``sim``; ties go to the greater ``order_col``."""
    if k < 1:
        raise ValueError("k is at least 1")
    q = F.array(*(F.lit(float(x)) for x in query))
    return pairs.withColumn("sim", cosine(F.col(vec_col), q)).orderBy(F.desc("sim"), F.desc(order_col)).limit(k)


#: Vectors per block; a pair of blocks is one matrix product of at most this size squared.
BLOCK = 2048


def _blocks(df: DataFrame, id_col: str, vec_col: str, name: str) -> DataFrame:
    """``(<name>_ids, <name>_rows)``: blocks of up to ``BLOCK`` vectors as a flat matrix."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64()), pa.binary()
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                ids = part.column(0).to_pylist()
                rows = np.array(part.column(1).to_pylist(), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([ids], kind[0]), pa.array([rows.tobytes()], kind[1])], names=[f"{name}_ids", f"{name}_rows"])

    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint"), vec_col)
    return rows.mapInArrow(pack, f"{name}_ids array<bigint>, {name}_rows binary")


def _unit(raw: bytes, n: int) -> np.ndarray:
    m = np.frombuffer(raw, np.float64).reshape(n, -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def top_k_per_query(pairs: DataFrame, queries: DataFrame, k: int, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``(query_id, vec_id, sim, rank)``: a stated query set (query_id, query) against all rows, in blocks.

    Both sides are packed into blocks of ``BLOCK`` vectors and every pair of blocks is one matrix
    product; only the best k of each query leave a pair. So no side needs to fit anywhere, and what
    is shuffled is k rows per query and row block. All vectors have the same length.
    """
    if k < 1:
        raise ValueError("k is at least 1")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", id_col, "sim"]
        for b in batches:
            for ids, rows, qids, qrows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sim = _unit(qrows, len(qids)) @ _unit(rows, len(ids)).T
                key = np.array(ids)
                least = np.partition(sim, -k, axis=1)[:, -k:].min(axis=1) if len(ids) > k else np.full(len(qids), -np.inf)
                q, at = np.nonzero(sim >= least[:, None])  # the best k and whatever ties with the last of them
                order = np.lexsort((-key[at], -sim[q, at], q))
                q, at = q[order], at[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, at = q[keep], at[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(qids)[q]), pa.array(key[at]), pa.array(sim[q, at])], names=names)

    rows, asked = _blocks(pairs, id_col, vec_col, "row"), _blocks(queries, "query_id", "query", "query")
    scored = rows.crossJoin(asked).mapInArrow(best, f"query_id bigint, {id_col} bigint, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.desc(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
