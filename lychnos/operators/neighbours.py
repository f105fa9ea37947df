"""The next row in sort order, without putting a whole group into one task.

A window over a hot key runs in one task. Here the rows are range-partitioned on key and order
together, so a hot key spreads over many partitions. The first row of each partition closes the seam
to the one before: these rows are a table of their own, joined by partition number (broadcast if its
measured size allows it); the driver sees partition numbers alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lychnos.sources.tables import fits_broadcast, shared_checkpoint


def with_next(df: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """``df`` with columns ``next_<c>`` for each ``c`` of ``carry``: the values of the following row of the same ``keys`` in ``order``, else null.

    The order should be total; rows equal in ``keys`` and ``order`` follow each other in any order.
    Null keys form a group of their own.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [*keys, *order]
    done = shared_checkpoint(df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols))
    wanted = list(dict.fromkeys([*keys, *carry]))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                one = b.slice(0, 1)
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *one.columns], names=["pid__", *(f"first_{c}" for c in wanted)])
                return

    fields = {f.name: f for f in done.schema.fields}
    first_schema = StructType([StructField("pid__", IntegerType()), *(StructField(f"first_{c}", fields[c].dataType) for c in wanted)])
    heads = shared_checkpoint(done.select(*wanted).mapInArrow(firsts, first_schema))
    pids = sorted(r[0] for r in heads.select("pid__").collect())  # a number per partition
    after = dict(zip(pids, pids[1:], strict=False))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        edge = after.get(TaskContext.get().partitionId())

        def joined(b: pa.RecordBatch, nxt: pa.RecordBatch | None) -> pa.RecordBatch:
            n = b.num_rows
            col = lambda r, c: r.column(r.schema.get_field_index(c))
            shifted = lambda c: pa.concat_arrays([col(b, c).slice(1), col(nxt, c).slice(0, 1) if nxt is not None else pa.nulls(1, col(b, c).type)])
            same = [True] * (n - 1) + [nxt is not None]
            for k in keys:
                same = [s and x == y for s, x, y in zip(same, col(b, k).to_pylist(), shifted(k).to_pylist(), strict=True)]
            at = pa.array([i if s else None for i, s in enumerate(same)], pa.int32())
            edges = pa.array([None] * (n - 1) + [edge if nxt is None else None], pa.int32())
            return pa.RecordBatch.from_arrays([*b.columns, *(shifted(c).take(at) for c in carry), edges], names=[*b.schema.names, *(f"next_{c}" for c in carry), "edge__"])

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield joined(held, b)
            held = b
        if held is not None:
            yield joined(held, None)

    out_schema = StructType([*done.schema.fields, *(StructField(f"next_{c}", fields[c].dataType) for c in carry), StructField("edge__", IntegerType())])
    rows = done.mapInArrow(follow, out_schema)

    def closed(part: DataFrame, first: DataFrame) -> DataFrame:
        same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"first_{k}")), keys, F.col("pid__").isNotNull())
        both = part.join(first, F.col("edge__") == F.col("pid__"), "left")
        return both.select(*done.columns, *(F.when(same, F.col(f"first_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in carry))

    if fits_broadcast(heads):
        return closed(rows, F.broadcast(heads))
    inner = rows.where("edge__ is null").drop("edge__")  # rows without a seam need no join, and would all have the same key
    return inner.unionByName(closed(rows.where("edge__ is not null"), heads))
