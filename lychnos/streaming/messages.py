"""Streams of message pieces and of prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

CHUNKS = "conv_id bigint, turn bigint, seq bigint, chunk string, done boolean"


def message_log(chunks: DataFrame, watermark: str | None = None, time_col: str | None = None) -> DataFrame:
    """Whole messages from a stream of pieces, in the order of ``seq``; only those whose last piece has come.

    Pieces of one message may arrive in any order and in several batches; a message that never ends
    is not recorded. With ``time_col`` and ``watermark`` its state is dropped when it is too late.
    """
    if watermark and time_col:
        chunks = chunks.withWatermark(time_col, watermark)
    pieces = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("chunk", F.lit("")).alias("chunk"))))
    got = chunks.groupBy("conv_id", "turn").agg(pieces.alias("pieces"), F.max("done").alias("done"))
    return got.where("done").select("conv_id", "turn", F.array_join(F.transform("pieces", lambda x: x["chunk"]), "").alias("text"))


def run_on(stream: DataFrame, pipeline: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch of a stream of prompts through a batch pipeline, appended as parquet; a batch that is run again replaces its own files."""

    def step(batch: DataFrame, batch_id: int) -> None:
        pipeline(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
