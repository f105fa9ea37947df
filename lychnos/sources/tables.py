"""Parquet tables of a data folder and the shared checkpoint folder of the session."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured size stays under this many bytes.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``; columns are pruned by what the caller selects."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: what the cluster names in ``spark.checkpoint.dir``.

    Where that setting is missing and all runs in one process, as in tests, a temporary folder is
    used; on a cluster that would be another disk for each executor, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "lychnos-checkpoints")


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in :func:`shared_folder`."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread_if_few(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files make fewer partitions than half of them, before work that costs more than a shuffle; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def measured_bytes(df: DataFrame, row_overhead: int = 64) -> int:
    """Bytes of ``df`` as text; ``df`` should be a source table or a checkpoint, since it is read once more."""
    widths = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
    return df.agg(F.coalesce(F.sum(sum(widths[1:], widths[0]) + F.lit(row_overhead)), F.lit(0)).alias("b")).first()["b"]


def fits_broadcast(df: DataFrame) -> bool:
    return measured_bytes(df) <= BROADCAST_LIMIT_BYTES


def broadcast_if_small(df: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast of ``df`` only if its measured size is under ``limit_bytes``; else leave the join to a shuffle."""
    return F.broadcast(df) if measured_bytes(df) <= limit_bytes else df
