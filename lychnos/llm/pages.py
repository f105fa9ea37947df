"""The main body of web pages: blocks that the tree of :mod:`lychnos.llm.blocks` calls body, on pages that are no residue.

Defined results: null, empty and blank pages have no body; lines count all pieces between line feeds
from 1; blank lines are never body; pages of pure furniture and residue pages have no body; repeated
page_ids are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lychnos.llm.blocks import block_tree, body_lines, held_out_sites, learn_lines, tree_text
from lychnos.llm.residue import CHUNK, Judge, broadcast_model
from lychnos.sources.tables import spread_if_few


def main_body(pages: DataFrame, id_col: str = "page_id", text_col: str = "page_text", host_col: str = "site_key") -> DataFrame:
    """``(id_col, line_no)``: the lines of each page's main body."""
    model = broadcast_model(pages, text_col, id_col, host_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model.value)
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                texts = part.column(1).to_pylist()
                said = judge(texts)
                real = [x is not None and not x[1] for x in said]
                learn_lines(x for t, r in zip(texts, real, strict=True) if r for p in t.split("\n") if (x := p.strip()))
                got = [body_lines(t) if r else [] for t, r in zip(texts, real, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int32()))], names=[id_col, "lines"])

    kind = dict(pages.dtypes)[id_col]
    found = spread_if_few(pages.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, lines array<int>")
    return found.select(id_col, F.explode("lines").alias("line_no"))


def tree_validation(spark: SparkSession) -> DataFrame:
    """``(metric, value)``: the tree as text, and its quality on labelled sites that it was not fitted to."""
    body, furniture, wrong, missed = held_out_sites()
    out = [("tree", tree_text(block_tree())), ("blocks", str(body + furniture + wrong + missed)), ("accuracy", f"{(body + furniture) / (body + furniture + wrong + missed):.6f}")]
    out += [("precision", f"{body / (body + wrong):.6f}"), ("recall", f"{body / (body + missed):.6f}")]
    return spark.createDataFrame(out, "metric string, value string")
