"""Messages, prompts and histories of conversations."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lychnos.functions.text import basename

MESSAGE = "struct<role:string,content:string,images:array<string>>"
MESSAGES = f"array<{MESSAGE}>"


def message(role: str, content: Column, images: Column | None = None) -> Column:
    """One message; images are null where there are none."""
    pics = images if images is not None else F.lit(None).cast("array<string>")
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"), pics.alias("images"))


def prompt_list(system: Column, user: Column, history: Column | None = None, images: Column | None = None) -> Column:
    """System message, what was said before, user message."""
    before = F.coalesce(history, F.array().cast(MESSAGES)) if history is not None else F.array().cast(MESSAGES)
    return F.concat(F.array(message("system", system)), before, F.array(message("user", user, images)))


_FIELD = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """A template with named fields filled; ``{{`` and ``}}`` are braces. Values are never filled again.

    The template is cut up on the driver, so the plan holds one concatenation.
    """
    parts: list[Column] = []
    at = 0
    for m in _FIELD.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        name = m.group(1)
        if name is None:
            parts.append(F.lit(m.group()[0]))
        elif name in values:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        else:
            raise KeyError(name)
        at = m.end()
    rest = template[at:]
    if re.search(r"[{}]", rest):
        raise ValueError("the template has a stray brace")
    return F.concat(*parts, F.lit(rest))


def document_prompt(docs: DataFrame, key: str, path_col: str = "path", text_col: str = "text", pos_col: str = "pos", question_col: str | None = None) -> DataFrame:
    """``(key, prompt)``: the documents of each question in order, then the question."""
    block = F.concat(F.lit("Contents of document "), basename(F.col(path_col)), F.lit(" :\n"), F.coalesce(F.col(text_col), F.lit("")), F.lit("\n\n"))
    rows = docs.select(key, F.col(pos_col).alias("pos__"), block.alias("block__"), *([F.col(question_col).alias("q__")] if question_col else []))
    agg = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos__", "block__"))), lambda x: x["block__"]), "").alias("text__")]
    if question_col:
        agg.append(F.first("q__", ignorenulls=True).alias("q__"))
    got = rows.groupBy(key).agg(*agg)
    tail = F.concat(F.lit("\nUser's question: "), F.coalesce(F.col("q__"), F.lit(""))) if question_col else F.lit("")
    return got.select(key, F.concat(F.col("text__"), tail).alias("prompt"))


def with_history(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each turn with the messages said before it, in order, as ``history``; an empty list for the first."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    said = F.struct(F.col(role).alias("role"), F.col(text).alias("content"), F.lit(None).cast("array<string>").alias("images"))
    return log.withColumn("history", F.collect_list(said).over(w))


def rebuild_messages(chunks: DataFrame, keys: tuple[str, ...] = ("conv_id", "turn"), seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Streamed pieces joined to whole messages in the order of ``seq``."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.coalesce(F.col(chunk), F.lit("")).alias("c"))))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda x: x["c"]), "").alias("text"))


def leaves_chat(text: Column) -> Column:
    """Whether an input ends the loop."""
    return F.lower(F.trim(text)).isin("exit", "quit")


def route(text: Column, matched_url: Column) -> Column:
    """``online`` for an explicit web address or a trusted match, else ``chat``; blank and exit inputs have no route."""
    live = ~leaves_chat(text) & (F.trim(text) != "")
    return F.when(live & (F.startswith(F.trim(text), F.lit("http://")) | F.startswith(F.trim(text), F.lit("https://"))), F.lit("online")).when(live & matched_url.isNotNull(), F.lit("online")).when(live, F.lit("chat"))
