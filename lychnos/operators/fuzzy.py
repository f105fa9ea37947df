"""Fuzzy match of prompts against a registry of trusted sources."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lychnos.sources.tables import broadcast_if_small

#: Least similarity of prompt and key, inclusive.
THRESHOLD = 0.25


@F.pandas_udf(DoubleType())
def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two texts in lower case; one matcher per key, since that is what it indexes."""
    for a, b in batches:
        out = pd.Series(0.0, index=a.index)
        for key, rows in b.groupby(b):
            m = SequenceMatcher(None, "", key.lower())
            for i in rows.index:
                m.set_seq1(a[i].lower())
                out[i] = m.ratio()
        yield out


def _bag(text: Column) -> Column:
    """The characters of a text with their count so far, so that a set of them is a multiset of characters."""
    chars = F.array_sort(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c)).cast("string")))


def match_sources(prompts: DataFrame, sources: DataFrame, id_col: str = "prompt_id", text_col: str = "prompt", threshold: float = THRESHOLD) -> DataFrame:
    """``(id_col, domain, ratio, pos, url)``: the URLs of every source whose key resembles the prompt.

    ``sources`` (domain, urls) keeps its order in ``pos`` by (domain, place in the list). Equal
    prompts are compared once. The ratio is at most twice the number of common characters over the
    sum of the lengths, and that at most twice the shorter length over the sum; pairs that these
    bounds rule out never reach Python. Null prompts match nothing; two empty texts have ratio 1.
    """
    spark = prompts.sparkSession
    p = prompts.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text__"))
    # compared over all cores: the distinct prompts may be few bytes, but each meets all sources
    texts = p.select("text__").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = texts.withColumn("low__", F.lower("text__")).withColumn("n__", F.length("low__")).withColumn("bag__", _bag(F.col("low__")))
    key = F.lower("domain")
    s = broadcast_if_small(sources.select("domain", "urls", key.alias("key_low__"), F.length(key).alias("key_n__"), _bag(key).alias("key_bag__")))
    total = F.lit(threshold) * (F.col("n__") + F.col("key_n__")) - 1e-9
    by_length = 2 * F.least("n__", "key_n__") >= total
    possible = by_length & (2 * F.size(F.array_intersect("bag__", "key_bag__")) >= total)
    near = texts.join(s, possible).withColumn("ratio", similarity("low__", "key_low__")).where(F.col("ratio") >= threshold).select("text__", "domain", "urls", "ratio")
    return p.join(near, "text__").select(id_col, "domain", "ratio", F.posexplode("urls").alias("pos", "url"))
