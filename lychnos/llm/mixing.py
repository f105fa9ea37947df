"""Mixing sources to target weights by capped water-filling.

Sizes are tokens of a public tokenizer. Each mix has a total; a source may give at most its tokens
times its maximum number of repeats. Shares above that are clamped and the excess is spread over
the other sources in proportion to their shares, until nothing exceeds its cap. A source that
receives r epochs gives every document floor(r) times, and once more the documents with the lowest
seeded hash until the fraction is filled: the hash threshold is found by refining a histogram of
hashed token sums three times (4096 cells each), so no source is ever sorted or collected.

Defined results: documents without a source, or whose source is in no mix, are never chosen; null
and empty texts have size 0 and are chosen as their hash falls; a source without documents gives
nothing and its share is spread; in the targets a missing source is left out, a repeated one counts
once, a missing share is 0, missing repeats and size factor are 1; repeated doc_ids are separate documents; the same seed gives the
same mix at any parallelism.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lychnos.llm.tokens import VOCABULARIES, count_tokens
from lychnos.sources.tables import broadcast_if_small, shared_checkpoint

CELLS = 4096
LEVELS = 3


def water_fill(total: float, shares: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Tokens per source: shares of ``total`` clamped at ``caps``, the excess redistributed in proportion."""
    out: dict[str, float] = {}
    free = {s for s, w in shares.items() if w > 0}
    left = total
    while free:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if left * shares[s] / weight >= caps.get(s, 0.0)}
        if not full:
            out |= {s: left * shares[s] / weight for s in free}
            break
        for s in full:
            out[s] = caps.get(s, 0.0)
            left -= out[s]
        free -= full
    return {s: out.get(s, 0.0) for s in shares}


def _allocate(targets: Iterable, sizes: dict[str, int], known: int) -> list[tuple]:
    """``(mix, source, share, repeats, whole, part_tokens, allowed)`` for each row of the mixes."""
    mixes: dict[str, list] = {}
    for t in targets:
        own = mixes.setdefault(t["mix_name"] or "", [])
        if t["source"] is not None and all(t["source"] != o["source"] for o in own):
            own.append({"source": t["source"], "target_share": t["target_share"] or 0.0, "max_repeats": max(0, t["max_repeats"] if t["max_repeats"] is not None else 1), "size_factor": t["size_factor"] if t["size_factor"] is not None else 1.0})
    rows = []
    for mix, own in mixes.items():
        if not own:
            continue
        share = {t["source"]: float(t["target_share"]) for t in own}
        caps = {t["source"]: float(sizes.get(t["source"], 0) * t["max_repeats"]) for t in own}
        got = water_fill(known * float(own[0]["size_factor"]), share, caps)
        for t in own:
            n, give = sizes.get(t["source"], 0), got[t["source"]]
            whole = min(int(give // n), int(t["max_repeats"])) if n else 0
            part = max(0.0, give - whole * n) if whole < t["max_repeats"] else 0.0
            rows.append((mix, t["source"], share[t["source"]], int(t["max_repeats"]), whole, part, give))
    return rows


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 17, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> tuple[DataFrame, DataFrame]:
    """The mix ``(mix_name, doc_id, source, copies, n_tokens)`` and the report of shares.

    ``docs``: doc_id, text, source. ``targets``: mix_name, source, target_share, max_repeats,
    size_factor; a fixed table, whose rows are read to the driver.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("source").isNotNull() & (F.trim("source") != ""))
    sized = count_tokens(known, "text", ["doc_id", "source"], tokenizer, folder)
    sized = shared_checkpoint(sized.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(CELLS**LEVELS))))
    goal = targets.collect()
    wanted = spark.createDataFrame([(s,) for s in sorted({t["source"] for t in goal} - {None})], "source string")
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    ours = sized.join(F.broadcast(wanted), "source")  # one row per source of the fixed target table
    sizes = {r["source"]: r["n"] for r in ours.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = _allocate(goal, sizes, total)

    # per row of the plan: the hash below which a document is taken once more
    low = [0] * len(plan)
    left = [p[5] for p in plan]
    for level in range(LEVELS):
        width = CELLS ** (LEVELS - 1 - level)
        cells = spark.createDataFrame([(i, p[1], lo, lo + width * CELLS) for i, (p, lo) in enumerate(zip(plan, low, strict=True))], "i int, source string, lo bigint, hi bigint")
        hist = ours.join(F.broadcast(cells), "source").where("h >= lo and h < hi").groupBy("i", F.floor((F.col("h") - F.col("lo")) / width).alias("cell")).agg(F.sum("n_tokens").alias("n"))
        by: dict[int, dict[int, int]] = {}
        for r in hist.collect():  # at most CELLS numbers per row of the target table
            by.setdefault(r["i"], {})[r["cell"]] = r["n"]
        for i in range(len(plan)):
            cell = 0
            own = by.get(i, {})
            while cell < CELLS - 1 and own.get(cell, 0) <= left[i]:
                left[i] -= own.get(cell, 0)
                cell += 1
            if level == LEVELS - 1 and own.get(cell, 0) < 2 * left[i]:
                cell += 1  # the document that crosses the goal comes nearer to it than none
            low[i] += cell * width
    takes = [(p[0], p[1], p[4], low[i] if p[5] > 0 else 0) for i, p in enumerate(plan)]
    rule = spark.createDataFrame(takes, "mix_name string, source string, whole int, below bigint")
    copies = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    mix = ours.join(broadcast_if_small(rule), "source").withColumn("copies", copies).where("copies > 0").select("mix_name", "doc_id", "source", "copies", "n_tokens")

    got = mix.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.sum("copies").alias("documents"))
    report = spark.createDataFrame([(p[0], p[1], p[2], p[3], sizes.get(p[1], 0), p[6]) for p in plan], "mix_name string, source string, target_share double, max_repeats int, source_tokens bigint, allowed_tokens double")
    sums = got.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    shares = report.join(got, ["mix_name", "source"], "left").join(sums, "mix_name", "left").select(
        "mix_name", "source", "target_share", "max_repeats", "source_tokens", F.round("allowed_tokens", 3).alias("allowed_tokens"),
        F.coalesce("tokens", F.lit(0)).alias("actual_tokens"), F.coalesce("documents", F.lit(0)).alias("copies"),
        F.round(F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)), 6).alias("actual_share"),
    )
    return mix, shares
