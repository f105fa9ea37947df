"""Best representative of each duplicate group, field by field, by iterative truth discovery.

Each usable value that a record gives for a field of its group is a claim of the record's source.
Source reliability and value support are estimated in turn: a value's support is the reliability of
the sources that claim it, a source's reliability is the mean share of support that its claims
reach in their groups, shrunk to a prior from the source's rated trust; until no reliability moves
by more than ``TOLERANCE``. The claims then compete in each group under a list of preferences, of
which support is one. Where the order among records is fixed from outside (completeness, trust,
recency, id), support decides what that order leaves open: which value of the surviving record
stands, if the record gives several, delivered again with another value.

Groups are never gathered: votes and winners are aggregates that combine on the map side, and a
value that is only the beginning of a longer one is found by sorting all values, not by comparing
pairs.

Defined results: null, blank and stand-in values are no claims; a group whose records all lack a
usable value gives no row; so does a group of fewer than two distinct record ids, or without id;
sources that are missing or unrated have trust 0; priors take trusts under 0 as 0 and over 5 as 5;
records delivered twice count once; ties end at the smaller record id; empty tables give no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lychnos.operators.neighbours import with_next
from lychnos.sources.tables import broadcast_if_small, shared_checkpoint

#: Texts that only say that nothing is known, in lower case without spaces.
STAND_INS = (
    "null", "none", "nan", "nil", "n/a", "na", "n.a.", "unknown", "notspecified", "notavailable", "notavailableonthepage", "noinformationgiven", "noinformation", "tbd", "tba", "tobeannounced", "undefined", "empty",
    "(κενό)", "κενό", "άγνωστο", "άγνωστη", "δεναναφέρεται", "δενβρέθηκανστοιχεία", "θαανακοινωθεί", "δ/υ", "μ/δ",
    "unbekannt", "keineangabe", "k.a.", "inconnu", "nonprécisé", "desconhecido",
)
#: Safety bound: reaching it is an error, not a result; a warning where support cannot change the surviving record.
ROUNDS = 200
#: Greatest move of a reliability at the fixed point.
TOLERANCE = 0.0001
#: Claims that the prior of a source counts as.
PRIOR_CLAIMS = 4.0


def folded(value: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(value, r"[\s ]+", ""))


def usable(value: Column) -> Column:
    key = folded(value)
    return F.coalesce(value.rlike(r"[\p{L}\p{N}]") & ~key.isin(*STAND_INS), F.lit(False))


def usable_items(items: Column) -> Column:
    """Distinct usable items of a list, ignoring case and spacing."""
    return F.array_distinct(F.transform(F.filter(items, lambda x: F.coalesce(x.rlike(r"[\p{L}\p{N}]"), F.lit(False))), folded))


def stem(value: Column) -> Column:
    """A text without closing spaces, dots and brackets."""
    return F.regexp_replace(value, r"^[\s ]+|[\s .…()\[\]]+$", "")


def claims(records: DataFrame, sources: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field_name, call_id, record_id, source, trust, extracted_at, value_key, n_items, stem)`` of all usable values."""
    kinds = dict(records.dtypes)
    parts = []
    for f in fields:
        if kinds[f].startswith("array"):
            items = F.filter(usable_items(F.col(f)), lambda x: ~x.isin(*STAND_INS))
            parts.append(F.struct(F.lit(f).alias("field_name"), F.array_join(F.sort_array(items), "\n").alias("text"), F.size(items).alias("n_items")))
        else:
            parts.append(F.struct(F.lit(f).alias("field_name"), F.when(usable(F.col(f)), F.col(f)).alias("text"), F.lit(1).alias("n_items")))
    rows = records.where(F.coalesce(F.trim("call_id") != "", F.lit(False)) & F.col("record_id").isNotNull())
    rows = rows.select("call_id", "record_id", F.coalesce("site_key", F.lit("")).alias("source"), "extracted_at", F.inline(F.array(*parts)))
    rows = rows.where(F.col("text").isNotNull() & (F.col("text") != "") & (F.col("n_items") > 0))
    rated = broadcast_if_small(sources.select(F.col("site_key").alias("source"), F.coalesce("trust_level", F.lit(0)).alias("trust")).dropDuplicates(["source"]))
    rows = rows.join(rated, "source", "left")
    return rows.select("field_name", "call_id", "record_id", "source", F.coalesce("trust", F.lit(0)).alias("trust"), "extracted_at", F.xxhash64(folded(F.col("text"))).alias("value_key"), F.col("n_items").cast("int").alias("n_items"), stem(F.col("text")).alias("stem"))


def value_support(found: DataFrame, rounds: int = ROUNDS, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(field_name, call_id, value_key, support)`` and ``(source, reliability)`` at the fixed point.

    If ``rounds`` rounds do not reach it, an error; with ``strict`` off a warning and what they came to.
    """
    votes = found.groupBy("field_name", "call_id", "value_key", "source").agg(F.countDistinct("record_id").alias("n"), F.max("trust").alias("trust"))
    votes = shared_checkpoint(votes)  # keys and counts only
    prior = votes.groupBy("source").agg(((F.least(F.greatest(F.max("trust"), F.lit(0)), F.lit(5)) + 1) / F.lit(6.0)).alias("prior"))
    prior = shared_checkpoint(prior)
    weight = prior.withColumn("reliability", F.col("prior"))
    for _ in range(rounds):
        support, new = _one_round(votes, prior, weight)
        new = shared_checkpoint(new)
        moved = new.join(broadcast_if_small(weight.select("source", F.col("reliability").alias("old"))), "source").agg(F.max(F.abs(F.col("reliability") - F.col("old"))).alias("m")).first()["m"]
        weight = new
        if moved is None or moved < TOLERANCE:
            break
    else:
        open_still = f"truth discovery did not converge in {rounds} rounds: a reliability still moves by {moved}, more than {TOLERANCE}"
        if strict:
            raise RuntimeError(open_still)
        warnings.warn(open_still, RuntimeWarning, stacklevel=2)
    return _supports(votes, weight), weight.select("source", "reliability")


def _supports(votes: DataFrame, weight: DataFrame) -> DataFrame:
    mine = votes.join(broadcast_if_small(weight.select("source", "reliability")), "source")
    return mine.groupBy("field_name", "call_id", "value_key").agg(F.sum(F.col("reliability") * F.col("n")).alias("support"))


def _one_round(votes: DataFrame, prior: DataFrame, weight: DataFrame) -> tuple[DataFrame, DataFrame]:
    support = _supports(votes, weight)
    total = support.groupBy("field_name", "call_id").agg(F.sum("support").alias("total"))
    share = support.join(total, ["field_name", "call_id"]).select("field_name", "call_id", "value_key", (F.col("support") / F.col("total")).alias("share"))
    reached = votes.join(share, ["field_name", "call_id", "value_key"]).groupBy("source").agg(F.sum(F.col("share") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    new = reached.join(broadcast_if_small(prior), "source").select("source", "prior", ((F.col("s") + PRIOR_CLAIMS * F.col("prior")) / (F.col("n") + PRIOR_CLAIMS)).alias("reliability"))
    return support, new


def drop_beginnings(found: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``found`` without claims of ``fields`` whose stem is only the beginning of a longer stem of the group.

    Sorted by stem, a stem that begins any other also begins its next distinct neighbour.
    """
    short = found.where(F.col("field_name").isin(*fields))
    stems = short.select("field_name", "call_id", "stem").distinct()
    nxt = with_next(stems, ["field_name", "call_id"], ["stem"], ["stem"])
    begun = nxt.where(F.col("next_stem").isNotNull() & F.startswith("next_stem", "stem")).select("field_name", "call_id", F.xxhash64("stem").alias("stem_key"), "stem")
    keep = found.withColumn("stem_key", F.xxhash64("stem"))
    return keep.join(begun, ["field_name", "call_id", "stem_key", "stem"], "left_anti").drop("stem_key")


def best_representatives(tables: Sequence[tuple[DataFrame, Sequence[str]]], sources: DataFrame, prefer: Sequence[str] = ("support", "n_items", "trust", "extracted_at"), whole_texts: Sequence[str] = ()) -> DataFrame:
    """``(call_id, field_name, record_id, value_key[, support])``: the surviving record per group and field, and which value of it stands.

    ``tables`` are record tables with the fields looked at in each; no field twice. Sources share
    one reliability over all of them. ``prefer`` orders the claims, greater first: any of support,
    n_items (completeness), trust, extracted_at, and record_id, smaller first, which comes last
    unless named. What stands after record_id decides between values of the same record. Fields in
    ``whole_texts`` lose values that are only the beginning of a longer one. Reliabilities and
    support are estimated, over all claims, if ``prefer`` has support.
    """
    ranked = list(dict.fromkeys([*prefer, "record_id"]))
    found = reduce(DataFrame.unionByName, (claims(r, sources, f) for r, f in tables))
    found = shared_checkpoint(found.withColumn("stem", F.when(F.col("field_name").isin(*whole_texts), F.col("stem"))))  # texts only where they are compared
    rest = drop_beginnings(found, whole_texts) if whole_texts else found
    if "support" in ranked:
        strict = ranked.index("support") < ranked.index("record_id")
        rest = rest.join(value_support(found, strict=strict)[0], ["field_name", "call_id", "value_key"])
    early = F.lit("0001-01-02").cast("timestamp").cast(dict(rest.dtypes)["extracted_at"])
    order = {"support": F.round("support", 9) if "support" in ranked else None, "n_items": F.col("n_items"), "trust": F.col("trust"), "extracted_at": F.coalesce(F.col("extracted_at"), early), "record_id": -F.col("record_id")}
    rank = F.struct(*(order[p].alias(p) for p in ranked), "value_key")
    best = rest.groupBy("call_id", "field_name").agg(F.max(rank).alias("b"))
    groups = reduce(DataFrame.unionByName, (_groups(r, f) for r, f in tables))
    support = [F.round("b.support", 6).alias("support")] if "support" in ranked else []
    return best.join(groups, ["call_id", "field_name"], "left_semi").select("call_id", "field_name", (-F.col("b.record_id")).alias("record_id"), F.col("b.value_key").alias("value_key"), *support)


def _groups(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The groups of at least two distinct record ids, per field."""
    many = records.groupBy("call_id").agg(F.min("record_id").alias("a"), F.max("record_id").alias("z")).where("a <> z")
    return many.select("call_id", F.explode(F.array(*map(F.lit, fields))).alias("field_name"))
