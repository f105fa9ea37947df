"""Schemas that drift between files: one table of tagged values, and a report of each change.

Each readable line is parsed once into tagged values: name, kind (text, number, true/false, object,
list of texts, list of objects) and the leaf texts. Kinds are fused per file and name (parallel
schema fusion: alternatives are kept and counted, the most frequent one is the file's type), files
are compared with the previous file of their feed, and a field that went is matched with one that
came by the similarity of their value profiles (value features over all files, tf-idf cosine), each with its mutual best partner, and again among those left over.

The table of records and the list of alternatives go below the names: each value is walked to its
inner values, tagged with path and kind. Paths are relative to the name: ``""`` is the value itself,
``.label`` a member, ``[]`` an element.

Defined results: unreadable lines and lines that are no object count for nothing; null says that
the key is there but not its type; an empty list likewise; a repeated key keeps its last value;
a field whose type is unknown on either side is not reported as retyped; equally frequent types
resolve to the alphabetically first; files of equal time follow in order of file_id; the first
file of a feed has no change; lines delivered twice change nothing.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Collection, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lychnos.functions.schema import ARRAY_FIELDS
from lychnos.operators.neighbours import with_next
from lychnos.sources.tables import broadcast_if_small, shared_checkpoint

TEXT, NUMBER, BOOLEAN, OBJECT, TEXTS, OBJECTS = "text", "number", "true/false", "object", "list of texts", "list of objects"
#: Least cosine of two names' value profiles to call them one field.
SAME_FIELD = 0.5

#: Members that hold the content of an object, in order; its other members (rank, channel, ...) describe the content.
CONTENT = (("label",), ("name",), ("address",), ("main", "other"), ("first", "rest"))
#: The member that lists further items in one text, separated by commas.
PACKED = "other"

_COMMA = re.compile(r",\s+(?![^()]*\))")
#: Between the items of a list written as one text; not in brackets.
_BETWEEN = r";\s+(?![^()]*\))|\s+\|\s+"
_WORD = re.compile(r"[^\W\d_]{2,}")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_DATE = re.compile(r"\d{4}-\d\d-\d\d.*|\d{1,2}[./]\d{1,2}[./]\d{4}")
_PHONE = re.compile(r"[^\d]{0,12}\d{2,4}([ -]\d{2,4}){2,}")


def _leaves(v) -> list[str]:
    if isinstance(v, dict):
        return [t for x in v.values() for t in _leaves(x)]
    if isinstance(v, list):
        return [t for x in v for t in _leaves(x)]
    if v is None:
        return []
    if isinstance(v, bool):
        return ["true" if v else "false"]
    return [v if isinstance(v, str) else json.dumps(v)]


def _kind(v) -> str | None:
    if v is None or v == []:
        return None
    if isinstance(v, bool):
        return BOOLEAN
    if isinstance(v, int | float):
        return NUMBER
    if isinstance(v, str):
        return TEXT
    if isinstance(v, dict):
        return OBJECT
    return OBJECTS if any(isinstance(x, dict) for x in v) else TEXTS


def _parse(raw: str | None) -> dict | None:
    if not raw:
        return None
    try:
        got = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _text_features(t: str) -> frozenset:
    """What a single text looks like: contacts, dates, shape, words, sizes of numbers, signs."""
    if _DATE.fullmatch(t):
        return frozenset({"#date"})
    if t in ("true", "false"):
        return frozenset({"#bool"})
    masked = _DIGITS.sub("9", _LETTERS.sub("a", t)).split()
    out = set(zip(["^", *masked], [*masked, "$"], strict=True))  # shape: neighbouring masked words, so that long texts have no shape of their own
    mail, url = "@" in t, "://" in t
    if mail:
        out.add("#mail")
    if url:
        out.add("#url")
    if t.startswith("+") or _PHONE.fullmatch(t):
        out.add("#phone")
    if not mail and not url:
        out.update(w.casefold() for w in _WORD.findall(t))
        out.update(f"#n{len(n)}" for n in _DIGITS.findall(t))
        out.update(f"#{c}" for c in ("€", "%", "/", ".") if c in t)
        out.add(f"#words{min(6, len(t.split()))}")
    return frozenset(out)


_remembered = lru_cache(maxsize=100_000)(_text_features)


def _features(texts: list[str]) -> set:
    """The features of all texts of a value; short texts repeat, so theirs are kept."""
    return set().union(*(_remembered(t) if len(t) <= 200 else _text_features(t) for t in texts))


def line_counts(files: DataFrame) -> DataFrame:
    """One pass over the lines: ``(feed_id, file_id, exported_at, name, kind, n)`` rows, how many readable lines of a file have the name with that kind, and ``(name, feature, n)`` rows, how many values of the name have the feature.

    Counts are summed up in each task before they leave it, and again by the aggregations that follow.
    """
    kinds = dict(files.dtypes)
    cols = files.select("feed_id", "file_id", "exported_at", "raw_json")
    whole = ["feed_id", "file_id", "exported_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            seen: Counter = Counter()
            features: Counter = Counter()
            for key, raw in zip(ids, b.column(3).to_pylist(), strict=True):
                for name, v in (_parse(raw) or {}).items():
                    seen[(*key, name, _kind(v))] += 1
                    features.update((name, f) for f in _features(_leaves(v)))
            rows = [(*k, None, n) for k, n in seen.items()] + [(None, None, None, name, None, f if isinstance(f, str) else "#shape " + " ".join(f), n) for (name, f), n in features.items()]
            types = [*(b.schema.field(i).type for i in range(3)), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[*whole, "name", "kind", "feature", "n"])

    return cols.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in whole) + ", name string, kind string, feature string, n bigint")


def name_profiles(counts: DataFrame) -> DataFrame:
    """``(name, feature, weight)``: unit-length tf-idf profile of the values seen under each name, from :func:`line_counts`."""
    counts = counts.where(F.col("feature").isNotNull()).groupBy("name", "feature").agg(F.sum("n").alias("n"))
    counts = shared_checkpoint(counts)
    names = counts.select("name").distinct().count()
    df = counts.groupBy("feature").agg(F.count("*").alias("df"))
    total = counts.groupBy("name").agg(F.max("n").alias("top"))
    w = counts.join(df, "feature").join(total, "name")
    w = w.select("name", "feature", (F.col("n") / F.col("top") * F.log(F.lit(1.0 + names) / F.col("df"))).alias("w"))
    norm = w.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return shared_checkpoint(w.join(norm, "name").where("norm > 0").select("name", "feature", (F.col("w") / F.col("norm")).alias("weight")))


def file_schemas(counts: DataFrame) -> DataFrame:
    """``(feed_id, exported_at, file_id, fields)``: fused ``name -> (type, alternatives)`` of each file, names sorted, from :func:`line_counts`."""
    alt = counts.where(F.col("feature").isNull()).groupBy("feed_id", "file_id", "exported_at", "name", "kind").agg(F.sum("n").alias("n"))
    known = F.struct((-F.col("n")).alias("n"), F.col("kind").alias("kind"))
    per = alt.groupBy("feed_id", "file_id", "exported_at", "name").agg(
        F.min(F.when(F.col("kind").isNotNull(), known)).alias("best"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n")))).alias("alternatives"),
    )
    field = F.struct("name", F.col("best.kind").alias("kind"), "alternatives")
    return per.groupBy("feed_id", "file_id", "exported_at").agg(F.sort_array(F.collect_list(field)).alias("fields"))


def _similar(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(old_name, new_name, sim)`` of the given pairs of names."""
    a = profiles.select(F.col("name").alias("old_name"), "feature", F.col("weight").alias("wa"))
    b = profiles.select(F.col("name").alias("new_name"), "feature", F.col("weight").alias("wb"))
    dot = pairs.join(a, "old_name").join(b, ["new_name", "feature"])
    return dot.groupBy("old_name", "new_name").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))


def _best_partners(cand: DataFrame) -> DataFrame:
    """The pairs of ``cand`` that are each other's best partner, and again among the names left over, until none is left: the pairs of a step by falling ``sim``, each if both names are free."""
    pair = F.struct((-F.col("sim")).alias("d"), "old_name", "new_name")
    per = cand.groupBy("file_id").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sort_array(F.collect_list(pair)).alias("pairs"))  # names of two files
    free = lambda taken, p: ~F.exists(taken, lambda t: (t["old_name"] == p["old_name"]) | (t["new_name"] == p["new_name"]))
    start = F.array().cast("array<struct<old_name:string,new_name:string>>")
    taken = F.aggregate("pairs", start, lambda t, p: F.when(free(t, p), F.concat(t, F.array(F.struct(p["old_name"].alias("old_name"), p["new_name"].alias("new_name"))))).otherwise(t))
    return per.select("file_id", "a", "b", F.inline(taken))


def schema_changes(files: DataFrame) -> DataFrame:
    """``(file_id, change_kind, old_name, new_name)`` of each file against the previous one of its feed."""
    counts = shared_checkpoint(line_counts(files))  # each line is parsed once; what is kept are counts
    schemas = file_schemas(counts).withColumn("fields", F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["kind"].alias("kind"))))
    steps = with_next(schemas, ["feed_id"], ["exported_at", "file_id"], ["file_id", "fields"]).where(F.col("next_file_id").isNotNull())
    names = lambda c: F.transform(c, lambda f: f["name"])
    steps = steps.select(
        F.col("next_file_id").alias("file_id"),
        F.col("fields").alias("was"),
        F.col("next_fields").alias("now"),
        F.array_except(names("fields"), names("next_fields")).alias("gone"),
        F.array_except(names("next_fields"), names("fields")).alias("come"),
    )
    steps = shared_checkpoint(steps)
    kinds = lambda c: F.map_from_entries(F.filter(c, lambda f: f["kind"].isNotNull()))
    kept = steps.select("file_id", F.explode(F.array_intersect(names("was"), names("now"))).alias("old_name"), kinds("was").alias("a"), kinds("now").alias("b"))
    kept = kept.select("file_id", "old_name", F.col("old_name").alias("new_name"), F.try_element_at("a", F.col("old_name")).alias("ka"), F.try_element_at("b", F.col("old_name")).alias("kb"))

    pairs = steps.where("size(gone) > 0 and size(come) > 0").select("file_id", F.explode("gone").alias("old_name"), "come", kinds("was").alias("a"), kinds("now").alias("b"))
    pairs = pairs.select("file_id", "old_name", F.explode("come").alias("new_name"), "a", "b")
    sims = _similar(pairs.select("old_name", "new_name").distinct(), name_profiles(counts)).where(F.col("sim") >= SAME_FIELD)
    cand = pairs.join(broadcast_if_small(shared_checkpoint(sims)), ["old_name", "new_name"])
    mutual = _best_partners(cand)
    renamed = shared_checkpoint(mutual.select("file_id", "old_name", "new_name", F.try_element_at("a", F.col("old_name")).alias("ka"), F.try_element_at("b", F.col("new_name")).alias("kb")))

    gone = steps.select("file_id", F.explode("gone").alias("old_name")).join(renamed, ["file_id", "old_name"], "left_anti")
    come = steps.select("file_id", F.explode("come").alias("new_name")).join(renamed, ["file_id", "new_name"], "left_anti")
    empty = F.lit("")
    rows = [
        come.select("file_id", F.lit("added").alias("change_kind"), empty.alias("old_name"), "new_name"),
        gone.select("file_id", F.lit("removed").alias("change_kind"), "old_name", empty.alias("new_name")),
        renamed.select("file_id", F.lit("renamed").alias("change_kind"), "old_name", "new_name"),
        kept.unionByName(renamed).where("ka is not null and kb is not null and ka <> kb").select("file_id", F.lit("retyped").alias("change_kind"), "old_name", "new_name"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def canonical_names(files: DataFrame, schema_names: list[str]) -> DataFrame:
    """``(name, canonical)``: each name of the files, with the schema name whose values it shares, else itself."""
    profiles = name_profiles(line_counts(files))
    names = profiles.select("name").distinct()
    wanted = F.explode(F.array(*map(F.lit, schema_names)))
    pairs = names.where(~F.col("name").isin(schema_names)).select(F.col("name").alias("old_name"), wanted.alias("new_name"))
    best = _similar(pairs, profiles).where(F.col("sim") >= SAME_FIELD).groupBy("old_name").agg(F.max_by("new_name", F.struct("sim", "new_name")).alias("canonical"))
    return names.join(best, names["name"] == best["old_name"], "left").select("name", F.coalesce("canonical", "name").alias("canonical"))


def _nodes(v, path: str = "", at: str = "") -> Iterator[tuple[str, str, str | None, object]]:
    """``(path, place, kind, value)`` of a value and all its inner values; a place has the indices that a path leaves out."""
    yield path, at, _kind(v), v
    if isinstance(v, dict):
        for k, x in v.items():
            step = f".{k}" if re.fullmatch(r"\w+", k) else f"[{json.dumps(k, ensure_ascii=False)}]"
            yield from _nodes(x, path + step, at + step)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from _nodes(x, f"{path}[]", f"{at}[{i}]")


def _written(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _float(v) -> float | None:
    try:
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None
    except OverflowError:
        return None


def _parts(text: str) -> list[str]:
    return [x for p in _COMMA.split(text) if (x := p.strip())]


def _content(v) -> list[str]:
    """The content of a value in order; of an object without content members all leaf texts."""
    if isinstance(v, list):
        return [t for x in v for t in _content(x)]
    if not isinstance(v, dict):
        return _leaves(v)
    own = _content_members(v) or tuple(v)
    got = [t for k in own if k in v for t in (_parts(v[k]) if own == CONTENT[3] and k == PACKED and isinstance(v[k], str) else _content(v[k]))]
    return [t for t in got if t.strip()]


def _packed(v) -> str | None:
    """The text of several items in a value's member ``PACKED``."""
    other = v.get(PACKED) if isinstance(v, dict) and _content_members(v) == CONTENT[3] else None
    return other if isinstance(other, str) and len(_parts(other)) > 1 else None


def _content_members(v: dict) -> tuple[str, ...] | None:
    return next((c for c in CONTENT if c[0] in v), None)


def _members(v) -> list[tuple[str, str | None]] | None:
    return [(k, _written(x)) for k, x in v.items()] if isinstance(v, dict) else None


_MEMBERS = pa.map_(pa.string(), pa.string())
_LEAF = pa.struct([("path", pa.string()), ("place", pa.string()), ("kind", pa.string()), ("as_text", pa.string()), ("as_number", pa.float64()), ("as_boolean", pa.bool_())])
_TREES = pa.list_(pa.struct([
    ("name", pa.string()), ("kind", pa.string()), ("texts", pa.list_(pa.string())), ("packed", pa.string()), ("as_boolean", pa.bool_()),
    ("as_object", _MEMBERS), ("as_objects", pa.list_(_MEMBERS)), ("leaves", pa.list_(_LEAF)),
]))
_TREES_SQL = "array<struct<name:string,kind:string,texts:array<string>,packed:string,as_boolean:boolean,as_object:map<string,string>,as_objects:array<map<string,string>>,leaves:array<struct<path:string,place:string,kind:string,as_text:string,as_number:double,as_boolean:boolean>>>>"


def _tree(name: str, v) -> dict:
    kind, packed = _kind(v), _packed(v)
    leaves = [
        {"path": p, "place": at, "kind": k, "as_text": None if x == [] else _written(x), "as_number": _float(x), "as_boolean": x if isinstance(x, bool) else None}
        for p, at, k, x in _nodes(v) if not (isinstance(x, dict | list) and x)
    ]
    return {
        "name": name, "kind": kind, "texts": _content({k: x for k, x in v.items() if k != PACKED} if packed else v), "packed": packed,
        "as_boolean": v if kind == BOOLEAN else None, "as_object": _members(v), "as_objects": [_members(x) for x in v] if kind == OBJECTS else None, "leaves": leaves,
    }


def value_trees(files: DataFrame) -> DataFrame:
    """``(file_id, line_no, values)`` of the readable lines: kind, content, typed branches and tagged leaves of each name's value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if (o := _parse(raw)) is None else [_tree(k, v) for k, v in o.items()] for raw in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(got, _TREES)], names=["file_id", "line_no", "values"])

    kinds = dict(files.dtypes)
    out = files.select("file_id", "line_no", "raw_json").mapInArrow(run, f"file_id {kinds['file_id']}, line_no {kinds['line_no']}, values {_TREES_SQL}")
    return out.where(F.col("values").isNotNull())


def packed_items(files: DataFrame) -> DataFrame:
    """``(packed, items)`` of each distinct text under ``PACKED``: cut at its commas, but not within items that other values of the files write on their own."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = set()
            for raw in b.column(0).to_pylist():
                for v in (_parse(raw) or {}).values():
                    if text := _packed(v):
                        got.add((text, True))
                        v = {k: x for k, x in v.items() if k != PACKED}
                    if isinstance(v, dict | list):
                        got.update((t, False) for t in _content(v) if len(_parts(t)) > 1)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array([p for _, p in got], pa.bool_())], names=["text", "is_packed"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                parts = _parts(text)
                got = list({", ".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 2, len(parts) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([text] * len(got), pa.string()), pa.array(got, pa.string())], names=["packed", "run"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for text, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts, known, items, i = _parts(text), set(known or ()), [], 0
                while i < len(parts):
                    j = next((j for j in range(len(parts), i + 1, -1) if ", ".join(parts[i:j]) in known), i + 1)
                    items.append(", ".join(parts[i:j]))
                    i = j
                got.append(items)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.string()))], names=["packed", "items"])

    texts = shared_checkpoint(files.select("raw_json").mapInArrow(seen, "text string, is_packed boolean").distinct())
    packed = texts.where("is_packed").select(F.col("text").alias("packed"))
    whole = texts.where("not is_packed").select(F.col("text").alias("run"))
    known = packed.mapInArrow(runs, "packed string, run string").join(whole, "run").groupBy("packed").agg(F.collect_set("run").alias("known"))  # at most the runs of one text
    return packed.join(known, "packed", "left").mapInArrow(cut, "packed string, items array<string>")


def union_records(files: DataFrame, schema_names: list[str], array_names: Collection[str] = ARRAY_FIELDS) -> DataFrame:
    """The lines of all files as one table of tagged values under canonical names.

    ``(file_id, line_no, field_name, written_name, kind, as_text, as_list, as_number, as_boolean,
    as_object, as_objects, leaves)``. ``kind`` is the tag; ``as_boolean``, ``as_object`` and
    ``as_objects`` (an entry per element, null if it is no object) are filled for their kind alone,
    inner values that are no texts as JSON. ``leaves`` has every innermost value with its path, its
    place (the path with indices), its kind and its typed value. ``as_list`` and ``as_text`` are
    the value brought to the field's type, ``as_list`` as its items, ``as_text`` joining them (a
    text stays as written): of an object only the members in ``CONTENT``, and for the fields
    ``array_names`` a text is cut into its items. ``as_number`` is filled if the whole value is one
    number. A line delivered twice gives its rows once.
    """
    names = broadcast_if_small(shared_checkpoint(canonical_names(files, schema_names)))
    cuts = broadcast_if_small(shared_checkpoint(packed_items(files)))
    one = value_trees(files).dropDuplicates(["file_id", "line_no"]).select("file_id", "line_no", F.inline("values"))
    rows = one.join(names, "name").join(cuts, "packed", "left").withColumn("texts", F.concat("texts", F.coalesce("items", F.array().cast("array<string>"))))
    text = F.array_join("texts", "; ")
    apart = F.filter(F.split(F.try_element_at("texts", F.lit(1)), _BETWEEN), lambda t: F.trim(t) != "")
    items = F.when((F.col("kind") == TEXT) & F.col("canonical").isin(*array_names), apart).otherwise(F.col("texts"))
    return rows.select(
        "file_id", "line_no", F.col("canonical").alias("field_name"), F.col("name").alias("written_name"), "kind",
        F.when(F.col("kind").isNotNull(), text).alias("as_text"), items.alias("as_list"), text.try_cast("double").alias("as_number"),
        "as_boolean", "as_object", "as_objects", "leaves",
    )


def type_alternatives(files: DataFrame) -> DataFrame:
    """``(feed_id, name, path, kind, n_files, first_file_time)``: every alternative type a path ever had, and since when; the empty path is the named value itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for raw in b.column(3).to_pylist():
                kinds = {(name, p, k) for name, v in (_parse(raw) or {}).items() for p, _, k, _ in _nodes(v) if k is not None}
                got.append([{"name": n, "path": p, "kind": k} for n, p, k in kinds])
            kinds = pa.list_(pa.struct([("name", pa.string()), ("path", pa.string()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(got, kinds)], names=["feed_id", "file_id", "exported_at", "found"])

    types = dict(files.dtypes)
    cols = files.select("feed_id", "file_id", "exported_at", "raw_json")
    seen = cols.mapInArrow(run, f"feed_id {types['feed_id']}, file_id {types['file_id']}, exported_at {types['exported_at']}, found array<struct<name:string,path:string,kind:string>>")
    one = seen.select("feed_id", "file_id", "exported_at", F.inline("found")).distinct()
    return one.groupBy("feed_id", "name", "path", "kind").agg(F.count("*").alias("n_files"), F.min("exported_at").alias("first_file_time"))
