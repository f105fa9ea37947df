"""Several values packed in one field: split them by rules resolved once per delimiter skeleton.

A text is cut into tokens by one regular expression (JVM side). Every token is masked to one
character, so that texts that differ only in their ordinary characters share a *skeleton*:
delimiters, quotes, brackets and list marks stay, words become ``a``, e-mail addresses ``E``, web
addresses ``U``, telephone numbers ``P``, numbering ``N``. Python sees each distinct skeleton once
and resolves it to token spans; the spans are joined back (broadcast if their measured size allows
it, else only those of common skeletons, whose number is bounded) and the values are cut out by position, again on the JVM side.

Defined results: null, empty and blank texts give no row; empty pieces are dropped and not counted;
an unclosed quote or bracket is an ordinary character; repeated values stay as separate rows;
records delivered twice count once (the latest ``ingested_at``); other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lychnos.sources.tables import broadcast_if_small, fits_broadcast, shared_checkpoint

#: Blanks within a line: all of Unicode's space separators.
_SPACE = " \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_SPACES = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
_URL = rf"https?://[^\s{_SPACE};,|\"«»<>()\[\]{{}}•']+"
_MAIL = r"[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
_PHONE = r"\+\d{1,3}(?: \d{2,4}){2,4}|\d{3}-\d{3}-\d{4}"
_MARK = r"(?<![^\s;,|•'\"«])(?:\d{1,3}|\p{L})\)(?=\s)|(?<![^\s;,|•])\d{1,2}\.(?=\s)"
_ORD = rf"(?:\([^()\n]*\)|\d+,\d+|(?<=[\p{{L}}\p{{N}}])'(?=[\p{{L}}\p{{N}}])|[^\s{_SPACE};,|•·'\"«»“”„(){{}}\[\]])++"
_BULLET = rf"(?![-–•·*/](?:[{_SPACE}]|$))"
_STOP = rf"(?!(?:\p{{L}}[\p{{L}}.]{{1,14}}[:.] ?)?(?:{_URL}|{_MAIL}|{_PHONE})|{_URL}|{_MAIL}|{_PHONE}|{_MARK})"
_LABEL = r"\p{L}[\p{L}.]{1,14}[:.] ?"
TOKEN = rf"{_LABEL}(?:{_URL}|{_MAIL}|{_PHONE})|{_URL}|{_MAIL}|{_PHONE}|{_MARK}|{_BULLET}{_ORD}(?: {_STOP}{_BULLET}{_ORD})*+|[{_SPACE}]+|(?s:.)"

_SPECIAL = ";|,\n\t\r•·*/-–\"'«»“”„()[]{}"
_OPEN = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“", '"': '"'}
_QUOTES = {'"': '"', "«": "»", "“": "”", "„": "“"}
_BLANK = " \n\t\r"

SPANS = "array<struct<at:int,n:int>>"


def tokens(text: Column) -> Column:
    """All tokens of ``text`` in order; joined they give the text again."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def mask(token: Column) -> Column:
    """One character that stands for ``token`` in a skeleton."""
    first = F.substring(token, 1, 1)
    word = (
        F.when(token.rlike(rf"^(?:{_MARK})$") | token.rlike(r"^(?:\d{1,3}|\p{L})\)$|^\d{1,2}\.$"), F.lit("N"))
        .when(F.contains(token, F.lit("://")) & token.rlike(rf"^(?:{_LABEL})?https?://"), F.lit("U"))
        .when(F.contains(token, F.lit("@")) & token.rlike(rf"^(?:{_LABEL})?(?:{_MAIL})$"), F.lit("E"))
        .when(token.rlike(rf"^(?:{_LABEL})?(?:{_PHONE})$"), F.lit("P"))
        .otherwise(F.lit("a"))
    )
    return (
        F.when((F.length(token) == 1) & (F.instr(F.lit(_SPECIAL), token) > 0), token)
        .when(F.instr(F.lit(_SPACES), first) > 0, F.lit(" "))
        .otherwise(word)
    )


#: Contacts with nothing but spaces between them: only there it matters what kind of word a token is.
_LISTED = r"[EUP][\"»”]? [\"«“]?(?:[a ]*)[EUP]"
#: Quotes within quotes, or quotes that do not pair; elsewhere all kinds of quotes cut alike.
_NESTED = r'«[^»]*["“”«]|“[^”]*["«»“]|"[^"]*[«»“”][^"]*"|^[^"«“]*[»”]|„|«[^»]*$|“[^”]*$|^[^"]*"[^"]*(?:"[^"]*"[^"]*)*$'


def skeleton(toks: Column) -> Column:
    """The masks of all tokens. Contacts are plain words wherever delimiters already say what to cut; that keeps skeletons few."""
    full = F.array_join(F.transform(toks, mask), "")
    full = F.when(full.rlike(_NESTED), full).otherwise(F.translate(full, "«»“”", '""""'))
    return F.when(full.rlike(_LISTED), full).otherwise(F.translate(full, "EUP", "aaa"))


def _closers(s: str, lo: int, hi: int, singles: bool) -> dict[int, int]:
    """Position of the closing character for each opening one between ``lo`` and ``hi``."""
    out: dict[int, int] = {}
    stack: list[tuple[int, str]] = []
    i = lo
    while i < hi:
        c = s[i]
        if stack and c == stack[-1][1]:
            out[stack.pop()[0]] = i
        elif stack and stack[-1][1] in "\"'":
            pass  # inside plain quotes nothing opens
        elif c == '"' or (singles and c == "'"):
            if s.find(c, i + 1, hi) >= 0:
                stack.append((i, c))
        elif c in _OPEN:
            if s.find(_OPEN[c], i + 1, hi) >= 0:
                stack.append((i, _OPEN[c]))
        else:
            for k in range(len(stack) - 1, -1, -1):  # a closer of an outer level ends the inner ones
                if stack[k][1] == c and c in ")]}»”":
                    del stack[k + 1 :]
                    out[stack.pop()[0]] = i
                    break
        i += 1
    return out


def _strip(s: str, lo: int, hi: int) -> tuple[int, int]:
    while lo < hi and s[lo] in _BLANK:
        lo += 1
    while hi > lo and s[hi - 1] in _BLANK:
        hi -= 1
    return lo, hi


def _contact_cuts(s: str, a: int, b: int, close: dict[int, int]) -> list[int]:
    """Where a piece that lists contacts with nothing but spaces between them is cut further."""
    ends: list[tuple[int, int]] = []  # contacts, bare or in quotes of their own
    i = a
    while i < b:
        j = close.get(i, i)
        if j > i and s[i] in _QUOTES and any(c in "EUP" for c in s[i:j]):
            ends.append((i, j + 1))
        elif j == i and s[i] in "EUP":
            ends.append((i, i + 1))
        elif j > i:
            return []
        i = j + 1
    return [end for (_, end), (nxt, _) in zip(ends, ends[1:], strict=False) if s[end : end + 1] == " " and not s[end:nxt].strip(" a")]


def resolve(s: str) -> list[tuple[int, int]]:
    """Spans ``(first token from 1, number of tokens)`` of the values of a skeleton."""
    lo, hi = _strip(s, 0, len(s))
    literal = False
    if hi - lo >= 2 and s[lo] == "[" and s[hi - 1] == "]":
        a, b = _strip(s, lo + 1, hi - 1)
        if b - a >= 2 and s[a] in "\"'" and s[b - 1] == s[a]:
            literal, lo, hi = True, a, b
    close = _closers(s, lo, hi, literal)
    delimiters = ",\n\r" if literal else ";|,\n\t\r•·"
    pieces: list[tuple[int, int]] = []
    start = i = lo
    while i < hi:
        c = s[i]
        if i in close:
            i = close[i] + 1
            continue
        at_start = not s[start:i].strip(_BLANK)
        spaced = i + 1 >= hi or s[i + 1] in _BLANK
        is_cut = c in delimiters
        if not is_cut and not literal:
            if c == "N":
                is_cut = True
            elif c == "/":
                is_cut = spaced and (i == lo or s[i - 1] in _BLANK)
            elif c in "-–*":
                is_cut = at_start and spaced
        if is_cut:
            pieces.append((start, i))
            start = i + 1
        i += 1
    pieces.append((start, hi))
    quotes = {**_QUOTES, "'": "'"} if literal else _QUOTES
    out: list[tuple[int, int]] = []
    for a, b in pieces:
        cuts = [a, *([] if literal else _contact_cuts(s, a, b, close))]
        for x, y in zip(cuts, [*cuts[1:], b], strict=True):
            x, y = _strip(s, x, y)
            while x < y and s[x] in quotes and close.get(x) == y - 1:
                x, y = _strip(s, x + 1, y - 1)
            if x < y:
                out.append((x + 1, y - x))
    return out


def _resolve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
    for b in batches:
        got = [[{"at": a, "n": n} for a, n in resolve(k)] for k in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, spans)], names=["skeleton", "n", "spans"])


#: A skeleton of at least one in so many texts is common; there are at most so many of these.
COMMON = 10_000


def split_rules(skeletons: DataFrame) -> DataFrame:
    """One row per distinct ``skeleton`` with its ``spans`` and ``n``, the number of its texts."""
    counted = skeletons.groupBy("skeleton").agg(F.count("*").alias("n"))
    return counted.mapInArrow(_resolve_batches, f"skeleton string, n bigint, spans {SPANS}")


def with_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """``texts`` with the ``spans`` of their skeleton; ``rules`` is a checkpoint.

    Rules that fit are broadcast. Beyond that only those of common skeletons are, whose number is
    bounded; the rest is joined by a shuffle, in which no key is hot.
    """
    pick = rules.select("skeleton", "spans")
    if fits_broadcast(pick):
        return texts.join(F.broadcast(pick), "skeleton")
    total = rules.agg(F.sum("n").alias("n")).first()["n"]
    is_common = F.col("n") * COMMON >= total
    common = broadcast_if_small(rules.where(is_common).select("skeleton", "spans"))
    hot = texts.join(common, "skeleton", "left")
    rare = hot.where("spans is null").drop("spans").join(rules.where(~is_common).select("skeleton", "spans"), "skeleton")
    return hot.where("spans is not null").unionByName(rare)


def cut_values(toks: Column, spans: Column) -> Column:
    """The values that ``spans`` cut out of ``toks``."""
    return F.transform(spans, lambda x: F.array_join(F.slice(toks, x["at"], x["n"]), ""))


def split_packed(df: DataFrame, id_col: str, fields: list[str], version_col: str | None = None) -> DataFrame:
    """One row per single value: ``(id_col, field_name, pos, item_text)``.

    ``fields`` are STRING or ARRAY<STRING> columns; ``pos`` runs on across array elements. With
    ``version_col`` only the row of the greatest version of each id counts.
    """
    kinds = dict(df.dtypes)
    as_array = [F.col(f) if kinds[f].startswith("array") else F.array(F.col(f)) for f in fields]
    packed = F.array(*(F.struct(F.lit(f).alias("field_name"), a.alias("parts")) for f, a in zip(fields, as_array, strict=True)))
    base = df.select(F.col(id_col).alias("rid"), *([F.col(version_col).alias("v")] if version_col else []), packed.alias("packed"))

    def pieces(rows: DataFrame) -> DataFrame:
        one = rows.select("rid", F.inline("packed")).select("rid", "field_name", F.posexplode("parts").alias("part", "text"))
        one = one.where(F.col("text").isNotNull() & F.col("text").rlike(rf"[^\s{_SPACE}]"))
        return one.select("rid", "field_name", "part", tokens(F.col("text")).alias("toks"))

    rules = shared_checkpoint(split_rules(pieces(base).select(skeleton(F.col("toks")).alias("skeleton"))))
    if version_col:
        base = base.groupBy("rid").agg(F.max_by("packed", F.coalesce("v", F.lit("1900-01-01").cast("timestamp"))).alias("packed"))
    cut = with_rules(pieces(base).withColumn("skeleton", skeleton(F.col("toks"))), rules)
    cut = cut.select("rid", "field_name", "part", cut_values(F.col("toks"), F.col("spans")).alias("items"))
    if any(kinds[f].startswith("array") for f in fields):
        cut = cut.groupBy("rid", "field_name").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "items"))), lambda x: x["items"])).alias("items"))
    return cut.select(F.col("rid").alias(id_col), "field_name", F.posexplode("items").alias("pos", "item_text")).withColumn("pos", F.col("pos") + 1)
