"""Quantities recorded in different units, brought to whole euro and basis points.

A multi-pattern automaton (Aho-Corasick over all unit aliases) runs over each text, the longest
match at a place wins, and the aliases near a number (at most ``NEAR_WORDS`` words and no other
number between) say its scale and unit. What an alias may mean depends on the field: a percentage is
no amount, a currency is no rate, square metres and years are neither. Of several numbers the first
with a unit of the field's kind near it counts, else the first with a scale, else the first that
stands bare; the first number of a range shares the unit and scale of the second. A bare amount
takes the unit that a note in the record states (``Amounts are in thousand EUR.``), else euro. The
operator yields number and unit; the conversion factors are then joined from a small table
(broadcast after its size was measured) and applied in exact decimals.

Defined results: null, blank, stand-in or number-free texts give no row; text in brackets is
ignored; a point or comma before exactly three digits groups thousands in amounts, otherwise it is
the decimal sign; in rates a sign is always decimal; a bare rate with three or more decimals is a
fraction, otherwise per cent; a number next to a currency sign, a currency code or another unit that
no alias knows is no bare number; unknown currencies give no row; written numbers are read to ten
decimals, rounded half up; what does not fit a BIGINT gives no row; rounding is half up.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lychnos.functions.text import once
from lychnos.sources.tables import broadcast_if_small

AMOUNT_FIELDS = ("minimum_funding_amount", "maximum_funding_amount", "total_budget")
RATE_FIELDS = ("interest_rate",)
#: Where notes on units are looked for: every text field that is no quantity.
NOTE_COLUMNS = ("description", "programme_objective", "funding_coverage", "application_process", "additional_details")
#: Words that may stand between a number and its unit.
NEAR_WORDS = 2

#: alias -> (kind, meaning); kind "u" is a unit, "s" a power of ten, "us" both. Keys are casefolded.
ALIASES: dict[str, tuple[str, str, int]] = {}


def _add(kind: str, unit: str, scale: int, *names: str) -> None:
    for n in names:
        ALIASES[n.casefold()] = (kind, unit, scale)


_add("u", "EUR", 0, "€", "eur", "euro", "euros", "ευρώ", "ευρω")
_add("u", "USD", 0, "$", "us$", "usd", "us dollar", "us dollars", "dollar", "dollars", "δολάρια", "δολάρια ηπα", "δολάριο")
_add("u", "GBP", 0, "£", "gbp", "pound sterling", "pounds sterling", "pounds", "στερλίνες", "λίρες στερλίνες", "λίρες αγγλίας")
_add("u", "CHF", 0, "chf", "swiss franc", "swiss francs", "ελβετικά φράγκα", "fr.", "sfr")
_add("u", "SEK", 0, "sek", "swedish krona", "swedish kronor", "σουηδικές κορώνες", "κορώνες σουηδίας")
_add("u", "NOK", 0, "nok", "norwegian krone", "norwegian kroner", "νορβηγικές κορώνες", "κορώνες νορβηγίας")
_add("u", "DKK", 0, "dkk", "danish krone", "danish kroner", "δανικές κορώνες", "κορώνες δανίας")
_add("u", "PLN", 0, "pln", "zł", "zl", "polish zloty", "zloty", "zlotys", "złoty", "ζλότι", "ζλότι πολωνίας")
_add("u", "BGN", 0, "bgn", "лв.", "лв", "лева", "lv.", "bulgarian lev", "bulgarian leva", "leva", "λέβα", "λέβα βουλγαρίας")
_add("s", "", 3, "k", "thousand", "thousands", "tsd.", "tsd", "τ.", "χιλ.", "χιλ", "χιλιάδες", "χιλιάδων", "tausend", "mille", "milliers", "mil", "milhares")
_add("s", "", 6, "m", "mn", "mln", "mio.", "mio", "million", "millions", "εκ.", "εκατ.", "εκατ", "εκατομμύρια", "εκατομμύριο", "εκατομμυρίων", "millionen", "milhão", "milhões")
_add("s", "", 9, "bn", "mrd", "mrd.", "billion", "billions", "δισ.", "δισ", "δισεκατομμύρια", "δισεκατομμύριο", "milliarde", "milliarden", "milliard", "milliards", "mil milhões")
_add("us", "EUR", 3, "keur", "k€", "€k", "teur", "t€")
_add("us", "EUR", 6, "meur", "m€", "€m", "mio€")
_add("us", "EUR", -2, "cent", "cents", "euro cents", "λεπτά", "λεπτά του ευρώ")
_add("r", "percent", 0, "%", "percent", "per cent", "pct", "τοις εκατό", "τοις εκατο", "prozent", "pour cent", "por cento")
_add("r", "permille", 0, "‰", "per mille", "permille", "τοις χιλίοις")
_add("r", "bp", 0, "bp", "bps", "basis point", "basis points", "μονάδες βάσης", "μονάδα βάσης", "μ.β.", "basispunkte")

# units that are neither money nor a rate; a number next to one is no bare number
_add("x", "", 0, "ft", "kč", "kr", "kr.", "lei", "руб", "руб.", "m²", "m2", "sqm", "τ.μ.", "τμ", "kw", "kwh", "mwh", "km", "kg", "°c", "year", "years", "month", "months", "day", "days")
_add("x", "", 0, "έτη", "έτος", "χρόνια", "μήνες", "μηνών", "ημέρες", "jahre", "monate", "tage", "ans", "mois", "jours", "anos", "meses", "dias", "participants", "persons", "homes", "άτομα", "κατοικίες")

#: Basis points per unit of a rate.
RATE_FACTORS = {"percent": "100", "permille": "10", "bp": "1", "fraction": "10000"}

_NUMBER = re.compile(r"\d+(?:[.,'’ ]\d{3}(?!\d))*(?:[.,]\d+)?")
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_EXACT = Context(prec=200)
_SEPARATORS = re.compile(r"[ '’]")
_SPACES = re.compile(r"[\u00a0\u2007\u2009\u202f\t]")
_RANGE = re.compile(r"\s*(?:-|–|—|to|έως|ως|μέχρι|bis|à|até|a)\s*")
_WORDS = re.compile(r"[^\W\d_]+")
#: A currency code or sign, before or after a number; those that an alias has are no strangers.
_CODE_BEFORE, _CODE_AFTER = re.compile(r"(?<![^\W_])([A-Z]{3})\s?$"), re.compile(r"^\s?([A-Z]{3})(?![^\W_])")
DECIMALS, WHOLE_DIGITS = 10, 18


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for name in ALIASES:
        a.add_word(name, name)
    a.make_automaton()
    return a


def unit_matches(text: str) -> list[tuple[int, int, str]]:
    """Longest non-overlapping aliases in the casefolded ``text``, on word boundaries, left to right."""
    found = []
    for end, name in _automaton().iter(text):
        lo, hi = end + 1 - len(name), end + 1
        if name[0].isalpha() and lo and text[lo - 1].isalpha():
            continue
        if name[-1].isalpha() and hi < len(text) and (text[hi].isalpha() or text[hi] in "²³"):
            continue
        found.append((lo, hi, name))
    found.sort(key=lambda m: (m[0], -m[1]))
    out: list[tuple[int, int, str]] = []
    for m in found:
        if not out or m[0] >= out[-1][1]:
            out.append(m)
    return out


def _written(number: str, grouped: bool) -> tuple[str, str]:
    """Whole digits and decimals of a written number."""
    s = _SEPARATORS.sub("", number)
    groups = re.split(r"[.,]", s)
    if len(groups) == 1 or (grouped and len(groups[-1]) == 3):
        return "".join(groups), ""
    return "".join(groups[:-1]), groups[-1]


def _shifted(whole: str, part: str, power: int) -> str | None:
    """The decimal text of a number times a power of ten, or None if it is too large."""
    value = Decimal(f"{whole or '0'}.{part or '0'}").scaleb(power, _EXACT).quantize(Decimal(1).scaleb(-DECIMALS), ROUND_HALF_UP, _EXACT)
    return f"{value:f}" if value < 10**WHOLE_DIGITS else None


def note_unit(note: str | None) -> tuple[str, int] | None:
    """Unit and scale stated by a note sentence."""
    if not note:
        return None
    unit, scale = "", 0
    for _, _, name in unit_matches(note.casefold()):
        kind, u, s = ALIASES[name]
        if kind in "rx":
            continue
        unit, scale = unit if unit and u in ("", "EUR") else (u or unit), scale or s
    return (unit or "EUR", scale) if unit or scale else None


def _near(gap: str) -> bool:
    return not any(c.isdigit() for c in gap) and len(_WORDS.findall(gap)) <= NEAR_WORDS


def _stranger(before: str, after: str) -> bool:
    """Whether a currency sign or code that no alias knows stands next to a number."""
    signs = [c for c in (before.rstrip()[-1:], after.lstrip()[:1]) if c and unicodedata.category(c) == "Sc"]
    codes = [m.group(1) for m in (_CODE_BEFORE.search(before), _CODE_AFTER.search(after)) if m]
    return any(x.casefold() not in ALIASES for x in signs + codes)


@lru_cache(maxsize=200_000)
def read_quantity(text: str, rate: bool, note: str | None) -> tuple[str, str] | None:
    """``(decimal text, unit)`` of a text, its scale applied, or None if it states no quantity."""
    plain = _BRACKETS.sub(" ", _SPACES.sub(" ", text))
    s = plain.casefold()
    cased = plain if len(plain) == len(s) else s  # folding may change lengths; codes are then not told by their case
    numbers = list(_NUMBER.finditer(s))
    if not numbers:
        return None
    matches = unit_matches(s)
    read: list[list] = []  # number, unit, scale, whether it stands bare
    for num in numbers:
        unit, scale, bare = "", 0, not _stranger(cased[: num.start()], cased[num.end() :])
        for lo, hi, name in sorted(matches, key=lambda m: num.start() - m[1] if m[1] <= num.start() else m[0] - num.end()):
            gap = s[hi : num.start()] if hi <= num.start() else s[num.end() : lo]
            if not _near(gap):
                continue
            kind, u, p = ALIASES[name]
            if kind == "x" or (kind == "r") != rate:
                bare = bare and bool(unit or scale or gap.strip())
                continue
            unit, scale = unit or u, scale or p
        read.append([num, unit, scale, bare])
    for a, b in zip(reversed(read[:-1]), reversed(read[1:]), strict=True):
        if not a[1] and _RANGE.fullmatch(s[a[0].end() : b[0].start()]):
            a[1:] = [b[1], a[2] or b[2], a[3] and b[3]]
    num, unit, scale, bare = next((r for r in read if r[1]), None) or next((r for r in read if r[2]), None) or next((r for r in read if r[3]), read[0])
    whole, part = _written(num.group(), grouped=not rate)
    if not unit and not scale:
        if not bare:
            return None
        unit, scale = ("fraction" if len(part) >= 3 else "percent", 0) if rate else note_unit(note) or ("EUR", 0)
    value = _shifted(whole, part, scale)
    return None if value is None else (value, unit or "EUR")


_OUT = pa.schema([("record_id", pa.int64()), ("field_name", pa.string()), ("written", pa.string()), ("unit", pa.string())])


def _read_batches(fields: list[tuple[str, bool, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = dict(zip(b.schema.names, b.columns, strict=True))
            ids = col["rid"].to_pylist()
            rows: list[list] = [[] for _ in _OUT]
            version = []
            for field, rate, note_col in fields:
                notes = col[note_col].to_pylist() if note_col else None
                for i, text in enumerate(col[field].to_pylist()):
                    read = read_quantity if text and len(text) <= 200 else read_quantity.__wrapped__  # long texts are not kept
                    if text and (q := read(text, rate, notes[i] if notes else None)):
                        for out, v in zip(rows, (ids[i], field, *q), strict=True):
                            out.append(v)
                        version.append(i)
            cols = [pa.array(r, f.type) for r, f in zip(rows, _OUT, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, col["version"].take(pa.array(version, pa.int32()))], names=[*_OUT.names, "version"])

    return run


def _note(text: Column, low: Column, topics: str, parts: tuple[str, ...]) -> Column:
    units = r"€|\b(?:EUR|USD|GBP|CHF|SEK|NOK|DKK|PLN|BGN)\b|(?:thousand|million|billion)s?\b|χιλιάδ|χιλ\.|εκατομμ|δισεκατομμ|euro|ευρώ|tausend|millionen|milliers?\b|\bmil\b|milhões"
    sentence = rf"(?iu)(?:^|[.!?\n]|\d\S*)\s*([^.!?\n\d]*?(?:{topics})[^\d!?\n]*?(?:\.(?=\s|$)|$|(?=\n)))"
    might = reduce(Column.__or__, (F.contains(low, F.lit(p)) for p in parts))
    stated = F.filter(F.regexp_extract_all(text, F.lit(sentence), F.lit(1)), lambda x: x.rlike(f"(?iu){units}"))
    return F.when(might, F.coalesce(F.try_element_at(stated, F.lit(1)), F.lit(""))).otherwise(F.lit(""))


def note_columns(columns: list[str], *notes: tuple[str, str, tuple[str, ...]]) -> Column:
    """A struct of notes, each ``(name, topics, parts)``: the first digit-free sentence of ``columns`` that speaks of ``topics`` and names a unit, or an empty string.

    ``parts`` are pieces of the topic words in lower case; a text that holds none of them in any
    case is not searched. Text and lower case are made once for all notes.
    """
    text = F.concat_ws("\n", *(F.col(f"`{c}`") for c in columns))
    return once(text, lambda t: once(F.lower(t), lambda low: F.struct(*(_note(t, low, topics, parts).alias(name) for name, topics, parts in notes))))


BUDGET_TOPIC, BUDGET_PARTS = r"budget|προϋπολογισμ", ("budget", "προϋπολογισμ")
ALL_TOPIC = r"\b(?:amounts|sums|figures|prices|beträge|summen|preise|montants|sommes|montantes|valores|quantias)\b|\bποσά\b|χρηματικές τιμές"
ALL_PARTS = ("amounts", "sums", "figures", "prices", "beträge", "summen", "preise", "montants", "sommes", "montantes", "valores", "quantias", "ποσά", "τιμέ")


def normalised_quantities(df: DataFrame, fx_rates: DataFrame, id_col: str = "record_id", version_col: str = "ingested_at") -> DataFrame:
    """``(record_id, field_name, amount_norm)`` for the fields of ``df`` that state a quantity.

    ``fx_rates`` has currency_code and eur_per_unit. Of repeated deliveries of a row the greatest
    ``version_col`` counts, if there is such a column, else the greatest amount.
    """
    amounts = [f for f in AMOUNT_FIELDS if f in df.columns]
    rates = [f for f in RATE_FIELDS if f in df.columns]
    notes = [c for c in NOTE_COLUMNS if c in df.columns]
    has = reduce(Column.__or__, (F.coalesce(F.col(f).rlike(r"\d"), F.lit(False)) for f in amounts + rates), F.lit(False))
    both = note_columns(notes, ("all", ALL_TOPIC, ALL_PARTS), ("budget", BUDGET_TOPIC, BUDGET_PARTS))  # without columns both are empty
    version = F.coalesce(F.col(version_col).cast("timestamp"), F.lit("1900-01-01").cast("timestamp")) if version_col in df.columns else F.lit("1900-01-01").cast("timestamp")
    rows = df.where(has).select(F.col(id_col).cast("bigint").alias("rid"), *amounts, *rates, both.alias("notes"), version.alias("version"))
    rows = rows.withColumn("note_all", F.col("notes.all")).withColumn("note_budget", F.when(F.col("notes.budget") != "", F.col("notes.budget")).otherwise(F.col("notes.all"))).drop("notes")
    fields = [(f, False, "note_budget" if f == "total_budget" else "note_all") for f in amounts] + [(f, True, "") for f in rates]
    read = rows.mapInArrow(_read_batches(fields), "record_id bigint, field_name string, written string, unit string, version timestamp")

    factors = broadcast_if_small(conversion_factors(fx_rates))
    joined = read.join(factors, "unit")
    value = F.round(F.col("written").cast(f"decimal({WHOLE_DIGITS + DECIMALS},{DECIMALS})") * F.col("factor"), 0).try_cast("bigint")
    latest = joined.select("record_id", "field_name", value.alias("amount"), "version").groupBy("record_id", "field_name").agg(F.max(F.struct("version", "amount"))["amount"].alias("amount_norm"))
    return latest.where(F.col("amount_norm").isNotNull())


def conversion_factors(fx_rates: DataFrame) -> DataFrame:
    """``(unit, factor)``: euro or basis points per written unit."""
    rates = fx_rates.sparkSession.createDataFrame(list(RATE_FACTORS.items()), "unit string, rate string")
    base = fx_rates.select(F.upper("currency_code").alias("unit"), F.col("eur_per_unit").cast("string").alias("rate")).unionByName(rates)
    return base.dropDuplicates(["unit"]).select("unit", F.col("rate").try_cast("decimal(15,8)").alias("factor")).where(F.col("factor").isNotNull())
