"""Text expressions: Column in, Column out, inside whole-stage code generation.

Null stays null in every function here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and endings that decide about sentence ends.
HONORIFICS = ("Mr", "St", "Mrs", "Ms", "Dr")
COMPANY_SUFFIXES = ("Inc", "Ltd", "Jr", "Sr", "Co")
SENTENCE_STARTERS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Capt", "Cpt", "Lt", r"He\s", r"She\s", r"It\s", r"They\s", r"Their\s", r"Our\s", r"We\s", r"But\s", r"However\s", r"That\s", r"This\s", "Wherever")
SITE_ENDINGS = ("com", "net", "org", "io", "gov", "edu", "me")

#: Private-use characters: a dot that ends nothing, and a place to cut. Texts do not contain them.
KEPT_DOT, CUT = "\ue000", "\ue001"

_SPACE = r"[\s\x1c-\x1f\x85]"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often ``use`` needs it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _any(words: tuple[str, ...]) -> str:
    return "(" + "|".join(words) + ")"


def _dot_rules() -> list[tuple[str, str]]:
    """Contexts, in order, in which a dot is kept or forces a cut: (pattern, replacement)."""
    k, letter, start = KEPT_DOT, "([A-Za-z])", _any(SENTENCE_STARTERS)
    return [
        (rf"{_any(HONORIFICS)}[.]", f"$1{k}"),
        (rf"[.]{_any(SITE_ENDINGS)}", f"{k}$1"),
        (r"([0-9])[.]([0-9])", f"$1{k}$2"),
        (r"([.]{2,})", f"$1{CUT}"),
        (r"[.](?=[.])|(?<=[.])[.]", k),
        (r"Ph[.]D[.]", f"Ph{k}D{k}"),
        (rf"(?U)\s{letter}[.] ", f" $1{k} "),
        (rf"(?U)([A-Z][.][A-Z][.](?:[A-Z][.])?) {start}", f"$1{CUT} $2"),
        (rf"{letter}[.]{letter}[.]{letter}[.]", f"$1{k}$2{k}$3{k}"),
        (rf"{letter}[.]{letter}[.]", f"$1{k}$2{k}"),
        (rf"(?U) {_any(COMPANY_SUFFIXES)}[.] {start}", f" $1{CUT} $2"),
        (rf" {_any(COMPANY_SUFFIXES)}[.]", f" $1{k}"),
        (rf" {letter}[.]", f" $1{k}"),
        (r"([.])(”)", "$2$1"),
        (r'([.!?])(")', "$2$1"),
        (r"([.?!])", f"$1{CUT}"),
    ]


def sentences(c: Column) -> Column:
    """The sentences of a text, stripped. Only a last empty one is dropped; an empty text has none.

    Abbreviations, decimals, site names, acronyms and runs of dots do not end a sentence.
    """
    padded = F.concat(F.lit(" "), F.translate(c, "\n", " "), F.lit("  "))
    marked = reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), _dot_rules(), padded)
    parts = F.transform(F.split(F.translate(marked, KEPT_DOT, "."), CUT), strip)

    def without_last_blank(p: Column) -> Column:
        return F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)

    return F.when(c.isNotNull(), once(parts, without_last_blank))


def chunks(sents: Column, n: int) -> Column:
    """Groups of ``n`` consecutive sentences joined by a space; the last may be short."""
    if n < 1:
        raise ValueError("a chunk has at least one sentence")

    def cut(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(s) / n).cast("int") - 1, F.lit(0)))
        made = F.transform(starts, lambda i: F.array_join(F.slice(s, i * n + 1, n), " "))
        return F.when(F.size(s) > 0, made).otherwise(F.array().cast("array<string>"))

    return once(sents, cut)


def safe_name(url: Column) -> Column:
    """A file name for a URL: without scheme, with ``/ ? & =`` as underscores."""
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.translate(bare, "/?&=", "____")


def artifact_name(url: Column, at: Column, suffix: str) -> Column:
    """UTC time stamp, safe name and suffix; ``at`` is a timestamp in a UTC session."""
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), safe_name(url), F.lit(suffix))


def is_pdf_url(url: Column) -> Column:
    low = F.lower(url)
    return F.endswith(low, F.lit(".pdf")) | F.contains(low, F.lit("content-type=application/pdf"))


def truncated(c: Column, limit: int = 10_000, empty: str = "Website could not be read") -> Column:
    """At most ``limit`` characters; a null or empty text gives ``empty``."""
    return F.coalesce(F.when(F.length(c) > 0, F.substring(c, 1, limit)), F.lit(empty))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
