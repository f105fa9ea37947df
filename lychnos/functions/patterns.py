"""Contacts, dates, money and presence in a page, as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lychnos.functions.text import strip

# What counts as a mail address, telephone number, web address and currency sign.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+\d{1,3}\s?)?(?:\d[\s-]?){7,15}"
URL = r"https?://[^\s\)]+"
MONEY_TOKEN = r"[€$]|EUR|USD|euro|dollar"

_KINDS = (("email: ", EMAIL), ("phone: ", PHONE), ("", URL))


def found(text: Column, pattern: str) -> Column:
    """All matches, stripped, distinct, in code-point order."""
    hits = F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(hits, strip)))


def emails(text: Column) -> Column:
    return found(text, EMAIL)


def phones(text: Column) -> Column:
    return found(text, PHONE)


def urls(text: Column) -> Column:
    return found(text, URL)


def _labelled(label: str, hits: Column) -> Column:
    return F.transform(hits, lambda x: F.concat(F.lit(label), x))


def contacts(text: Column) -> Column:
    """``email: x``, then ``phone: x``, then bare web addresses; an empty list for null."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*(_labelled(label, found(text, p)) for label, p in _KINDS))


def present_in(value: Column, page: Column) -> Column:
    """Whether the page holds the value as it stands; never for an empty or missing value."""
    return F.coalesce(F.length(value) > 0, F.lit(False)) & F.coalesce(F.contains(F.coalesce(page, F.lit("")), value), F.lit(False))


def money_gate(value: Column, page: Column) -> Column:
    """The value if the page has any sign of money, or the value itself; else an empty string."""
    page = F.coalesce(page, F.lit(""))
    return F.when((F.length(value) > 0) & (page.rlike(f"(?i){MONEY_TOKEN}") | present_in(value, page)), value).otherwise(F.lit(""))


def entity_gate(value: Column, page: Column) -> Column:
    """The value if the page holds it; else an empty string."""
    return F.when(present_in(value, page), value).otherwise(F.lit(""))


def _slash_dates() -> list[str]:
    """Day and month of the dates that exist, by length of the month; leap days by their years."""
    long = r"(0[1-9]|[12]\d|3[01])/(0[13578]|1[02])/(\d{4})"
    short = r"(0[1-9]|[12]\d|30)/(0[469]|11)/(\d{4})"
    february = r"(0[1-9]|1\d|2[0-8])/(02)/(\d{4})"
    leap = r"(29)/(02)/(\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
    return [long, short, february, leap]


def iso_dates(text: Column) -> Column:
    """Every dd/mm/yyyy that is a calendar date becomes yyyy-mm-dd; others stay."""
    return reduce(lambda t, p: F.regexp_replace(t, rf"(?U)\b{p}\b", "$3-$2-$1"), _slash_dates(), text)
