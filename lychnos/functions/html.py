"""Text of HTML pages: native expressions, and a parser where nesting decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lychnos.functions.text import strip

NO_TITLE, NO_DESCRIPTION = "No title found", "No description found"
_ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    """The common named entities; ``&amp;`` last, so nothing is unescaped twice."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ENTITIES, c)


def _visible(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->", "")


def text_nodes(html: Column) -> Column:
    """Stripped non-empty text nodes in order."""
    parts = F.transform(F.split(html, r"(?s)<[/!?A-Za-z][^>]*>"), lambda x: strip(unescape(x)))
    return F.filter(parts, lambda x: x != "")


def body_text(html: Column) -> Column:
    """All text of the body without separator; null if there is no body. An unclosed body reaches to the end."""
    body = F.regexp_extract(_visible(html), r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1)
    return F.when(html.rlike(r"(?i)<body\b"), F.array_join(text_nodes(body), ""))


def needs_scripts(html: Column) -> Column:
    """Whether the page wants a browser: its first noscript speaks of ``enable``, or its body is empty."""
    notice = F.regexp_extract(html, r"(?is)<noscript\b[^>]*>(.*?)</noscript\s*>", 0)
    return F.contains(notice, F.lit("enable")) | (F.coalesce(body_text(html), F.lit("")) == "")


def page_info(url: Column, html: Column) -> Column:
    """``struct(url, title, description)``, null for a page that could not be read."""
    title = F.when(html.rlike(r"(?i)<title\b"), unescape(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))).otherwise(F.lit(NO_TITLE))
    meta = F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\bname\s*=\s*["']description["'])[^>]*>""", 0)
    content = F.when(meta.rlike(r"(?i)\bcontent\s*="), unescape(F.regexp_extract(meta, r"""(?is)\bcontent\s*=\s*(["'])(.*?)\1""", 2)))
    described = F.when(meta == "", F.lit(NO_DESCRIPTION)).otherwise(content)
    return F.when(html.isNotNull() & described.isNotNull(), F.struct(url.alias("url"), title.alias("title"), described.alias("description")))


# Elements that are no main text, by tag, selector and name parts.
PRUNED_TAGS = ("script", "style", "noscript", "header", "footer", "nav", "form")
PRUNED_CLASSES = ("site-header", "site-footer", "footer", "header")
PRUNED_IDS = ("footer", "header")
NAME_PARTS = ("cookie", "consent")
CLASS_PARTS = ("banner", "popup", "modal")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Pruner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[tuple[str, bool]] = []

    def _dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        got = {k: v or "" for k, v in attrs}
        css, ident = got.get("class", ""), got.get("id", "")
        return (
            tag in PRUNED_TAGS
            or tag == "template"
            or not set(css.split()).isdisjoint(PRUNED_CLASSES)
            or ident in PRUNED_IDS
            or any(p in css or p in ident for p in NAME_PARTS)
            or any(p in css for p in CLASS_PARTS)
        )

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            inside = bool(self.stack) and self.stack[-1][1]
            self.stack.append((tag, inside or self._dropped(tag, attrs)))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if (not self.stack or not self.stack[-1][1]) and (t := data.strip()):
            self.out.append(t)


def prune(html: str | None) -> str | None:
    """Text of a page without furniture elements, nodes joined by a space; the title stays."""
    if html is None:
        return None
    p = _Pruner()
    p.feed(html)
    p.close()
    return " ".join(p.out)


@F.pandas_udf(StringType())
def pruned_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """:func:`prune` over Arrow batches; nested elements need a stack, which no regular expression has."""
    for b in batches:
        yield b.map(prune)
