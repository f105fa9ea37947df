"""Flat text blocks of web pages, and a decision tree that says body or furniture.

A page is a sequence of lines (flat text blocks). The texts have no mark-up, so the *link density* of
a block is estimated: a naive-Bayes scorer over its words, fitted to the labelled lines, gives the
probability that the block belongs to menus, tools, notices, footers or error texts. The entries of a
run of teasers and the window title are links throughout, the page's own title is none. The features
of a block are its word count and link density and those of both neighbours. A decision tree (CART,
Gini) over these is trained on the blocks of the labelled sample of pages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from lychnos.llm.labelled_pages import LABELLED_PAGES
from lychnos.llm.page_labels import FURNITURE, LABELLED_LINES, ORGANISATION_WORDS, RESIDUE

KINDS = tuple(LABELLED_LINES)
_K = {k: i for i, k in enumerate(KINDS)}
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[©»«|·>←→…\[\]@@:]|://")
DIGITS = re.compile(r"0x[0-9a-f]+|\b(?=[a-f]*\d)[0-9a-f]{6,}\b|\d+")
_NAMES = frozenset({"w", "v", "wweg"})
_NUMBER = re.compile(r"\d+")
_ANY_DIGIT = re.compile(r"\d").search
_MAYBE_CODE = re.compile(r"[a-f]\d|\d[a-fx]").search


def mask_digits(text: str) -> str:
    """Numbers and hexadecimal codes as ``9``; a quick look tells whether a code could be there."""
    if not _ANY_DIGIT(text):
        return text
    return DIGITS.sub("9", text) if _MAYBE_CODE(text) else _NUMBER.sub("9", text)


def _line_tokens(line: str) -> list[str]:
    toks = _TOKEN.findall(line.lower())
    n = len(toks)
    toks.append(f"#n{0 if n <= 2 else 1 if n <= 4 else 2 if n <= 8 else 3}")
    if line.endswith("."):
        toks.append("#.")
    return toks


@lru_cache(maxsize=1)
def _line_model() -> tuple[dict[str, int], np.ndarray]:
    """Word -> row; log-probability ratios per row and kind."""
    counts: list[dict[str, int]] = [{} for _ in KINDS]
    for k, lines in LABELLED_LINES.items():
        for line in lines:
            for t in _line_tokens(line):
                if t not in _NAMES:
                    counts[_K[k]][t] = counts[_K[k]].get(t, 0) + 1
    vocab = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    total = np.array([sum(c.values()) for c in counts], float)
    table = np.array([[c.get(t, 0) + 0.05 for c in counts] for t in vocab]) / (total + 0.05 * len(vocab))
    return vocab, np.log(table / table.mean(axis=1, keepdims=True))


@lru_cache(maxsize=1)
def _common_words() -> dict[str, int]:
    """Words of the labelled lines that hold running text."""
    return dict.fromkeys((t for k in ("sentence", "notice", "item", "error", "script") for line in LABELLED_LINES[k] for t in line.lower().split()), 1)


_FURN = frozenset(_K[k] for k in FURNITURE)
_RESI = frozenset(_K[k] for k in RESIDUE)
_TITLE, _ITEM, _SENT, _TEASER, _TRAIL, _FILL = (_K[k] for k in ("title", "item", "sentence", "teaser_head", "trail", "filler"))
_LINKS = np.array(sorted(_FURN | _RESI))
# names are unknown words: bodies and titles are full of them, fixed phrases are not
_PER_UNKNOWN = np.zeros(len(KINDS))
_PER_UNKNOWN[[_K[k] for k in ("menu", "tool", "teaser_head", "heading", "script", "error")]] = 1.6
_PER_UNKNOWN[_FILL], _PER_UNKNOWN[_K["notice"]] = 2.0, 1.2
_PER_FURTHER = np.zeros(len(KINDS))
_PER_FURTHER[[_K[k] for k in ("footer", "title", "item", "trail", "advert")]] = 0.8


_records: dict[str, tuple[int, int, float, bool]] = {}
#: Lines and characters that are kept at most, however long the lines.
_MOST_LINES, _MOST_CHARS = 200_000, 30_000_000
_held = [0]


def learn_lines(lines: Iterable[str]) -> None:
    """Judge stripped lines that are not known yet, all in one matrix sum; ``line_record`` then finds them."""
    if len(_records) > _MOST_LINES or _held[0] > _MOST_CHARS:
        _records.clear()
        _held[0] = 0
    vocab, ratios = _line_model()
    known = vocab.get
    open_: list[tuple[str, list[str], bool]] = []
    rows: list[int] = []
    sizes: list[int] = []
    unknown: list[int] = []
    for line in dict.fromkeys(lines):
        if line in _records:
            continue
        _held[0] += len(line)
        written = line.split()
        if _CRUMB.match(line) and " " in line:
            _records[line] = (_TRAIL, len(written), 1.0, line.endswith("…"))
            continue
        bullet = line[0] in "-–•*·" and line[1:2] == " "
        text = line[2:].lstrip() if bullet else line
        toks = _line_tokens(mask_digits(text))
        found = [r for t in toks if (r := known(t)) is not None]
        open_.append((line, written, bullet))
        rows += found
        rows.append(0)  # no sum is empty; taken off again
        sizes.append(len(found) + 1)
        unknown.append(len(toks) - len(found))
    if not open_:
        return
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    strange = np.array(unknown, float)[:, None]
    score = np.add.reduceat(ratios[rows], starts) - ratios[0] - strange * _PER_UNKNOWN - np.maximum(0.0, strange - 3) * _PER_FURTHER
    score[:, _SENT] += 1.5
    p = np.exp(score - score.max(axis=1, keepdims=True))
    links = np.round(p[:, _LINKS].sum(axis=1) / p.sum(axis=1), 3).tolist()
    common = _common_words()
    for (line, written, bullet), kind, link in zip(open_, score.argmax(axis=1).tolist(), links, strict=True):
        n, cut = len(written), line.endswith("…")
        if n > 5 and not cut and kind not in _FURN and kind not in _RESI and not _ANY_DIGIT(line) and sum(w in common for w in line.lower().split()) < 0.1 * n and sum(w[0].isupper() for w in written) < 0.3 * n:
            _records[line] = (_FILL, n, 1.0, False)  # running text without a common word
        elif bullet and kind != _SENT:
            _records[line] = (_ITEM, n, 0.0, cut)
        else:
            _records[line] = (kind, n, link, cut)


def line_record(line: str) -> tuple[int, int, float, bool]:
    """``(kind, words, link density, cut off)`` of a stripped line."""
    got = _records.get(line)
    if got is None:
        learn_lines([line])
        got = _records[line]
    return got


# ---------------------------------------------------------------- block features

FEATURES = ("words", "link", "prev_words", "prev_link", "next_words", "next_link")
_SEPARATED = re.compile(r" [|–-] ")
_CRUMB = re.compile(r"(?:Αρχική|Home|Startseite|Accueil|Início) [»>/] ")


def _window_title(lines: list[str]) -> tuple[int, str]:
    """Index of the window title among the first lines, or -1, and the own title that it repeats."""
    for i, line in enumerate(lines[:3]):
        for m in _SEPARATED.finditer(line):
            head, org = line[: m.start()].rstrip(), line[m.end() :].strip()
            if len(org) < 4 or line[0] == "©":
                continue
            if head in lines[i + 1 :]:
                return i, head
            if not ORGANISATION_WORDS.isdisjoint(org.split()) or any(x[0] == "©" and org in x for x in lines[i + 1 :]):
                return i, ""
    return -1, ""


def block_features(lines: list[str]) -> tuple[list[tuple], list[int]]:
    """The features of each non-blank stripped line, and its kind."""
    learn_lines(lines)
    info = [_records[x] for x in lines]
    n = len(lines)
    window, own = _window_title(lines)
    inside = [False] * n
    open_, first = False, -1
    for i, (k, _, _, cut) in enumerate(info):
        if k == _TEASER:
            open_ = True
        elif open_ and (k == _TITLE or cut) and (lines[i] != own or first >= 0):
            inside[i] = True
        else:
            open_ = False
            if first < 0 and i != window and (lines[i] == own if own else k == _TITLE):
                first = i
    dense = [(words, 1.0 if inside[i] or i == window else 0.0 if i == first else link) for i, (_, words, link, _) in enumerate(info)]
    edge = (0, 1.0)
    rows = [(*dense[i], *(dense[i - 1] if i else edge), *(dense[i + 1] if i + 1 < n else edge)) for i in range(n)]
    return rows, [x[0] for x in info]


# ---------------------------------------------------------------- decision tree

MAX_DEPTH = 6
LEAST_LEAF = 5


def grow(x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH) -> tuple:
    """A tree ``(feature, cut, below, above)`` with leaves ``(share of body,)``; of equal cuts of a feature the one in the widest gap."""
    p = float(y.mean()) if len(y) else 0.0
    if depth == 0 or p in (0.0, 1.0) or len(y) < 2 * LEAST_LEAF:
        return (p,)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        left, nl = np.cumsum(t)[:-1], np.arange(1, len(t))
        gap = v[1:] - v[:-1]
        pl, pr = left / nl, (t.sum() - left) / (len(t) - nl)
        g = (nl * pl * (1 - pl) + (len(t) - nl) * pr * (1 - pr)) / len(t)
        g = np.where((gap > 0) & (nl >= LEAST_LEAF) & (len(t) - nl >= LEAST_LEAF), g, np.inf)
        i = int(np.lexsort((-gap, np.round(g, 9)))[0])
        if g[i] < (p * (1 - p) if best is None else best[0]) - 1e-9:
            best = (float(g[i]), f, float((v[i] + v[i + 1]) / 2))
    if best is None:
        return (p,)
    _, f, cut = best
    m = x[:, f] <= cut
    return (f, cut, grow(x[m], y[m], depth - 1), grow(x[~m], y[~m], depth - 1))


def decide(tree: tuple, row: tuple) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def tree_text(tree: tuple, depth: int = 0) -> str:
    """The tree as indented lines."""
    pad = "  " * depth
    if len(tree) == 1:
        return f"{pad}body {tree[0]:.2f}"
    return f"{pad}{FEATURES[tree[0]]} <= {tree[1]:g}\n{tree_text(tree[2], depth + 1)}\n{pad}else\n{tree_text(tree[3], depth + 1)}"


def labelled_pages() -> list[tuple[str, list[str], list[bool]]]:
    """``(site, blocks, whether each is body)`` of the labelled sample of pages."""
    out = []
    for part in LABELLED_PAGES.strip().split("\n\n"):
        site, *lines = part.split("\n")
        out.append((site, [x[2:] for x in lines], [x[0] == "+" for x in lines]))
    return out


def fit_tree(pages: list[tuple[str, list[str], list[bool]]]) -> tuple:
    rows = [r for _, lines, _ in pages for r in block_features(lines)[0]]
    return grow(np.array(rows, float), np.array([b for _, _, body in pages for b in body], float))


@lru_cache(maxsize=1)
def block_tree() -> tuple:
    return fit_tree(labelled_pages())


def held_out_sites(folds: int = 3) -> tuple[int, int, int, int]:
    """Blocks of the labelled sample on sites that the tree was not fitted to: (right body, right furniture, wrong body, missed body)."""
    fold = lambda site: zlib.crc32(site.encode()) % folds
    pages = labelled_pages()
    n = [0, 0, 0, 0]
    for k in range(folds):
        tree = fit_tree([p for p in pages if fold(p[0]) != k])
        for _, lines, body in (p for p in pages if fold(p[0]) == k):
            for row, is_body in zip(block_features(lines)[0], body, strict=True):
                said = decide(tree, row) >= 0.5
                n[0 if said and is_body else 1 if not said and not is_body else 2 if said else 3] += 1
    return tuple(n)


def is_running(kind: int) -> bool:
    """Whether lines of this kind hold programme text."""
    return kind in (_SENT, _ITEM)


def is_residue(kind: int) -> bool:
    return kind in _RESI


def is_furniture(kind: int) -> bool:
    return kind in _FURN


@lru_cache(maxsize=100_000)
def _is_body(row: tuple) -> bool:
    return decide(block_tree(), row) >= 0.5


def split_blocks(text: str) -> tuple[list[int], list[str]]:
    """Line numbers from 1 and stripped texts of the non-blank lines."""
    pieces = text.split("\n")
    at = [i for i, p in enumerate(pieces) if p.strip()]
    return [i + 1 for i in at], [pieces[i].strip() for i in at]


def judged_blocks(text: str) -> list[tuple[int, str, int, bool]]:
    """``(line number, line, kind, whether body)`` of the blocks of a page."""
    at, lines = split_blocks(text)
    rows, kinds = block_features(lines)
    return [(i, x, k, _is_body(r)) for i, x, k, r in zip(at, lines, kinds, rows, strict=True)]


def body_lines(text: str) -> list[int]:
    """Line numbers of the main body of a page that is no residue."""
    return [i for i, _, _, body in judged_blocks(text) if body]
