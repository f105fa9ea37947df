"""Pages without finished content: a linear classifier on hashed n-grams, length and title features.

**Weak labels.** On a bounded number of pages (``LABELLED_PAGES``) patterns give labels: unfilled
placeholders, or status and notice phrases without running text beside them, say residue; pages
with neither, or with plenty of running text, say content; the rest stays out. The patterns serve
the training and the check below, and are no features.

**Features.** Presence of hashed word uni- and bigrams (digits masked), of the shapes of tokens that
hold signs (letters masked, so that no placeholder is known by name) with the word before, of
n-grams of the title line, and binned lengths, shares and counts of lines.

**Fit.** L2-regularized logistic regression, n-grams kept if seen on several hosts and unevenly in
the two labels; at most ``TRAIN_EACH`` pages of each label reach the driver, as hashes. Two tenths of
the hosts are not trained on and give the threshold (best F1 at the true share of the labels) and a
margin: ``SAFETY`` times how far from the threshold pages of these unseen hosts were on the wrong side. Another
tenth is neither trained on nor used to choose; ``validation`` reports on it.

**Decision.** Pages beyond the margin are decided by the score alone; within it, an exact check
follows: placeholders outside quotation of their names, or an error, script notice or filler and no
real body.

Defined results: null, empty and blank pages are no residue; pages of pure furniture are none;
repeated page_ids are judged row by row; if the sample lacks one of the labels there is nothing to
learn and every page is within the margin; if the unseen hosts lack one, the margin is ``WIDE``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lychnos.llm.blocks import is_furniture, is_residue, is_running, judged_blocks, learn_lines, line_record
from lychnos.sources.tables import shared_checkpoint, spread_if_few

#: Bounds of the training sample: pages that get a weak label (those of the smallest hashes), pages of label 0 and 1 that are trained on, features of one page.
LABELLED_PAGES = 40_000
TRAIN_EACH = (8000, 4000)
LARGEST_PAGE = 4000
#: Hash space of the features, and the weight of one shape or length feature against that of one n-gram.
BITS = 18
SHAPE = 4.0
#: Strength of the regularization; hosts an n-gram must be seen on; unevenness between the labels, in standard errors.
L2 = 1e-5
HOSTS = 3
UNEVEN = 2.0
#: Tenths of the hosts: two choose threshold and margin, one is for validation alone.
CHOOSE, UNSEEN, FOLDS = (0, 2), 1, 10
#: The margin is so many times the worst miss on unseen hosts, but for these shares of the pages of label 0 and 1, so that no single odd page widens it; where these hosts cannot tell it is ``WIDE``.
SAFETY = 2.0
EXCUSED = (0.0005, 0.005)
WIDE = 6.0

#: Pages that are scored together.
CHUNK = 1000

# ---------------------------------------------------------------- weak labels and the exact check

_NAME = r"[^\W\d_][\w.-]*"
_PLACEHOLDER = re.compile(
    rf"#?\{{\{{?\s*(?:{_NAME}|\d)\s*\}}?\}}|\$\{{\s*{_NAME}\s*\}}|<%.+?%>|\{{%.+?%\}}|@@\w+@@|%[A-Z][A-Z_]+%|__[A-Z][A-Z_]+__"
    rf"|\[object Object\]|\bX{{4,}}\b|_{{5,}}|\[\[{_NAME}\]\]|\[(?:insert|fill in|enter|συμπληρώστε|εισάγετε|bitte|hier)[^\[\]]+\]|\[{_NAME}\](?!_)|<{_NAME}>|\bundefined\b|\bNaN\b"
    rf"|&lt;{_NAME}&gt;|\$[A-Z][A-Z_]+\$|\((?:εδώ μπαίνει|hier steht|hier kommt|here goes)[^()]+\)|\([^()]+(?:goes here|kommt hierhin|hier einsetzen)\)|«[^«»]+[–-] ?(?:προς συμπλήρωση|to be filled in|to fill in|noch auszufüllen|bitte ergänzen)»"
)
_AS_SUCH = re.compile(r"(?:όπως|such as|wie|named|λέγεται|called)(?:\s+<[^<>]+>(?:\s+(?:και|and|und|,))?)*\s*$")


def placeholders(text: str) -> int:
    """Placeholders that stand for a value; names quoted as such, file name patterns and buttons do not count."""
    n = 0
    for m in _PLACEHOLDER.finditer(text):
        s = m.group()
        if s[0] in "<[" and _AS_SUCH.search(text[max(0, m.start() - 80) : m.start()]):
            continue
        if s[0] == "[" and s[1] not in "[o" and s[1].isupper():
            continue  # a button or an abbreviation
        n += 1
    return n


_SIGNS = ("{", "$", "@@", "__", "XXXX", "undefined", "NaN", "&lt;", "[[", "[insert", "[fill", "[enter", "[object", "[συμπ", "[εισ", "[bitte", "[hier", "<%", "εδώ μπαίνει", "συμπλήρωση", "goes here", "here goes", "(hier", "hier einsetzen", "kommt hierhin", "fill", "auszufüllen", "ergänzen")
_BARE = re.compile(r"[<\[][^\W\d_]|%[A-Z][A-Z_]")


def may_be_open(text: str) -> bool:
    """A quick look whether :func:`placeholders` could find any."""
    return any(map(text.__contains__, _SIGNS)) or _BARE.search(text) is not None


_STATUS = re.compile(r"\b(?:4\d\d|50\d)\b|0x[0-9a-f]+|\b(?:gateway|denied|unavailable|timed out|maintenance|exception|fatal|oops|parked|session)\b|σφάλμα|διακομιστής|συνεδρία|συντήρησης|ουπς|στραβά|zugriff|wartung|schief", re.I)


class _Facts(dict):
    """Line -> 1 for running text, 2 for a status or notice phrase, 3 for an open placeholder, 0 for the rest; furniture repeats, so they are kept."""

    def __missing__(self, line: str) -> int:
        if len(self) > 200_000:
            self.clear()
        kind = line_record(line)[0]
        if may_be_open(line) and placeholders(line):
            fact = 3
        elif is_residue(kind) or (not is_furniture(kind) and len(line) < 90 and _STATUS.search(line) is not None):
            fact = 2
        else:
            fact = int(is_running(kind) and not line.endswith("…"))
        if len(line) <= 1000:
            self[line] = fact
        return fact


_facts = _Facts()


def weak_label(text: str) -> int | None:
    """1 residue, 0 content, None undecided: from placeholder, status and phrase patterns and the amount of running text."""
    facts = [_facts[x] for p in text.split("\n") if (x := p.strip())]
    if 3 in facts:
        return 1
    if 2 not in facts:
        return 0
    running = facts[1:].count(1)
    return 1 if not running else 0 if running >= 3 else None


def exact_check(text: str) -> bool:
    """Whether placeholders stand where values belong, or an error, script notice or filler and no real body."""
    if any(_facts[x] == 3 for p in text.split("\n") if (x := p.strip())):
        return True
    residue = False
    for _, x, kind, body in judged_blocks(text):
        if body and is_running(kind):
            return False
        residue = residue or (is_residue(kind) and not x.endswith("…"))
    return residue


# ---------------------------------------------------------------- features

_DIM = 1 << BITS
_SIGNED = re.compile(r"[^\s\w.,;:!?'’()/–-]|_{2,}|(\w)\1{3,}")
_REPEATED = re.compile(r"(\w)\1{3,}")
_LETTERS = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\d+")
_SIGNS_OF_SHAPE = re.compile(r"[^\s\w.,;:!?'’/–-]+|_{2,}")


def _hash(*parts: str) -> int:
    return zlib.crc32(" ".join(parts).encode())


class _Words(dict):
    """Word -> (hash in lower case, hash of its shape with signs or 0, cells of its shape); words repeat, so they are kept."""

    def __missing__(self, word: str) -> tuple[int, int, tuple[int, ...]]:
        if len(self) > 300_000:
            self.clear()
        shape, cells = 0, ()
        if _REPEATED.search(word):
            shape, cells = _hash("#repeated"), (_hash("#shape", "repeated") % _DIM,)
        elif _SIGNED.search(word):
            s = _LETTERS.sub("a", word).strip(".,;:!?")
            shape = _hash("#shape", s)
            cells = (shape % _DIM, *(_hash("#signs", s[max(0, m.start() - 1) : m.end() + 1]) % _DIM for m in _SIGNS_OF_SHAPE.finditer(s)))
        got = _hash(word.lower()), shape, cells
        if len(word) <= 64:
            self[word] = got
        return got


_words = _Words()
_BINS = {k: [_hash(f"#{k}", str(v)) % _DIM for v in range(13)] for k in ("length", "lines", "long lines", "longest line", "sentences", "lines with numbers", "distinct words", "distinct in longest")}


def _flags(text: str, lines: list[str], words: list[str]) -> list[int]:
    """Cells of the binned lengths, shares and counts."""
    size = list(map(len, lines))
    longest = lines[size.index(max(size))].split()
    binned = (
        ("length", min(12, len(text) // 100)),
        ("lines", min(12, len(lines) // 2)),
        ("long lines", min(6, sum(n > 60 for n in size))),
        ("longest line", min(8, max(size) // 30)),
        ("sentences", min(6, sum(n > 40 and x[-1] in ".;!" for x, n in zip(lines, size, strict=True)))),
        ("lines with numbers", min(6, sum(n > 20 and "9" in x for x, n in zip(lines, size, strict=True)))),
        ("distinct words", 10 * len(set(words)) // len(words)),
        ("distinct in longest", 10 * len(set(longest)) // max(1, len(longest))),
    )
    return [_BINS[k][v] for k, v in binned]


def _distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; much quicker here than the library's hash table."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def page_features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of non-blank texts: page and cell of each distinct n-gram, page and cell of each distinct shape or length, sorted by page. With ``wanted``, a mask over the cells, only the n-grams in it."""
    ids: list[int] = []
    sizes, title = [], []
    shaped: list[tuple[int, int, int]] = []  # page, hash of a shape, hash of the word before
    flags: list[int] = []
    flag_sizes = []
    for page, text in enumerate(texts):
        masked = _NUMBER.sub("9", text)
        lines = [x for p in masked.split("\n") if (x := p.strip())]
        words = masked.split()
        info = list(map(_words.__getitem__, words))
        hashes = [x[0] for x in info]
        ids += hashes
        ids.append(0)
        sizes.append(len(hashes) + 1)
        title.append(len(lines[0].split()))
        own = _flags(text, lines, words)
        for i, (_, shape, more) in enumerate(info):
            if shape:
                shaped.append((page, shape, hashes[i - 1] if i else 0))
                own += more
        flags += own
        flag_sizes.append(len(own))
    h = np.array(ids, np.int64)
    page = np.repeat(np.arange(len(texts)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if texts else np.zeros(0, int)
    word = h != 0
    pair = word[:-1] & word[1:]
    in_title = (np.arange(len(h)) - starts[page]) < np.array(title)[page]
    s = np.array(shaped, np.int64).reshape(-1, 3)
    cells = [h[word], h[:-1][pair] * 1_000_003 + h[1:][pair] + 1, h[word & in_title] * 31 + 7, s[:, 1] * 1_000_003 + s[:, 2] + 5]
    owners = [page[word], page[:-1][pair], page[word & in_title], s[:, 0]]
    mixed, owner = np.concatenate(cells), np.concatenate(owners)
    cell = (mixed ^ (mixed >> 17)) & (_DIM - 1)
    if wanted is not None:
        keep = wanted[cell]
        cell, owner = cell[keep], owner[keep]
    grams = _distinct(owner * _DIM + cell)
    shapes = _distinct(np.repeat(np.arange(len(texts)), flag_sizes) * _DIM + np.array(flags, np.int64))
    return grams // _DIM, grams % _DIM, shapes // _DIM, shapes % _DIM


# ---------------------------------------------------------------- fit


def _minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 400, kept: int = 8) -> np.ndarray:
    """The minimum of a smooth convex function by limited-memory quasi-Newton steps; no randomness."""
    fx, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = g.copy(), []
        for s, y in reversed(steps):
            alphas.append((s @ d) / (y @ s))
            d -= alphas[-1] * y
        d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(steps, reversed(alphas), strict=True):
            d += s * (a - (y @ d) / (y @ s))
        t, slope = 1.0, g @ d
        while True:
            fn, gn = f(x - t * d)
            if fn <= fx - 1e-4 * t * slope or t < 1e-8:
                break
            t *= 0.5
        s, y = -t * d, gn - g
        x, gained, fx, g = x + s, fx - fn, fn, gn
        if gained < 1e-6 * max(1e-3, abs(fx)):
            break
        if y @ s > 1e-12:
            steps = [*steps, (s, y)][-kept:]
    return x


class Sample(NamedTuple):
    """A weakly labelled page: label, tenth of its host, hash of its host, features."""

    label: int
    fold: int
    host: int
    grams: np.ndarray
    flags: np.ndarray


class Model(NamedTuple):
    """Weights, bias, threshold and margin; ``fitted`` is false where a label was missing."""

    weights: np.ndarray
    bias: float
    threshold: float
    margin: float
    fitted: bool


def fit_weights(rows: list[Sample]) -> tuple[np.ndarray, float]:
    """Weights of the regularized regression; the labels weigh the same."""
    y = np.array([r.label for r in rows], float)
    pos, neg = y.sum(), len(y) - y.sum()
    owner = lambda parts: np.repeat(np.arange(len(rows)), list(map(len, parts)))
    grams, flags = [r.grams.astype(np.int64) for r in rows], [r.flags.astype(np.int64) for r in rows]
    idx, row = np.concatenate(grams), owner(grams)
    names = np.unique([r.host for r in rows], return_inverse=True)[1]
    seen = np.bincount(_distinct(idx * (names.max() + 1) + names[row]) // (names.max() + 1), minlength=_DIM)  # hosts of each cell
    a, b = np.bincount(idx, y[row], _DIM), np.bincount(idx, 1 - y[row], _DIM)
    p = (a + b) / len(y)
    uneven = np.abs(a / pos - b / neg) >= UNEVEN * np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / pos + 1 / neg))
    uneven &= seen >= min(HOSTS, names.max() + 1)
    grams = [g[uneven[g]] for g in grams]
    idx, row = np.concatenate(grams + flags), np.concatenate([owner(grams), owner(flags)])
    x = np.where(np.arange(len(idx)) < sum(map(len, grams)), 1.0, SHAPE)
    cells, at = np.unique(idx, return_inverse=True)
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, v[at] * x, len(rows)) + v[-1]
        total = float((weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + 0.5 * L2 * (v[:-1] @ v[:-1]))
        d = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        return total, np.append(np.bincount(at, d[row] * x, len(cells)) + L2 * v[:-1], d.sum())

    v = _minimum(loss, np.zeros(len(cells) + 1))
    w = np.zeros(_DIM)
    w[cells] = v[:-1]
    return w, float(v[-1])


def scores_of(weights: np.ndarray, bias: float, texts: list[str]) -> np.ndarray:
    page, gram, owner, shape = page_features(texts, weights != 0)
    return np.bincount(page, weights[gram], len(texts)) + SHAPE * np.bincount(owner, weights[shape], len(texts)) + bias


def sample_scores(weights: np.ndarray, bias: float, rows: list[Sample]) -> np.ndarray:
    return np.array([weights[r.grams].sum() + SHAPE * weights[r.flags].sum() + bias for r in rows])


def choose_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Threshold of the best F1 and how far from it a wrong page was; ``weights`` restore the true share of the labels."""
    order = np.argsort(scores, kind="stable")
    z, y, w = scores[order], labels[order], weights[order]
    hit = np.cumsum((w * y)[::-1])[::-1]
    f1 = 2 * hit / (np.cumsum(w[::-1])[::-1] + (w * y).sum())
    k = max(1, int(np.argmax(f1)))
    threshold = float((z[k - 1] + z[k]) / 2)
    missed = max(float(np.quantile(sign * (threshold - z[y == label]), 1 - EXCUSED[label])) for label, sign in ((0, -1), (1, 1)))
    return threshold, max(1.0, SAFETY * missed)


def fit_model(rows: list[Sample], share: tuple[float, float]) -> Model:
    """``share``: how many labelled pages each sampled page of label 0 and 1 stands for."""
    train = [r for r in rows if r.fold not in (*CHOOSE, UNSEEN)]
    if len({r.label for r in train}) < 2:
        return Model(np.zeros(_DIM), 0.0, 0.0, float("inf"), False)
    w, bias = fit_weights(train)
    held = [r for r in rows if r.fold in CHOOSE]
    if len({r.label for r in held}) < 2:
        return Model(w, bias, 0.0, WIDE, True)
    z = sample_scores(w, bias, held)
    y = np.array([r.label for r in held])
    return Model(w, bias, *choose_threshold(z, y, np.where(y == 1, share[1], share[0])), True)


def weakly_labelled(pages: DataFrame, text_col: str = "page_text", id_col: str = "page_id", host_col: str = "site_key") -> DataFrame:
    """``(h, host, label, grams, flags)`` of about ``LABELLED_PAGES`` pages, those of the smallest hashes of their ids."""
    total = pages.count()
    below = min(1.0, LABELLED_PAGES / max(1, total)) * 2.0**62
    h = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 2)
    host = F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit(""))) if host_col in pages.columns else F.xxhash64(F.lit(""), F.pmod(F.xxhash64(F.col(id_col)), F.lit(100)))
    picked = pages.where((h < F.lit(below)) & F.col(text_col).isNotNull() & (F.length(F.col(text_col)) > 0)).select(h.alias("h"), host.alias("host"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                texts = [t or "" for t in part.column(2).to_pylist()]
                learn_lines(x for t in texts for p in t.split("\n") if (x := p.strip()))
                labels = [weak_label(t) if t.strip() else None for t in texts]
                keep = [i for i, y in enumerate(labels) if y is not None]
                page, gram, owner, shape = page_features([texts[i] for i in keep])
                grams = np.split(gram, np.searchsorted(page, np.arange(1, len(keep)))) if keep else []
                flags = np.split(shape, np.searchsorted(owner, np.arange(1, len(keep)))) if keep else []
                small = [k for k in range(len(keep)) if len(grams[k]) + len(flags[k]) <= LARGEST_PAGE]
                at = pa.array([keep[k] for k in small], pa.int32())
                cols = [part.column(0).take(at), part.column(1).take(at), pa.array([labels[keep[k]] for k in small], pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([grams[k] for k in small], ints), pa.array([flags[k] for k in small], ints)], names=["h", "host", "label", "grams", "flags"])

    return spread_if_few(picked).mapInArrow(run, "h bigint, host bigint, label int, grams array<int>, flags array<int>")


def training_rows(pages: DataFrame, **columns: str) -> tuple[list[Sample], tuple[float, float]]:
    """The bounded training sample on the driver, and how many labelled pages each row of label 0 and 1 stands for."""
    labelled = shared_checkpoint(weakly_labelled(pages, **columns))  # about LABELLED_PAGES rows, of at most LARGEST_PAGE hashes each
    hashes = labelled.select("label", "h").toArrow()  # two numbers for each of about LABELLED_PAGES pages
    rows, share = [], []
    for label, most in enumerate(TRAIN_EACH):
        own = np.sort(hashes.column("h").to_numpy()[hashes.column("label").to_numpy() == label])
        below = int(own[most - 1]) if len(own) > most else 2**62
        got = labelled.where((F.col("label") == label) & (F.col("h") <= below)).select("h", "host", "grams", "flags").toArrow().sort_by([("h", "ascending"), ("host", "ascending")])
        host = got.column("host").to_pylist()
        parts = [[x.values.to_numpy() for x in got.column(c)] for c in ("grams", "flags")]
        rows += [Sample(label, h % FOLDS, h, g, f) for h, g, f in zip(host, *parts, strict=True)]
        share.append(len(own) / max(1, got.num_rows))
    return rows, (share[0], share[1])


# ---------------------------------------------------------------- decision


@lru_cache(maxsize=4)
def _unpacked(packed: bytes) -> np.ndarray:
    w = np.zeros(_DIM)
    idx = np.frombuffer(packed, np.int32, count=len(packed) // 8)
    w[idx] = np.frombuffer(packed, np.float32, offset=len(packed) // 2)
    return w


class Judge:
    """Decides pages with a broadcast model, on a worker."""

    def __init__(self, sent: tuple[bytes, float, float, float]) -> None:
        packed, self.bias, self.threshold, self.margin = sent
        self.weights = _unpacked(packed)

    def __call__(self, texts: list[str | None]) -> list[tuple[float, bool] | None]:
        """``(score, whether residue)`` of each text, None for null and blank ones."""
        at = [i for i, t in enumerate(texts) if t and t.strip()]
        z = scores_of(self.weights, self.bias, [texts[i] for i in at]) - self.threshold if at else np.zeros(0)
        near = np.abs(z) <= self.margin
        learn_lines(x for i, n in zip(at, near, strict=True) if n for p in texts[i].split("\n") if (x := p.strip()))
        out: list[tuple[float, bool] | None] = [None] * len(texts)
        for i, score, n in zip(at, z.tolist(), near, strict=True):
            out[i] = score, exact_check(texts[i]) if n else score > 0
        return out


def sent_model(m: Model) -> tuple[bytes, float, float, float]:
    keep = np.flatnonzero(np.abs(m.weights) > 1e-5).astype(np.int32)
    return keep.tobytes() + m.weights[keep].astype(np.float32).tobytes(), m.bias, m.threshold, m.margin  # at most 8 bytes per cell of the hash space


def broadcast_model(pages: DataFrame, text_col: str, id_col: str, host_col: str):
    m = fit_model(*training_rows(pages, text_col=text_col, id_col=id_col, host_col=host_col))
    return pages.sparkSession.sparkContext.broadcast(sent_model(m))


def residue_pages(pages: DataFrame, id_col: str = "page_id", text_col: str = "page_text", host_col: str = "site_key") -> DataFrame:
    """``(id_col, score)`` of the pages that offer no finished content; scores are relative to the threshold."""
    model = broadcast_model(pages, text_col, id_col, host_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model.value)
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                said = judge(part.column(1).to_pylist())
                bad = [i for i, x in enumerate(said) if x and x[1]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(bad, pa.int32())), pa.array([said[i][0] for i in bad], pa.float64())], names=[id_col, "score"])

    kind = dict(pages.dtypes)[id_col]
    return spread_if_few(pages.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")


def validation(pages: DataFrame, id_col: str = "page_id", text_col: str = "page_text", host_col: str = "site_key") -> DataFrame:
    """``(metric, value)`` of the very model that :func:`residue_pages` uses, on hosts neither trained on nor used to choose its threshold, against the weak labels; shares are those of all labelled pages."""
    rows, share = training_rows(pages, text_col=text_col, id_col=id_col, host_col=host_col)
    m = fit_model(rows, share)
    held = [r for r in rows if r.fold == UNSEEN]
    z = sample_scores(m.weights, m.bias, held) - m.threshold
    y = np.array([r.label for r in held], int)
    w = np.where(y == 1, share[1], share[0])
    said, alone = z > 0, np.abs(z) > m.margin

    def quality(name: str, use: np.ndarray) -> list[tuple[str, float]]:
        tp = float((w * y * said)[use].sum())
        return [(f"{name}_precision", tp / max(1e-9, float((w * said)[use].sum()))), (f"{name}_recall", tp / max(1e-9, float((w * y)[use].sum())))]

    out = [("threshold", m.threshold), ("margin", min(m.margin, 1e9)), ("unseen_pages", float(len(held))), ("unseen_residue", float(y.sum()))]
    out += [("decided_by_score_alone", float(w[alone].sum() / max(1e-9, w.sum()))), ("residue_decided_by_score_alone", float((w * y)[alone].sum() / max(1e-9, (w * y).sum())))]
    out += quality("classifier", np.ones(len(y), bool)) + quality("score_alone", alone)
    return pages.sparkSession.createDataFrame([(k, round(float(v), 6)) for k, v in out], "metric string, value double")
