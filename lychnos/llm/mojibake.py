"""Garbled text from wrong character encodings: found, attributed and restored.

A latent chain (written in one encoding, read in another) or none explains each record. Evidence is
counted per record for every chain: multi-byte sequences that only make sense when read back as
UTF-8, words whose letters make Greek when their bytes are read as Greek, foreign letters or signs
inside Latin words, replacement characters where text is lost for good. Garbled text mostly shows
evidence of several chains at once, so none is chosen beforehand: the *pattern* of a record is the
level of evidence (none, weak, some, many) of all chains.

Expectation-maximization estimates over all records how often each level of each chain's evidence
occurs under each explanation (one table for the field) and how common each explanation is in each
source (shrunk to the field). Weak evidence counts as much as its source and the rest of its
pattern make it credible. A record is garbled if the posterior of being clean is below one half; it
is repaired by its most probable chain, then judged again, until it is clean or nothing changes.

Records are pooled by source and pattern before the estimation; patterns are few, whatever the
number of records, so an iteration reads a small table and sends sums of fixed size to the driver.

One pattern search sorts out the records without any suspicious character; it runs in Python, where
it takes a tenth of what the JVM's regular expressions take for it.

Defined results: null, empty and blank texts are never garbled; a missing source is a source of its
own; lost characters stay lost (the text is repaired around them); text garbled twice or by several
chains is repaired step by step; repeated doc_ids are judged and repaired row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lychnos.sources.tables import broadcast_if_small, shared_checkpoint, spread_if_few

#: Encodings in which UTF-8 bytes may have been read.
UTF8_READ_AS = ("cp1252", "iso8859_7", "cp1253", "cp1251", "mac_roman", "cp1250", "cp437", "cp850", "cp737")
#: (written in, read in) of one-byte encodings.
GREEK_READ_AS = ("cp1252", "cp1251", "mac_roman", "cp1250")
LATIN_READ_AS = ("cp1251", "cp1253", "mac_roman")
CHAINS = (
    *(f"utf8>{e}" for e in UTF8_READ_AS),
    *(f"cp1253>{e}" for e in GREEK_READ_AS),
    *(f"cp1252>{e}" for e in LATIN_READ_AS),
    "mac_roman>cp1252",
    "cp1252>latin_1",
    "lost",
)
#: Levels of evidence: none, weak hits only, one strong hit (or many weak ones), several strong hits, strong hits and no chain has more.
NONE, WEAK, SOME, MANY, MOST = 0, 1, 2, 3, 4
#: Weak hits that count as a strong one.
MANY_WEAK = 4
#: Safety bound: reaching it is an error, not a result.
ROUNDS = 200

_GREEK = "".join(chr(c) for c in range(0x386, 0x3CF) if chr(c).isalpha())
_LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_TYPO = "€–—•²³»«’‘“”„…·§°±½ ­£©®¹º¼¾ªµ¿¡"
_ORDINARY = "€–•²»«’… äöüßÄÖÜçéàêâõèóúôáíÇÉ"
#: Greek words so common that one of them proves a reading as Greek.
_FUNCTION_WORDS = frozenset("και το του της την τον τα των τις τους με σε από για να που στο στη στην στον οι δεν είναι μια ένα θα έως μέσω κατά μετά πριν".split())
_GREEK_VOWELS = frozenset("αεηιουωάέήίόύώϊϋΐΰΑΕΗΙΟΥΩΆΈΉΊΌΎΏ")
_GREEK_ACCENTS = frozenset("άέήίόύώΐΰΆΈΉΊΌΎΏ")

SUSPICIOUS = (
    rf"[^\x00-\x7f΄-ώ{_ORDINARY}]"
    r"|[A-Za-zÀ-ÿ][Ͱ-Ͽ]|[Ͱ-Ͽ][A-Za-zÀ-ÿ]"
    r"|[A-ZÀ-Þ]Í|[a-z]í[a-z]|[ΞΟβ][ -¿Ά-Ώ€]|[a-z][ÁÈ-Ï][a-z]|Ä\d"
)

#: Evidence whose only foreign sign is an ordinary one; begins with one set of characters, so that the search is quick.
SUSPICIOUS_ORDINARY = (
    r"[Äí…€«–•](?:(?<=\d Ä)(?![a-z])|(?<=[a-z]í)(?= )|(?<=[A-Za-z][«–•…])(?=[a-zŒœ‹«√])|(?<=[A-Z][«…€])(?=[A-ZÌ«√])|(?<!\S…)(?<=…)(?=[a-z]))"
)


def _byte_table(enc: str) -> dict[int, int]:
    """Code point -> byte of ``enc``; bytes that ``enc`` leaves undefined stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ord(ch), b)
    if enc in ("cp1252", "cp1253", "cp1251", "cp1250", "iso8859_7"):
        for b in range(128, 256):
            out.setdefault(b, b) if b < 160 else None
    return out


class _Table(dict):
    def __missing__(self, key: int) -> int:
        return key if key < 128 else 0xFFFF


_TO_BYTES = {e: _Table(_byte_table(e)) for e in {*UTF8_READ_AS, *GREEK_READ_AS, *LATIN_READ_AS}} | {"latin_1": _Table({b: b for b in range(128, 256)})}
_MULTI = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_HIGH = re.compile(r"[^\x00-\x7f]{2,}")
_WORD = re.compile(r"[^\W\d_]*[^\x00-\x7f\s][^\x00-\x7f\s\d]*[^\W\d_]*")
_EXPECTED = frozenset(_GREEK + _LATIN + _TYPO + "ŒœŠšŽž™‰†‡‹›‚ƒ΄΅Ÿ​‍ →≥≤№₂☀️")


def _expected(ch: str) -> bool:
    return ch in _EXPECTED or 0x300 <= ord(ch) <= 0x328 or 0x400 <= ord(ch) <= 0x45F or 0x1F300 <= ord(ch) <= 0x1FAFF or 0x2000 <= ord(ch) <= 0x22FF or ord(ch) == 0xFFFD


def _reread(run: str, enc: str) -> tuple[str, int, int]:
    """A run of non-ASCII characters read back as UTF-8: new run, strong hits, weak hits."""
    b = run.translate(_TO_BYTES[enc])
    out, at, strong, weak = [], 0, 0, 0
    for m in _MULTI.finditer(b):
        try:
            ch = m.group().encode("latin-1").decode("utf-8")
        except UnicodeError:
            continue
        if not _expected(ch) and enc == "cp1252" and (ord(ch) < 0x100 or ord(ch) in _TO_BYTES[enc]):
            out.append(run[at : m.start()] + ch)  # one layer of text garbled twice: read back, but no evidence
            at = m.end()
            continue
        if not _expected(ch) or (ch == " " and enc not in ("cp1252", "cp1250", "cp437", "cp850", "mac_roman")):
            continue
        was = run[m.start() : m.end()]
        if all("Ά" <= c <= "ώ" and c.isalpha() for c in was) or (enc in ("cp1253", "iso8859_7", "cp737") and not was[0] in "ΒβΞΟΒΓ"):
            weak += 1
        else:
            strong += 1
        out.append(run[at : m.start()] + ch)
        at = m.end()
    out.append(run[at:])
    return "".join(out), strong, weak


def _as_greek(word: str, enc: str) -> tuple[str | None, bool]:
    """A word of high characters read as Greek bytes; None if it makes no Greek. And whether that is sure: a very common word, or one whose case only makes sense in Greek."""
    got = []
    for c in word:
        b = _TO_BYTES[enc].get(ord(c))
        if b is None:
            return None, False
        try:
            got.append(bytes([b]).decode("cp1253"))
        except UnicodeDecodeError:
            return None, False
    t = "".join(got)
    if not all(c in _GREEK for c in t):
        return None, False
    low = t.lower()
    if low in _FUNCTION_WORDS:
        return t, True
    ok = len(t) >= 4 and any(c in _GREEK_VOWELS for c in t) and sum(c in _GREEK_ACCENTS for c in t) <= 1 and (t[1:].islower() or t.isupper())
    case_break = ok and not word.isupper() and any(a.islower() and b.isupper() for a, b in zip(word, word[1:], strict=False))
    return (t if ok else None), case_break


_SPLIT = re.compile(r"[^\x00-\x7f\s«»()–·•… ]+")
_NAIVE = {
    "cp1251": re.compile(r"[A-Za-z][Ѐ-џ]|[Ѐ-џ][A-Za-z]|Ђ\d|\d[  ]?Ђ"),
    "cp1253": re.compile(r"[A-Za-z][Ά-ώ](?![Ά-ώ])|(?<![Ά-ώ])[Ά-ώ][a-z]"),
    "mac_roman": re.compile(
        r"[A-Za-z][„‚‰¸ˆ‡√«¬‹÷·˙ﬂﬁ][a-z«√]|[a-z][ÁÈËÍÌÛÙ][a-z]|[A-Z][«√¬À][«√A-Z]|m≤|Ä\d|\d Ä(?![a-z])|[a-z]í[a-z]?(?=[ts ])|(?:^|\n)ï |[A-Za-z]È(?![\w])|[a-z] ñ [a-z]|(?:^|\s)…[a-z]|[a-z] ‡ [a-z]"
    ),
}
_MAC_READ_AS_CP1252 = re.compile(r"[A-Za-z][ŸŠšŽ‹‡†§ˆ˜•–—‚ƒ„…œž\x8d\x8f\x90\x9d][a-zŒœ‹]|[A-Z][†…€‚ƒ„Ì][A-ZÌ]|[a-z]Õ[a-z ]|(?:^|\n)¥ |[a-z] Ð [a-z]|Û\d|\d Û(?!\w)|\bŽ |†brigens")
#: Control characters that no text holds on purpose; they stand for signs such as the euro.
_CONTROLS = re.compile(r"(?<![^\x00-\x7f])[\x80-\x84\x86-\x9f](?![^\x00-\x7f])")
_WEAK_MAC = re.compile(r"[a-z]í|[a-z] ñ ")


@lru_cache(maxsize=100_000)
def _run_evidence(run: str) -> tuple[tuple[str, int, int, int], ...]:
    """``(chain, strong or words, weak, sure words)`` for one run of non-ASCII characters; runs repeat, so results are kept."""
    out = []
    for enc in UTF8_READ_AS:
        _, s, w = _reread(run, enc)
        if s or w:
            out.append((f"utf8>{enc}", s, w, 0))
    words = [w for w in _SPLIT.findall(run) if w[0] not in _GREEK]
    for enc in GREEK_READ_AS if words else ():
        n = sure = 0
        for word in words:
            t, known = _as_greek(word, enc)
            n, sure = n + (t is not None), sure + known
        if n:
            out.append((f"cp1253>{enc}", n, 0, sure))
    return tuple(out)


def evidence(text: str) -> dict[str, tuple[int, int]]:
    """(strong, weak) hits of each chain in ``text``; chains without hits are left out."""
    total: dict[str, list[int]] = {}
    for run in _HIGH.findall(text):
        for chain, s, w, sure in _run_evidence(run) if len(run) <= 200 else _run_evidence.__wrapped__(run):  # long runs are not kept
            t = total.setdefault(chain, [0, 0, 0])
            t[0] += s
            t[1] += w
            t[2] += sure
    out = {}
    for chain, (s, w, sure) in total.items():
        if chain.startswith("utf8"):
            out[chain] = (s, w)
        else:
            out[chain] = (s, 0) if sure or s >= 2 else (0, s)
    for enc in LATIN_READ_AS:
        if hits := _NAIVE[enc].findall(text):
            weak = sum(bool(_WEAK_MAC.match(h)) for h in hits) if enc == "mac_roman" else 0
            out[f"cp1252>{enc}"] = (len(hits) - weak, weak)
    if hits := _MAC_READ_AS_CP1252.findall(text):
        out["mac_roman>cp1252"] = (len(hits), 0)
    if hits := _CONTROLS.findall(text):
        out["cp1252>latin_1"] = (len(hits), 0)
    if "�" in text:
        out["lost"] = (text.count("�"), 0)
    return out


def repair(text: str, chain: str) -> str:
    """``text`` with what ``chain`` garbled put right; text it did not touch stays."""
    if chain == "lost":
        return text
    wrote, read = chain.split(">")
    if wrote == "utf8":
        for _ in range(4):
            t = _HIGH.sub(lambda m: _reread(m.group(), read)[0], text)
            if t == text:
                return t
            text = t
        return text
    table = _TO_BYTES[read]
    back = {}
    for cp, b in table.items():
        try:
            back[cp] = bytes([b]).decode(wrote)
        except UnicodeDecodeError:
            pass
    parts = re.split(r"(?<=[.;:!?\n])(\s+)", text)
    bad: list[bool | None] = []
    for part in parts:
        if wrote == "cp1253":
            words = [w for r in _HIGH.findall(part) for w in _SPLIT.findall(r) if len(w) > 2]
            hit = sum(_as_greek(w, read)[0] is not None for w in words)
            bad.append(2 * hit >= len(words) if words else None)
        else:
            naive = _MAC_READ_AS_CP1252 if wrote == "mac_roman" else _CONTROLS if read == "latin_1" else _NAIVE[read]
            bad.append(True if naive.search(part) else False if any(c in _ORDINARY and c not in " " for c in part) else None)
    for order in (range(1, len(bad)), range(len(bad) - 2, -1, -1)):  # parts that tell nothing go with their neighbours
        for i in order:
            if bad[i] is None:
                bad[i] = bad[i - 1] if order.step == 1 else bad[i + 1]
    return "".join(p.translate(back) if b else p for p, b in zip(parts, bad, strict=True))


_CODE = {c: i for i, c in enumerate(CHAINS)}
#: Explanations: the chains in order, then clean text.
CLEAN = len(CHAINS)
_LEVELS = 5


def _level(strong: int, weak: int) -> int:
    return MANY if strong > 1 else SOME if strong or weak >= MANY_WEAK else WEAK if weak else NONE


_suspicious, _suspicious_ordinary = re.compile(SUSPICIOUS).search, re.compile(SUSPICIOUS_ORDINARY).search


def suspicious(text: str) -> bool:
    """A quick look whether any pattern of :func:`evidence` could be found."""
    return _suspicious(text) is not None or _suspicious_ordinary(text) is not None


def pattern(text: str) -> str:
    """The levels of evidence of all chains, one digit each; empty if there is no evidence."""
    if not suspicious(text):
        return ""
    levels = [NONE] * len(CHAINS)
    found = evidence(text)
    most = max((s + w for s, w in found.values()), default=0)
    for c, (s, w) in found.items():
        level = _level(s, w)
        levels[_CODE[c]] = MOST if level > WEAK and s + w == most else level
    return "".join(map(str, levels)) if any(levels) else ""


class Estimate(NamedTuple):
    """``rates[z, c, l]``: probability that explanation z shows level l of chain c's evidence; ``shares[z]``: how common z is in the field."""

    rates: np.ndarray
    shares: np.ndarray


#: Records that the prior counts as: of how a chain shows its own evidence, of what else is seen with it, and of the shares of a source.
PRIOR_OWN, PRIOR_CROSS, PRIOR_SOURCE = 200.0, 2.0, 20.0
#: What clean text may show of one chain at most: some, many, most. More is never learned, or a common chain would pass for clean text.
CLEAN_LIMITS = (1e-5, 1e-6, 1e-6)
#: Under a chain, another one shows the most evidence at most so often, or chains would trade places; and some at least so often (weak, some, many), since places of a text differ.
OTHERS_MOST, OTHERS_LEAST = 0.05, (1e-3, 1e-4, 1e-4)


def _prior() -> tuple[np.ndarray, np.ndarray]:
    """Rates assumed before any record is seen, and the records they count as: a chain shows its own evidence, most of all; others may show it too; clean text hardly ever does."""
    k = len(CHAINS)
    r, weight = np.empty((k + 1, k, _LEVELS)), np.full((k + 1, k, 1), PRIOR_CROSS)
    r[:k] = (0.94, 0.02, 0.02, 0.01, 0.01)
    r[range(k), range(k)] = (0.01, 0.1, 0.1, 0.1, 0.69)
    weight[range(k), range(k)] = PRIOR_OWN
    r[CLEAN] = (0.98 - sum(CLEAN_LIMITS), 0.02, *CLEAN_LIMITS)
    return r, weight


def _onehot(patterns: list[str]) -> np.ndarray:
    levels = np.array([[int(x) for x in p] for p in patterns])
    return np.eye(_LEVELS)[levels].reshape(len(patterns), -1)


def _log_likelihood(patterns: list[str], rates: np.ndarray) -> np.ndarray:
    """Of each pattern under each explanation. Weak evidence of several chains has one cause, an odd phrase, so of what is not the explanation's own only the least likely counts."""
    seen = _onehot(patterns).reshape(len(patterns), 1, *rates.shape[1:])
    none = np.log(rates[:, :, NONE])
    odds = (seen * (np.log(rates) - none[:, :, None])).sum(axis=3)  # pattern, explanation, chain
    loose = (seen[:, 0, :, WEAK] > 0)[:, None, :] & ~np.eye(*rates.shape[:2], dtype=bool)[None]
    return none.sum(axis=1) + np.where(loose, 0.0, odds).sum(axis=2) + np.where(loose, odds, 0.0).min(axis=2)


def posteriors(patterns: list[str], shares: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Probability of each explanation for each pattern."""
    log = _log_likelihood(patterns, rates) + np.log(shares)
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def source_shares(patterns: list[str], counts: np.ndarray, n: int, e: Estimate) -> np.ndarray:
    """How common each explanation is in a source of ``n`` records, at the fixed point for the given rates."""
    log = _log_likelihood(patterns, e.rates)
    like = np.exp(log - log.max(axis=1, keepdims=True))
    shares = e.shares
    for _ in range(ROUNDS):
        p = like * shares
        p /= p.sum(axis=1, keepdims=True)
        got = counts @ p
        got[CLEAN] += n - counts.sum()
        new = (got + PRIOR_SOURCE * e.shares) / (n + PRIOR_SOURCE)
        moved = float(np.abs(new - shares).max())
        shares = new
        if moved < 1e-7:
            return shares
    return shares  # the outer iteration goes on from here


_PATTERNS = pa.list_(pa.struct([("pattern", pa.string()), ("k", pa.int64())]))


def _read_source(row: list[dict], n: int, e: Estimate) -> tuple[list[str], np.ndarray, np.ndarray]:
    names, counts = [x["pattern"] for x in row], np.array([x["k"] for x in row], float)
    return names, counts, source_shares(names, counts, n, e)


def expected_counts(table: DataFrame, e: Estimate) -> tuple[np.ndarray, np.ndarray]:
    """Expected number of records by explanation and level, and by explanation, over the records with evidence."""
    shape = e.rates.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, total = np.zeros((shape[0], shape[1] * shape[2])), np.zeros(shape[0])
        for b in batches:
            for n, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names, counts, shares = _read_source(row, n, e)
                p = posteriors(names, shares, e.rates) * counts[:, None]
                levels += p.T @ _onehot(names)
                total += p.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(levels.ravel(), total).tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = table.select("n", "patterns").mapInArrow(run, "sums array<double>").toArrow().column(0).to_pylist()  # a row of fixed length per task
    sums = np.sum(parts, axis=0) if parts else np.zeros(shape[0] * (1 + shape[1] * shape[2]))
    return sums[: -shape[0]].reshape(shape), sums[-shape[0] :]


def estimate(table: DataFrame, n_all: int, rounds: int = ROUNDS) -> Estimate:
    """Rates and shares at the fixed point; an error if ``rounds`` rounds do not reach it."""
    prior, weight = _prior()
    k = len(CHAINS)
    e = Estimate(prior, np.append(np.full(k, 0.01 / k), 0.99))
    for _ in range(rounds):
        levels, total = expected_counts(table, e)
        total = total.copy()
        without = n_all - total.sum()
        total[CLEAN] += without  # records without evidence are clean
        levels[CLEAN, :, NONE] += without
        rates = (levels + weight * prior) / (total[:, None, None] + weight)
        rates[CLEAN, :, SOME:] = np.minimum(rates[CLEAN, :, SOME:], CLEAN_LIMITS)
        other = ~np.eye(k + 1, k, dtype=bool) & (np.arange(k + 1) != CLEAN)[:, None]
        rates[other, MOST] = np.minimum(rates[other, MOST], OTHERS_MOST)
        rates[other, WEAK:MOST] = np.maximum(rates[other, WEAK:MOST], OTHERS_LEAST)
        rates[:, :, NONE] = np.maximum(1 - rates[:, :, WEAK:].sum(axis=2), 1e-3)
        shares = (total + 0.1 * np.append(np.full(k, 1 / k), 1.0)) / (n_all + 0.2)
        moved = max(float(np.abs(shares - e.shares).max()), float(np.abs(rates - e.rates).max()))
        e = Estimate(rates, shares / shares.sum())
        if moved < 1e-5:
            return e
    raise RuntimeError(f"the shares of the chains did not converge in {rounds} rounds")


def _evidence_batches(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [pattern(t) for t in b.column(2).to_pylist()]
            at = pa.array([i for i, p in enumerate(got) if p], pa.int32())
            part = b.take(at)
            out = [part.column(0), part.column(1), pa.array([p for p in got if p], pa.string())]
            yield pa.RecordBatch.from_arrays([*out, part.column(2)] if keep_text else out, names=["id__", "source__", "pattern", *(["text__"] if keep_text else [])])

    return run


def judged_records(df: DataFrame, id_col: str, text_col: str, source_col: str, keep_text: bool = False, rounds: int = ROUNDS) -> tuple[DataFrame, Estimate]:
    """``(id__, source__, pattern[, text__], chain, posterior, clean, shares)`` for the records with any evidence, and the estimate.

    ``chain`` is the most probable chain, ``posterior`` its probability, ``clean`` that of clean
    text, ``shares`` how common each explanation is in the source.
    """
    kinds = dict(df.dtypes)
    base = df.select(F.col(id_col).alias("id__"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source__"), F.col(text_col).alias("text__")).where(F.col("text__").isNotNull())
    text = ", text__ string" if keep_text else ""
    seen = shared_checkpoint(spread_if_few(base).mapInArrow(_evidence_batches(keep_text), f"id__ {kinds[id_col]}, source__ string, pattern string{text}"))
    sizes = base.groupBy("source__").agg(F.count("*").alias("n"))
    pooled = seen.groupBy("source__", "pattern").agg(F.count("*").alias("k")).groupBy("source__").agg(F.collect_list(F.struct("pattern", "k")).alias("patterns"))  # the patterns of a source are few, however many its records
    table = shared_checkpoint(pooled.join(sizes, "source__"))
    n_all = max(1, sizes.agg(F.sum("n").alias("n")).first()["n"] or 1)
    e = estimate(table, n_all, rounds)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, n, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                names, _, shares = _read_source(row, n, e)
                p = posteriors(names, shares, e.rates)
                best = p[:, :CLEAN].argmax(axis=1)
                cols = [pa.array([source] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([CHAINS[i] for i in best], pa.string())]
                cols += [pa.array(p[range(len(names)), best]), pa.array(p[:, CLEAN]), pa.array([shares.tolist()] * len(names), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["source__", "pattern", "chain", "posterior", "clean", "shares"])

    said = shared_checkpoint(table.select("source__", "n", "patterns").mapInArrow(judge, "source__ string, pattern string, chain string, posterior double, clean double, shares array<double>"))
    return seen.join(broadcast_if_small(said), ["source__", "pattern"]), e


def garbled_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id_col, chain, posterior)`` of the records that some chain garbled."""
    return judged_records(df, id_col, text_col, source_col)[0].where("clean < 0.5").select(F.col("id__").alias(id_col), "chain", "posterior")


def repaired_text(text: str, chain: str, shares: np.ndarray, rates: np.ndarray) -> str:
    """``text`` repaired by ``chain``, then by the chain that explains what is left, until it is clean or no chain changes it."""
    closed: set[str] = set()
    for _ in range(2 * len(CHAINS)):
        better = repair(text, chain)
        if better == text:
            closed.add(chain)
        text = better
        left = pattern(text)
        if not left:
            break
        p = posteriors([left], shares, rates)[0]
        if p[CLEAN] >= 0.5:
            break
        chain = next((CHAINS[i] for i in np.argsort(-p[:CLEAN], kind="stable") if CHAINS[i] not in closed and left[i] != "0"), "")
        if not chain:
            break
    return text


def repaired_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id_col, chain, posterior, text_repaired)`` of the garbled records."""
    bad, e = judged_records(df, id_col, text_col, source_col, keep_text=True)
    kinds = dict(df.dtypes)
    rates = e.rates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [repaired_text(t, c, np.array(s), rates) for t, c, s in zip(*(b.column(i).to_pylist() for i in (4, 1, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(got, pa.string())], names=[id_col, "chain", "posterior", "text_repaired"])

    rows = bad.where("clean < 0.5").select("id__", "chain", "posterior", "shares", "text__")
    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, chain string, posterior double, text_repaired string")
