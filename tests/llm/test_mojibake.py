import numpy as np
import pytest

from lychnos.llm import mojibake as m
from lychnos.llm.mojibake import evidence, garbled_documents, judged_records, pattern, repair, repaired_documents, repaired_text

GREEK = "Ο φάκελος κατατίθεται στο Ταμείο και εξετάζεται μέσα σε 40 εργάσιμες – το ίδιο ισχύει έως 5 €."
FRENCH = "Rénover à Chênelle : le contrôle porte sur 51 m² dès réception."
GERMAN = "Für Schulen gilt eine eigene Liste, außer in Süßental, über 3 Häuser."

RIGHT = [
    "“A” ‘b’ ‹c› CO₂ № 7 ±0,5 K ½ Å Æ ® ñ 👩‍🔧 → ☀️ ≥ 9", "Îndrumar Ăvan. Ãrea Ñu, Łomek Žur, Ï. Ÿvan", "Иларово, Ђуро και άλλα", "ÂMBITO DA AÇÃO: habitações", "ΧΑΜΗΛΉΣ ΚΑΤΑΝΆΛΩΣΗΣ ΚΤΊΡΙΑ «ΞΈΝΙΑ»", "café decomposed",
    "† ‡ ˆ ˜ ƒ 30 µm ¬ 4‰ „wie besehen“ (Œuvre n° 3) 9.\xad", GREEK, FRENCH, GERMAN, "", " ", None, "plain",
]


def wrong(text, wrote, read):
    out = ""
    for b in text.encode(wrote, errors="replace"):
        try:
            out += bytes([b]).decode(read)
        except UnicodeDecodeError:
            out += chr(b)
    return out


CHAINS = [(GREEK, "utf8", r) for r in ("cp1252", "latin-1", "cp1253", "iso8859_7", "cp1251", "mac_roman", "cp1250", "cp437", "cp850")] + [
    (GREEK, "cp1253", "cp1252"), (GREEK, "cp1253", "cp1251"), (FRENCH, "utf8", "cp1252"), (FRENCH, "cp1252", "cp1253"), (FRENCH, "cp1252", "cp1251"), (FRENCH, "cp1252", "mac_roman"), (GERMAN, "mac_roman", "cp1252"),
]


@pytest.mark.parametrize(("text", "wrote", "read"), CHAINS)
def test_chains_are_found_and_repaired(text, wrote, read):
    bad = wrong(text, wrote, read)
    got = evidence(bad)
    assert any(s for s, _ in got.values()), bad
    best = max(got, key=lambda c: got[c])
    if wrote == "utf8":
        assert repair(bad, best) == text


def test_twice_garbled():
    bad = wrong(wrong(GREEK, "utf8", "cp1252"), "utf8", "cp1252")
    assert repair(bad, "utf8>cp1252") == GREEK


def test_right_texts_are_kept(spark):
    rows = [(i, t, "s") for i, t in enumerate(RIGHT)] + [(100 + i, "clean words", "s") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert garbled_documents(df).count() == 0


def test_documents(spark):
    garbled = [wrong(t, w, r) for t, w, r in CHAINS] + ["up to 477 m�, save", GREEK + " " + wrong("Τέλος και αρχή", "utf8", "cp1252")]
    n = len(garbled)
    rows = [(i, t, None if i % 2 else "hot", 1) for i, t in enumerate(garbled)] + [(1000 + i, t, "hot", 1) for i, t in enumerate(RIGHT * 20)] + [(0, garbled[0], "hot", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, found int")
    got = {r.doc_id for r in garbled_documents(df).collect()}
    assert got == set(range(n))
    fixed = {r.doc_id: r for r in repaired_documents(df).collect()}
    assert fixed[0].text_repaired == GREEK and fixed[n - 2].chain == "lost"
    assert garbled_documents(df.limit(0)).count() == 0


def test_very_long_text():
    assert evidence(wrong(GREEK * 2000, "utf8", "cp1252"))["utf8>cp1252"][0] > 10_000
    assert evidence("a" * 1_000_000) == {}


def test_quick_search_lets_every_pattern_through():
    import random

    patterns = [*m._NAIVE.values(), m._MAC_READ_AS_CP1252, m._CONTROLS]
    for t in ("up to 5.000 Ä", "aquí te", "and …tat", "AM…LIE", "PR€T"):
        assert m.evidence(t) and m.suspicious(t)
    rng = random.Random(5)
    signs = "aAzs  1\n" + m._ORDINARY
    for _ in range(200_000):
        t = "".join(rng.choices(signs, k=4))
        assert m.suspicious(t) or not any(p.search(t) for p in patterns), t


def test_unfinished_estimates_are_an_error(spark):
    df = spark.createDataFrame([(1, "caf\u00c3\u00a9", "s"), (2, "plain", "s")], "doc_id bigint, text string, source string")
    assert judged_records(df, "doc_id", "text", "source")[0].count() == 1
    with pytest.raises(RuntimeError, match="converge"):
        judged_records(df, "doc_id", "text", "source", rounds=1)


WEAK = "The rate is fixed \u00f1 the same holds for all."


def test_weak_evidence_counts_as_its_source_makes_it_credible(spark):
    """The estimate decides: the same weak sign is garbled text in one source and clean in another; without it both are alike."""
    bad = wrong("Rénover dès réception – le contrôle", "cp1252", "mac_roman")
    assert pattern(WEAK).count("1") == 1 and set(pattern(WEAK)) == {"0", "1"}
    rows = [(i, bad, "hot") for i in range(60)] + [(100 + i, "clean words", "hot") for i in range(30)]
    rows += [(500 + i, "clean words", "calm") for i in range(900)] + [(1, WEAK, "hot"), (2, WEAK, "calm")]
    df = spark.createDataFrame([(i + 10_000 if i > 2 or t != WEAK else i, t, s) for i, t, s in rows], "doc_id bigint, text string, source string")
    got = {r.doc_id for r in garbled_documents(df).collect()}
    assert 1 in got and 2 not in got


def test_the_posterior_chooses_the_chain():
    """Of two chains with equally many hits the estimate prefers the common one; a fixed order would not."""
    prior, _ = m._prior()
    k = len(m.CHAINS)
    a, b = m._CODE["utf8>cp1252"], m._CODE["utf8>cp1250"]
    p = "".join("4" if i in (a, b) else "0" for i in range(k))
    for usual in (a, b):
        shares = np.append(np.full(k, 1e-4), 0.9)
        shares[usual] = 0.05
        assert m.posteriors([p], shares, prior)[0].argmax() == usual


def test_parts_garbled_by_different_chains(spark):
    text = wrong(GREEK, "utf8", "cp1252") + "\n" + wrong("Σχέδιο Ορνελία για όλους", "utf8", "mac_roman")
    rows = [(0, text, "s")] + [(1 + i, wrong(GREEK, "utf8", "cp1252"), "s") for i in range(20)] + [(100 + i, "clean", "s") for i in range(100)]
    fixed = {r.doc_id: r.text_repaired for r in repaired_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert fixed[0] == GREEK + "\nΣχέδιο Ορνελία για όλους"


def test_repeated_ids_are_repaired_row_by_row(spark):
    rows = [(7, wrong(GREEK, "utf8", "cp1252"), "s"), (7, wrong(GERMAN, "utf8", "cp1252"), "s"), (7, "clean", "s")]
    got = repaired_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert sorted(r.text_repaired for r in got) == sorted([GREEK, GERMAN])


def test_round_trip_of_whole_documents(sf_dir):
    """Clean documents garbled by every chain that loses nothing: nearly all are found, and restored to the letter."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist() if t and not t.isascii() and t.strip() and not pattern(t)]
    prior, _ = m._prior()
    shares = np.append(np.full(len(m.CHAINS), 0.01 / len(m.CHAINS)), 0.99)
    made = found = restored = 0
    for chain in m.CHAINS[:-1]:
        wrote, read = chain.split(">")
        for t in texts:
            try:
                bad = t.encode(wrote).decode(read)
            except UnicodeError:
                continue
            if bad == t:
                continue
            made += 1
            p = m.posteriors([pattern(bad)], shares, prior)[0] if pattern(bad) else None
            if p is not None and p[m.CLEAN] < 0.5:
                found += 1
                restored += repaired_text(bad, m.CHAINS[int(p[: m.CLEAN].argmax())], shares, prior) == t
    assert made > 500 and found > 0.97 * made and restored > 0.93 * made
