import pytest
from pyspark.sql import functions as F

from lychnos.functions import patterns as P
from lychnos.functions import text as X


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_sentences(spark):
    cases = {
        "": [],
        "Hi?! Bye": ["Hi?", "!", "Bye"],
        "Dr. Who left. Pi is 3.14.": ["Dr. Who left.", "Pi is 3.14."],
        "Wait... what": ["Wait...", "what"],
        "See example.com today. Yes!": ["See example.com today.", "Yes!"],
        "Acme Inc. makes it. He said \"no.\" Then left": ["Acme Inc. makes it.", "He said \"no\".", "Then left"],
        "U.S. He came": ["U.S.", "He came"],
        "v 1.2.3 is out": ["v 1.2.", "3 is out"],
        "a\nb": ["a b"],
    }
    assert values(spark, list(cases), X.sentences) == list(cases.values())
    assert values(spark, [None], X.sentences) == [None]


def test_sentences_keep_every_other_character(spark):
    texts = ["One. Two? Three! Four", "Ο φάκελος κατατίθεται. Τέλος;", "x" * 5000 + ". " + "y" * 5000]
    got = values(spark, texts, X.sentences)
    assert ["".join("".join(s).split()) for s in got] == ["".join(t.split()) for t in texts]


def test_chunks(spark):
    text = " ".join(f"S{i}x." for i in range(7))
    assert [len(c.split()) for c in values(spark, [text], lambda c: X.chunks(X.sentences(c), 3))[0]] == [3, 3, 1]
    assert values(spark, [""], lambda c: X.chunks(X.sentences(c), 3)) == [[]]
    with pytest.raises(ValueError):
        X.chunks(F.array(), 0)


def test_names_and_cuts(spark):
    assert values(spark, ["https://a.b/c?d=e&f"], X.safe_name) == ["a.b_c_d_e_f"]
    assert values(spark, ["x.PDF", "x?content-type=application/pdf", "x"], X.is_pdf_url) == [True, True, False]
    assert values(spark, ["a" * 10_001, "", None], lambda c: F.length(X.truncated(c))) == [10_000, 25, 25]
    assert values(spark, ["a/b/c.pdf"], X.basename) == ["c.pdf"]
    assert values(spark, ["  a \n"], X.strip) == ["a"]


def test_contacts(spark):
    got = values(spark, ["b@x.co a@x.co b@x.co", None, "call +30 210 1234567 or https://a.b/c)."], P.contacts)
    assert got == [["email: a@x.co", "email: b@x.co"], [], ["phone: +30 210 1234567", "https://a.b/c"]]


def test_dates(spark):
    cases = {
        "12/02/2025 to 31/02/2025": "2025-02-12 to 31/02/2025",
        "29/02/2024 29/02/2023 29/02/1900 29/02/2000": "2024-02-29 29/02/2023 29/02/1900 2000-02-29",
        "31/04/2020 30/04/2020": "31/04/2020 2020-04-30",
        "112/02/2025": "112/02/2025",
    }
    assert values(spark, list(cases), P.iso_dates) == list(cases.values())


def test_gates(spark):
    df = spark.createDataFrame([("5000 EUR", "European"), ("5000", "no sign 5000"), ("5000", "nothing"), ("", "€"), (None, "€"), ("x", None)], "v string, p string")
    assert [r[0] for r in df.select(P.money_gate(F.col("v"), F.col("p"))).collect()] == ["5000 EUR", "5000", "", "", "", ""]
    assert [r[0] for r in df.select(P.entity_gate(F.col("v"), F.col("p"))).collect()] == ["", "5000", "", "", "", ""]
