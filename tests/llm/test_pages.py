import pytest

import numpy as np

from lychnos.llm import residue as residue_module
from lychnos.llm.blocks import block_tree, body_lines, fit_tree, held_out_sites, labelled_pages, line_record
from lychnos.llm.pages import main_body
from lychnos.llm.residue import Sample, choose_threshold, exact_check, fit_model, page_features, placeholders, residue_pages, scores_of, validation, weak_label

REAL = "\n".join([
    "Πρόγραμμα Ορνελία | Περιφερειακό Ταμείο Τόρνη", "Αρχική | Δράσεις | Νέα | Έντυπα", "", "Πρόγραμμα Ορνελία", "Τι χρηματοδοτείται",
    "Το επιτόκιο ορίζεται σε 3,5 % και μένει σταθερό για 9 χρόνια.", "Για πλήρη προβολή του χάρτη ενεργοποιήστε τη JavaScript.", "• Μόνωση δώματος έως 40 τ.μ.",
    "Η πλατφόρμα θέλει ενεργή JavaScript, όμως τα έντυπα του κύκλου 4 δίνονται και σε χαρτί.", "Διαβάστε ακόμη", "Νέα στέγη Βελαρώ", "Ο φάκελος κατατίθεται στο…", "Δράση Τορις 4",
    "Ακολουθήστε μας στα κοινωνικά δίκτυα", "© 2025 Περιφερειακό Ταμείο Τόρνη – Με επιφύλαξη κάθε δικαιώματος",
])
GERMAN = "\n".join(["Förderlinie Noral", "Termine", "Der Zinssatz beträgt 5 % und bleibt 9 Jahre gleich.", "Lesen Sie auch", "Programm Fenor 5", "Startseite", "Termine", "Aktuelles"])


def test_main_body():
    assert body_lines(REAL) == [4, 5, 6, 8, 9]
    assert body_lines(GERMAN) == [1, 2, 3]


RESIDUE = [
    "You need to turn on JavaScript to run this app.",
    "Σφάλμα εφαρμογής: αδ | Ταμείο Τόρνη\nΑρχική\nΝέα\nΣφάλμα εφαρμογής: αδυναμία σύνδεσης με τη βάση (6e056000)\n© 2025 Ταμείο Τόρνη – Με επιφύλαξη κάθε δικαιώματος",
    "Noral Warm Homes\nThe rate is {{percent}} and stays fixed for {{number}} years.",
    "Action Fenor\nSample copy goes in this box. Sample copy goes in this box. Sample copy goes in this box.",
    "Πρόγραμμα Τορις\nVoba tradune lusil pelmidu torsil baqua tradune lusil voba pelmidu.",
    "Förderlinie $TITLE$\nNeue Fenster (&lt;number&gt; Stück)",
]
KEPT = [REAL, GERMAN, "", " \n ", None, "Αρχική\nΝέα", "Noral Warm Homes\nIf error 404 appears while sending, keep a screenshot and mail it to the Fenor Savings Bank.", "Action X\nName the file [meter]_5.pdf and upload it before 1/2/2025.\nClasses {A, B, C} hold for buildings up to 70 m² [52]."]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert exact_check(text) and weak_label(text) == 1


@pytest.mark.parametrize("text", [t for t in KEPT if t])
def test_kept(text):
    assert not exact_check(text) and weak_label(text) != 1


def test_placeholders():
    assert placeholders("{a} ${b} {{ c }} <%= d.e %> {% f %} @@g@@ %H% __AB__ [insert i here] <ποσό> [[k]] XXXX ______ [object Object] undefined (εδώ μπαίνει ποσό) «ποσό – προς συμπλήρωση»") >= 16
    assert placeholders("fields such as <floor> and <room>, [Accept] [ΑΦΜ]_63.pdf {Α, Β, Γ} [11] a < b > c 5 % of 3 %") == 0


def test_tables(spark):
    rows = [(i, t, f"h{i % 7}", 1) for i, t in enumerate(RESIDUE * 5 + KEPT * 5)] + [(0, RESIDUE[0], "h0", 2)]
    df = spark.createDataFrame(rows, "page_id bigint, page_text string, site_key string, score int")
    bad = {r.page_id for r in residue_pages(df).collect()}
    assert bad == set(range(len(RESIDUE) * 5))
    lines = {(r.page_id, r.line_no) for r in main_body(df).collect()}
    first = len(RESIDUE) * 5
    assert {n for p, n in lines if p == first} == {4, 5, 6, 8, 9}
    assert not bad & {p for p, _ in lines}
    assert {"classifier_precision", "classifier_recall", "margin"} <= {r.metric for r in validation(df).collect()}
    assert residue_pages(df.limit(0)).count() == 0 and main_body(df.limit(0)).count() == 0


def test_tree():
    tree = block_tree()
    block_tree.cache_clear()
    assert block_tree() == tree
    used = set()

    def walk(node):
        if len(node) > 1:
            used.add(node[0])
            walk(node[2])
            walk(node[3])

    walk(tree)
    assert used & {2, 3, 4, 5}  # neighbours decide
    body, furniture, wrong, missed = held_out_sites()
    assert wrong + missed < 0.02 * (body + furniture)


def test_without_neighbours_rows_change(monkeypatch):
    """The heading that is also a menu entry is told by its neighbours alone."""
    from lychnos.llm import blocks

    whole = blocks.block_features
    blind = lambda lines: ([(*r[:2], 0, 0, 0, 0) for r in whole(lines)[0]], whole(lines)[1])
    pages = labelled_pages()
    rows = [(r, b) for _, lines, body in pages for r, b in zip(whole(lines)[0], body, strict=True)]
    tree = fit_tree(pages)
    monkeypatch.setattr(blocks, "block_features", blind)
    other = fit_tree(pages)
    assert any((blocks.decide(tree, r) >= 0.5) != (blocks.decide(other, (*r[:2], 0, 0, 0, 0)) >= 0.5) for r, _ in rows)


def test_long_lines():
    assert len(line_record("word " * 200_000)) == 4
    assert body_lines("Action X\n" + "The rate is 5% and stays fixed for 9 years. " * 20_000) == [1, 2]
    one = "The rate is 5% and stays fixed for 9 years."
    assert line_record(one)[0] == line_record(" ".join([one] * 40))[0]


def sample(i, text, label):
    _, grams, _, flags = page_features([text])
    return Sample(label, i % 10, i % 10, grams, flags)


def invented(n):
    body = "Action {0}\nThe rate is {1}% and stays fixed for 9 years.\nThree quotes suffice for costs up to {1} EUR; above that, five are asked for."
    return [(i, body.format(chr(65 + i % 26) * 3, i if i % 2 else "~~value~~"), 1 - i % 2) for i in range(n)]


def test_the_classifier_decides_what_no_pattern_knows():
    """A placeholder form that no pattern has is learned from labels; without the classifier the pages are lost."""
    rows = invented(400)
    m = fit_model([sample(*r) for r in rows], (1.0, 1.0))
    said = (scores_of(m.weights, m.bias, [t for _, t, _ in invented(460)[400:]]) > m.threshold).tolist()
    assert said == [bool(y) for _, _, y in invented(460)[400:]]
    assert not any(exact_check(t) for _, t, _ in rows)


def test_threshold():
    z, y = np.array([-3.0, -1.0, 0.5, 2.0, 4.0]), np.array([0, 0, 1, 0, 1])
    threshold, margin = choose_threshold(z, y, np.ones(5))
    assert -1.0 < threshold < 0.5 and margin > 2.0 - threshold
    assert not fit_model([sample(i, "plain words here", 0) for i in range(30)], (1.0, 1.0)).fitted


def test_classifier_changes_rows(spark, sf_dir):
    """Ablation: with the classifier switched off nothing is found beyond its margin."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{sf_dir}/scraped_pages.parquet")
    found = residue_pages(df)
    assert found.where(F.col("score") > 0).count() > 0


def test_every_placeholder_passes_the_quick_look():
    from lychnos.llm.residue import may_be_open

    forms = (
        "#{a} {{ b }} {1} ${c} <%= d %> {%e%} @@f@@ %GH% %A_B% __AB__ XXXX _____ [[k]] [insert i] [ποσό] <ποσό> undefined NaN &lt;a&gt; $AB$ [object|Object] [fill|in|x] [συμπληρώστε|ποσό] "
        "(εδώ|μπαίνει|ποσό) (hier|steht|x) (here|goes|x) (x|goes|here) (x|kommt|hierhin) (x|hier|einsetzen) «x|–|προς|συμπλήρωση» «x|–|to|be|filled|in» «x|-|to|fill|in» «Betrag|–|noch|auszufüllen» «x|–|bitte|ergänzen»"
    ).replace("{{ b }}", "{{b}}").replace("<%= d %>", "<%=d%>").replace("[insert i]", "[insert|i]").split()
    for form in [*(f.replace("|", " ") for f in forms), f"<%{'a' * 60}%>", f"[insert {'ab ' * 30}]", f"«{'Betrag ' * 9}– noch auszufüllen»", f"<{'a' * 50}>"]:
        assert may_be_open(form) and placeholders(form), form


def test_pages_without_a_host_column_and_with_clashing_names(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(RESIDUE * 4 + [REAL] * 8)]
    df = spark.createDataFrame(rows, "page_id bigint, page_text string, label string, grams string")
    assert {r.page_id for r in residue_pages(df).collect()} == set(range(len(RESIDUE) * 4))
    nulls = df.withColumn("site_key", df["grams"])
    assert {r.page_id for r in residue_pages(nulls).collect()} == set(range(len(RESIDUE) * 4))


def test_what_is_kept_is_bounded(monkeypatch):
    from lychnos.llm import blocks

    monkeypatch.setattr(blocks, "_MOST_CHARS", 10_000)
    for i in range(30):
        assert body_lines(f"Action X\nThe rate is {i}% and stays fixed for 9 years. " + "It stays fixed. " * 500) == [1, 2]
    assert sum(map(len, blocks._records)) < 40_000
    weak_label("long words " * 1000)
    page_features(["y" * 5000])
    assert max(map(len, residue_module._facts)) <= 1000 and max(map(len, residue_module._words)) <= 64
