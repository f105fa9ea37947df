from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lychnos.functions import html as H
from lychnos.functions import jsonx as J


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("v")).first()[0]


PAGE = "<html><head><title>T</title></head><body><nav>menu</nav><p> a </p><p>b</p><script>x</script></body></html>"


def test_body_text(spark):
    assert one(spark, "<body><p> a </p><p>b</p><script>x</script></body>", H.body_text) == "ab"
    assert one(spark, "<body><p>unclosed", H.body_text) == "unclosed"
    assert one(spark, "<p>no body</p>", H.body_text) is None


def test_pruned_text():
    assert H.prune(PAGE) == "T a b"
    assert H.prune("<div class='cookie-bar'><p>no<b>ne</b></p></div><div id=footer>f</div><p>yes</p>") == "yes"
    assert H.prune("<div class=\"x Modal\">kept</div><img src=a><br>t") == "kept t"
    assert H.prune(None) is None
    assert H.prune("<nav>never closed <p>gone") == ""


def test_page_info(spark):
    df = spark.createDataFrame([("u", '<title>A &amp; B</title><meta content="d" name="description">'), ("u", "<p>"), ("u", '<meta name="description">'), ("u", None)], "u string, h string")
    got = [r[0] for r in df.select(H.page_info(F.col("u"), F.col("h"))).collect()]
    assert (got[0].title, got[0].description) == ("A & B", "d")
    assert (got[1].title, got[1].description) == (H.NO_TITLE, H.NO_DESCRIPTION)
    assert got[2] is None and got[3] is None


def test_needs_scripts(spark):
    assert one(spark, "<body>x<noscript>please enable</noscript></body>", H.needs_scripts)
    assert one(spark, "<body></body>", H.needs_scripts)
    assert not one(spark, "<body>x<noscript>Enable</noscript></body>", H.needs_scripts)


def test_balanced_object(spark):
    cases = {"x {a:{b}} y {c}": "{a:{b}}", "} {a}": "", "none": "", "{open": "", "": ""}
    for text, want in cases.items():
        assert one(spark, text, J.balanced_object) == want
        assert J.first_object(text) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="{}ab", max_size=30))
def test_balanced_is_balanced(text):
    got = J.first_object(text)
    assert got in text and got.count("{") == got.count("}")


def test_read_json():
    assert J.read_json('{"a":1} trailing') == {"a": 1}
    assert J.read_json('{"a":1,"a":2}') == {"a": 2}
    assert J.read_json("no json") is None and J.read_json(None) is None


def test_fences(spark):
    assert one(spark, "a ```Python\nx = 1\n``` b", J.fenced_code) == "\nx = 1\n"
    assert one(spark, "no fence", J.fenced_code) is None
    assert one(spark, '```json\n[{"a": 1}]\n```', J.bare_json) == '[{"a": 1}]'
    assert one(spark, 'so: {"a": 1} done', J.bare_json) == '{"a": 1}'
    assert one(spark, '{"a": [1]}', J.bare_json) == "[1]"
