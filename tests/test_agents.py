import json

import pytest
from pyspark.sql import functions as F

from lychnos.functions.signature import describe, schema_text
from lychnos.operators import chat, fuzzy
from lychnos.operators.extraction import as_list, as_text
from lychnos.operators.model_stage import HttpChat, Rule, Scripted, collected, require_backend, streamed, with_model
from lychnos.plans import agents
from lychnos.plans.prompts import PROMPTS, Role
from lychnos.sources.readers import load_sources, load_template, pdf_text, read_links, write_results


def test_reply_and_log(spark):
    df = spark.createDataFrame([("q1",), ("q2",)], "prompt string")
    got = agents.ask(df, Scripted("hello")).orderBy("prompt").collect()
    assert [r.reply for r in got] == ["hello", "hello"]
    assert [(m.role, m.content) for m in got[0].log] == [("user", "q1"), ("assistant", "hello")]


def test_history_is_part_of_the_prompt(spark):
    df = spark.createDataFrame([("q", [("user", "before", None)])], f"prompt string, history {chat.MESSAGES}")
    seen = agents.ask(df, Rule(lambda m: "|".join(x["role"] for x in m)), history="history").first()
    assert seen.reply == "system|user|user"
    assert agents.ask(df, Rule(lambda m: m[0]["content"]), system_prompt="mine").first().reply == "mine"


def test_images_only_where_given(spark):
    df = spark.createDataFrame([("q", ["a.png"])], "prompt string, pics array<string>")
    assert agents.ask(df, Rule(lambda m: str("images" in m[-1])), images="pics").first().reply == "True"
    assert agents.ask(df, Rule(lambda m: str("images" in m[-1]))).first().reply == "False"


def test_errors_stay_with_their_row(spark):
    def reply(m):
        if m[-1]["content"] == "bad":
            raise RuntimeError("no")
        return "ok"

    df = spark.createDataFrame([("good",), ("bad",)], "prompt string")
    got = {r.prompt: (r.reply, r.reply_error) for r in agents.ask(df, Rule(reply)).collect()}
    assert got == {"good": ("ok", None), "bad": (None, "RuntimeError: no")}


def test_backends():
    with pytest.raises(TypeError):
        require_backend(object())
    with pytest.raises(ValueError):
        HttpChat("")
    assert collected(iter(["a", {"message": {"content": "b"}}])) == "ab"
    assert "".join(Scripted("a b").ask([], stream=True)) == "ab"


def test_rows_without_messages_are_not_asked(spark):
    df = spark.createDataFrame([(1, None)], f"i int, m {chat.MESSAGES}")
    assert with_model(df, "m", Scripted("x")).first().reply is None


def test_data_points(spark):
    df = spark.createDataFrame([("Ann, 30",)], "info string")
    got = agents.extract_points(df, Scripted('{"name": "Ann"}'), "info", ["name", "age"], as_json=True).first()
    assert got.points == {"name": "Ann"}
    assert agents.extract_points(df, Scripted("name: Ann"), "info", ["name"]).first().reply == "name: Ann"


def test_documents_in_order(spark):
    rows = [("k", "dir/b.pdf", "two\n", 2, "why?"), ("k", "dir/a.pdf", "one", 1, "why?")]
    df = spark.createDataFrame(rows, "k string, path string, text string, pos int, q string")
    got = chat.document_prompt(df, "k", question_col="q").first().prompt
    assert got == "Contents of document a.pdf :\none\n\nContents of document b.pdf :\ntwo\n\n\n\nUser's question: why?"
    assert agents.ask_documents(df, Scripted("because"), "k", "q").first().reply == "because"


def add(a: int, b: int = 2):
    """Add two numbers.

    :param a: the first
    :param b: the second
    """


def test_functions(spark):
    assert describe(add) == ("add", "Add two numbers.", [(0, "a", "<class 'int'>", "None", "the first"), (1, "b", "<class 'int'>", "2", "the second")])
    assert json.loads(schema_text([add]))["add"]["parameters"]["b"]["default value"] == "2"
    df = spark.createDataFrame([("q",)], "prompt string")
    got = agents.choose_function(df, Scripted('{"function": "add", "parameters": {"a": 1}}'), [add]).first()
    assert (got.function, got.parameters) == ("add", '{"a":1}')
    for bad in ('{"function": "rm", "parameters": {}}', '{"function": "add"}', "nonsense"):
        assert agents.choose_function(df, Scripted(bad), [add]).first().function is None


def test_online_search(spark):
    def reply(m):
        text = m[-1]["content"]
        if m[0]["content"].startswith("Turn"):
            return '{"search_query": "q"}' if text == "find" else "no json"
        return '{"url": "u1"}' if "Found pages" in text else "from: " + text

    df = spark.createDataFrame([(1, "find"), (2, "fail")], "prompt_id int, prompt string")
    hits = lambda q: q.select("prompt_id", F.lit(1).alias("rank"), F.lit("u1").alias("url"), F.lit("t").alias("title"), F.lit("d").alias("description"))
    got = agents.search_online(df, Rule(reply), hits, lambda x: x.withColumn("page_text", F.lit("page"))).orderBy("prompt_id").collect()
    assert "page" in got[0].reply and "find" in got[0].reply
    assert [m.role for m in got[0].log] == ["user", "assistant"] * 3
    assert got[1].reply is None and got[1].search_query is None


def test_objects_need_one_wish(spark):
    df = spark.createDataFrame([(["p"],)], "images array<string>")
    for kw in ({}, {"objects": ["a"], "criteria": "b"}):
        with pytest.raises(ValueError):
            agents.detect_objects(df, Scripted(""), "images", **kw)


def test_templates():
    assert len(PROMPTS) == 15
    assert {r.value for r in Role} <= set(PROMPTS)
    for bad in ("a {x", "a } b"):
        with pytest.raises(ValueError):
            chat.fill(bad, {})
    with pytest.raises(KeyError):
        chat.fill("{missing}", {})


def test_values_are_not_filled_again(spark):
    df = spark.createDataFrame([("{b}", "B")], "a string, b string")
    assert df.select(chat.fill("{a}-{b}-{{a}}", {"a": F.col("a"), "b": F.col("b")})).first()[0] == "{b}-B-{a}"


def test_coercion():
    assert as_list("a, ,b") == ["a", "b"]
    assert as_list([None, " x ", {"value": "v"}, {"q": 1, "r": "z"}, 3]) == ["x", "v", "1, z", "3"]
    assert as_list(None) == [] and as_list(5) == ["5"] and as_list([{"q": True}]) == ["True"]
    assert [as_text(v) for v in (0, [], None, False, {"a": "é"})] == ["0", "[]", "", "false", '{"a": "é"}']


def test_strict_shape_and_object(spark):
    df = spark.createDataFrame([("u", "Page of Body €")], "url string, page_text string")
    record = {"managing_body": "Body", "programme_name": "Invented", "total_budget": "5"}
    ok, bad = agents.pages_to_records(df, Scripted(json.dumps(record)))
    assert (ok.count(), bad.first().status) == (0, "shape")
    ok, bad = agents.pages_to_records(df, Scripted(json.dumps(record)), shape="object_ok")
    got = ok.first()
    assert (got.managing_body, got.programme_name, got.total_budget, got.eligible_parties) == ("Body", "", "5", [])
    assert bad.count() == 0


def test_fuzzy_sources(spark):
    key = "kalypso-tower.example.gr"
    prompts = spark.createDataFrame([(1, key.upper()), (2, "x" * 155 + key), (3, None), (4, "")], "prompt_id int, prompt string")
    sources = spark.createDataFrame([(key, ["u1", "u2"])], "domain string, urls array<string>")
    got = [(r.prompt_id, r.url) for r in fuzzy.match_sources(prompts, sources).orderBy("prompt_id", "pos").collect()]
    assert got == [(1, "u1"), (1, "u2")]


def test_routes(spark):
    df = spark.createDataFrame([("https://a", None), ("hi", "u"), ("hi", None), (" Quit ", "u"), (" ", None)], "t string, u string")
    assert [r[0] for r in df.select(chat.route(F.col("t"), F.col("u"))).collect()] == ["online", "online", "chat", None, None]


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([("http://a",), ("http://b",), ("http://c.pdf",), (None,)], "url string")

    def site(url):
        return {"http://a": "text"}.get(url, "  ")

    got = {r.url: (r.page_text, r.read_error) for r in read_links(df, site, lambda u: b"pdf", lambda raw: ["p1", "p2"], backoff=0).collect()}
    assert got == {"http://a": ("text", None), "http://b": (None, "no text"), "http://c.pdf": ("p1p2", None), None: (None, "no address")}
    files = spark.createDataFrame([("a.pdf", bytearray(b"x"))], "path string, content binary")
    assert pdf_text(files, lambda raw: ["1", "2"]).first().text == "12"
    assert load_sources(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text('{"d": ["u"]}')
    assert load_sources(spark, str(tmp_path / "s.json")).first().urls == ["u"]
    (tmp_path / "t.json").write_text('[{"a": "", "b": []}]')
    assert load_template(str(tmp_path / "t.json")) == (("a", "b"), frozenset({"b"}))
    assert len(load_template(None)[0]) == 25


def test_results_are_written_once(spark, tmp_path):
    ok = spark.createDataFrame([("https://a/b", "x")], "url string, v string")
    bad = spark.createDataFrame([("https://a/c", "raw")], "url string, reply string")
    write_results(ok, bad, str(tmp_path))
    assert spark.read.json(str(tmp_path / "records")).first().artifact_name.endswith("_a_b_extracted.json")
    assert spark.read.json(str(tmp_path / "rejected")).count() == 1


def test_search_counts_every_word(spark, monkeypatch):
    monkeypatch.setattr(agents, "BLOCK_PAGES", 3)  # several blocks, more than ``hits`` pages in one
    texts = {f"u{i:02d}": f"Scheme {i}\nfor all of us" for i in range(40)} | {"u05": "Κύκλος 64 «W»\nόροι", "u90": ", Κύκλος 65 «W»"}
    pages = spark.createDataFrame([*texts.items(), ("u02", "Scheme of old\nfor us"), ("u91", None)], "url string, page_text string").coalesce(2)
    asked = ["Scheme 7", "κύκλος 64 «w»", "", "for all of us 39", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "prompt_id bigint, search_query string")
    got = {}
    for r in agents.page_search(pages, hits=2)(queries).collect():
        got.setdefault(r.prompt_id, {})[r.rank] = (r.url, r.title)
    assert got == {
        0: {1: ("u07", "Scheme 7"), 2: ("u00", "Scheme 0")},
        1: {1: ("u05", "Κύκλος 64 «W»"), 2: ("u90", ", Κύκλος 65 «W»")},
        3: {1: ("u39", "Scheme 39"), 2: ("u00", "Scheme 0")},
    }


class Counting:
    """A backend whose replies differ from one asking to the next; each asking leaves a line."""

    def __init__(self, path):
        self.path = path

    def ask(self, messages, format="", temperature=0.8, stream=False, **options):
        import random

        with open(self.path, "a") as f:
            f.write("x\n")
        said = messages[-1]["content"]
        if messages[0]["content"].startswith("Turn the question"):
            return json.dumps({"search_query": f"{said} {random.random()}"})
        if "Found pages as JSON:" in said:
            return json.dumps({"url": "https://a.example"})
        return json.dumps([{"programme_name": "x"}]) if random.random() < 0.5 else "no json"

    def count(self):
        with open(self.path) as f:
            return len(f.readlines())


def test_each_page_is_asked_once_and_has_one_outcome(spark, tmp_path):
    backend = Counting(str(tmp_path / "asked"))
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.lit("some text").alias("page_text")).repartition(4)
    ok, bad = agents.pages_to_records(pages, backend, keep=["page_id"])
    good, rejected = {r.page_id for r in ok.collect()}, {r.page_id for r in bad.collect()}
    assert not good & rejected and len(good | rejected) == 400 and good and rejected
    assert backend.count() == 400


def test_each_search_step_is_asked_once(spark, tmp_path):
    backend = Counting(str(tmp_path / "asked"))
    df = spark.range(50).select(F.col("id").alias("prompt_id"), F.concat(F.lit("question "), "id").alias("prompt"))
    seen = []

    def searcher(q):
        seen.extend(q.collect())
        return q.select("prompt_id", F.lit(1).alias("rank"), F.lit("https://a.example").alias("url"), F.col("search_query").alias("title"), F.lit("d").alias("description"))

    got = agents.search_online(df, backend, searcher, lambda x: x.withColumn("page_text", F.lit("page"))).collect()
    assert backend.count() == 150 and len(got) == 50
    assert {(r.prompt_id, r.search_query) for r in got} == {(r.prompt_id, r.search_query) for r in seen}


def test_turns_are_asked_once(spark, tmp_path):
    backend = Counting(str(tmp_path / "asked"))
    df = spark.createDataFrame([(i, f"https://a.example/{i}") for i in range(20)] + [(100, "hello")], "prompt_id bigint, prompt string")
    sources = spark.createDataFrame([], "domain string, urls array<string>")
    hits = lambda q: q.select("prompt_id", F.lit(1).alias("rank"), F.lit("https://a.example").alias("url"), F.lit("t").alias("title"), F.lit("d").alias("description"))
    got = agents.answer_turns(df, sources, backend, hits, lambda x: x.withColumn("page_text", F.lit("page"))).collect()
    assert len(got) == 21 and backend.count() == 61


def test_streamed_replies_that_fail_are_never_done(spark):
    class Breaks:
        def ask(self, messages, format="", temperature=0.8, stream=False, **options):
            yield "a"
            if messages[-1]["content"] == "bad":
                raise RuntimeError("cut")
            yield "b"

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "conv_id bigint, said string")
    t = df.select("conv_id", F.lit(0).alias("turn"), F.when(F.col("said").isNotNull(), chat.prompt_list(F.lit("s"), F.col("said"))).alias("m"))
    got = sorted((r.conv_id, r.seq, r.chunk, r.done) for r in streamed(t, "m", Breaks()).collect())
    assert got == [(1, 0, "a", False), (1, 1, "b", True), (2, 0, "a", False)]


def test_list_coercion_of_odd_values():
    assert as_list([None, " x ", {"value": "v"}, {"q": 1, "r": "z"}, 3]) == ["x", "v", "1, z", "3"]
    assert as_list("a, ,b") == ["a", "b"] and as_list(None) == [] and as_list(0) == ["0"] and as_list({"a": 1}) == ["{'a': 1}"]
    assert as_list([{"text": " ", "name": "n"}, {"text": "", "x": None}, [1], True]) == ["n", "[1]", "True"]


def test_fuzzy_bounds_lose_no_pair(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeΑβγς.😀 ") for _ in range(rng.randrange(0, 14)))
    prompts, keys = [word() for _ in range(80)] + ["", "same", "same"], sorted({word() for _ in range(40)} | {""})
    df = spark.createDataFrame(list(enumerate(prompts)), "prompt_id bigint, prompt string")
    sources = spark.createDataFrame([(k, ["u"]) for k in keys], "domain string, urls array<string>")
    got = {(r.prompt_id, r.domain): r.ratio for r in fuzzy.match_sources(df, sources).collect()}
    want = {(i, k): x for i, p in enumerate(prompts) for k in keys if (x := SequenceMatcher(None, p.lower(), k.lower()).ratio()) >= fuzzy.THRESHOLD}
    assert got == want
