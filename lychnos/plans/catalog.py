"""Queries over the operators for text, pages, JSON, vectors, chats, agents and extraction, with their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lychnos.functions import html as H
from lychnos.functions import jsonx as J
from lychnos.functions import patterns as P
from lychnos.functions import text as X
from lychnos.functions.signature import registry
from lychnos.functions.vectors import top_k, top_k_per_query
from lychnos.operators import chat, fuzzy, model_stage
from lychnos.operators.model_stage import Rule
from lychnos.plans import agents
from lychnos.sources import readers
from lychnos.sources.tables import shared_folder, table
from lychnos.streaming.messages import message_log

# SQL pieces: Unicode white space as Python and Java read it; Java's (?U) digits are plain in these data.
_WS = r"\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SP = r"\s\x0b\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_EMAIL_SQL = P.EMAIL
_PHONE_SQL = rf"(?:\+\d{{1,3}}[{_SP}]?)?(?:\d[{_SP}-]?){{7,15}}"
_URL_SQL = rf"https?://[^{_SP}\)]+"


def _found_sql(pattern: str, text: str = "text") -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({text}, '{pattern}'), lambda x: {_strip_sql('x')})))"


def _contacts_sql(text: str = "text") -> str:
    return (
        f"list_concat(list_transform({_found_sql(_EMAIL_SQL, text)}, lambda x: 'email: ' || x), "
        f"list_concat(list_transform({_found_sql(_PHONE_SQL, text)}, lambda x: 'phone: ' || x), {_found_sql(_URL_SQL, text)}))"
    )


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# ---------------------------------------------------------------- contacts and gates


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").where("text is not null")


@query(f"SELECT doc_id, unnest({_found_sql(_EMAIL_SQL)}) AS email FROM documents")
def doc_emails(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(P.emails(F.col("text"))).alias("email"))


@query(f"SELECT doc_id, unnest({_found_sql(_PHONE_SQL)}) AS phone FROM documents")
def doc_phones(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(P.phones(F.col("text"))).alias("phone"))


@query(f"SELECT doc_id, unnest({_found_sql(_URL_SQL)}) AS url FROM documents")
def doc_urls(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(P.urls(F.col("text"))).alias("url"))


@query(f"SELECT doc_id, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS contact FROM (SELECT doc_id, {_contacts_sql()} AS c FROM documents WHERE text IS NOT NULL)")
def doc_contacts(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(P.contacts(F.col("text"))).alias("pos", "contact")).withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT record_id, CASE WHEN total_budget <> '' AND (regexp_matches(description, '(?i)[€$]|EUR|USD|euro|dollar') OR contains(description, total_budget)) THEN total_budget ELSE '' END AS budget FROM (SELECT record_id, coalesce(description, '') AS description, coalesce(total_budget, '') AS total_budget FROM ideal_anav)")
def money_gate(spark, d):
    t = table(spark, d, "ideal_anav")
    return t.select("record_id", P.money_gate(F.coalesce("total_budget", F.lit("")), F.col("description")).alias("budget"))


@query("SELECT r.record_id, CASE WHEN coalesce(r.managing_body, '') <> '' AND contains(coalesce(p.page_text, ''), r.managing_body) THEN r.managing_body ELSE '' END AS managing_body FROM ideal_anav r JOIN scraped_pages p USING (page_id)")
def entity_gate(spark, d):
    r = table(spark, d, "ideal_anav").select("record_id", "page_id", "managing_body")
    p = table(spark, d, "scraped_pages").select("page_id", "page_text")
    return r.join(p, "page_id").select("record_id", P.entity_gate(F.col("managing_body"), F.col("page_text")).alias("managing_body"))


@query("SELECT o_orderkey, 'due ' || CASE WHEN try_strptime(x, '%d/%m/%Y') IS NULL THEN x ELSE strftime(try_strptime(x, '%d/%m/%Y'), '%Y-%m-%d') END || ' or 31/02/2025' AS note FROM (SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS x FROM orders)")
def iso_dates(spark, d):
    note = F.concat(F.lit("due "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" or 31/02/2025"))
    return table(spark, d, "orders").select("o_orderkey", P.iso_dates(note).alias("note"))


# ---------------------------------------------------------------- sentences and chunks


def _sentences_sql() -> str:
    k, s = X.KEPT_DOT, X.CUT
    t = "(' ' || replace(text, chr(10), ' ') || '  ')"

    def sub(e: str, pattern: str, to: str) -> str:
        return f"regexp_replace({e}, '{pattern}', '{to}', 'g')"

    any_ = lambda w: "(" + "|".join(w) + ")"
    start, suffix, letter = any_(X.SENTENCE_STARTERS).replace(r"\s", f"[{_SP}]"), any_(X.COMPANY_SUFFIXES), "([A-Za-z])"
    t = sub(t, rf"{any_(X.HONORIFICS)}[.]", rf"\1{k}")
    t = sub(t, rf"[.]{any_(X.SITE_ENDINGS)}", rf"{k}\1")
    t = sub(t, r"([0-9])[.]([0-9])", rf"\1{k}\2")
    t = sub(t, r"([.]{2,})", rf"\1{s}")
    for n in range(12, 1, -1):  # runs of dots, longest first, since there is no lookaround here
        t = f"replace({t}, '{'.' * n}{s}', '{k * n}{s}')"
    t = f"replace({t}, 'Ph.D.', 'Ph{k}D{k}')"
    t = sub(t, rf"[{_SP}]{letter}[.] ", rf" \1{k} ")
    t = sub(t, rf"([A-Z][.][A-Z][.](?:[A-Z][.])?) {start}", rf"\1{s} \2")
    t = sub(t, rf"{letter}[.]{letter}[.]{letter}[.]", rf"\1{k}\2{k}\3{k}")
    t = sub(t, rf"{letter}[.]{letter}[.]", rf"\1{k}\2{k}")
    t = sub(t, rf" {suffix}[.] {start}", rf" \1{s} \2")
    t = sub(t, rf" {suffix}[.]", rf" \1{k}")
    t = sub(t, rf" {letter}[.]", rf" \1{k}")
    t = f"replace(replace(replace(replace({t}, '.”', '”.'), '.\"', '\".'), '!\"', '\"!'), '?\"', '\"?')"
    t = f"replace(replace(replace({t}, '.', '.{s}'), '?', '?{s}'), '!', '!{s}')"
    parts = f"list_transform(string_split(replace({t}, '{k}', '.'), '{s}'), lambda x: {_strip_sql('x')})"
    return f"SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM (SELECT doc_id, {parts} AS p FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS sentence FROM ({_sentences_sql()})")
def doc_sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n FROM ({_sentences_sql()})")
def doc_sentence_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(X.sentences(F.col("text"))).cast("bigint").alias("n"))


@query(f"SELECT doc_id, CAST(i AS BIGINT) AS pos, array_to_string(p[i * 3 + 1 : i * 3 + 3], ' ') AS chunk FROM (SELECT doc_id, p, unnest(generate_series(0, (len(p) + 2) // 3 - 1)) AS i FROM ({_sentences_sql()}))")
def doc_chunks(spark, d):
    s = _docs(spark, d).select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.posexplode(X.chunks(F.col("s"), 3)).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT doc_id, coalesce(nullif(left(text, 10000), ''), 'Website could not be read') AS text FROM documents")
def doc_truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncated(F.col("text")).alias("text"))


# ---------------------------------------------------------------- vectors


@query("WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)), 6) AS sim FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)) DESC, vec_id DESC LIMIT 10")
def vec_topk(spark, d):
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").select("embedding").first()
    return top_k(e, first[0], 10).select("vec_id", F.round("sim", 6).alias("sim"))


@query("WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id DESC) AS rank FROM s) SELECT query_id, vec_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def vec_topk_per_query(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return top_k_per_query(e, asked, 5).withColumn("sim", F.round("sim", 6))


# ---------------------------------------------------------------- pages

_ESC_SQL = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _html(spark: SparkSession, d: str) -> DataFrame:
    """Pages as HTML: the text escaped, with a menu, a script that holds a tag, and an unclosed body."""
    t = F.col("page_text")
    esc = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    meta = F.when(F.col("lang").isNotNull(), F.concat(F.lit('<meta content="page in '), "lang", F.lit('" name="description">'))).otherwise(F.lit(""))
    doc = F.concat(F.lit("<html><head><title>"), F.col("site_key"), F.lit(" &amp; co</title>"), meta, F.lit("</head><body class=\"a\"><nav><a href='/'> Menu </a></nav><p>"), esc, F.lit("</p><script>var x = \"</p>\";</script><footer>End</footer>"))
    return table(spark, d, "scraped_pages").select("page_id", "url", doc.alias("html"))


@query("SELECT page_id, CASE WHEN page_text IS NOT NULL THEN site_key || ' & co' END AS title, CASE WHEN page_text IS NOT NULL AND site_key IS NOT NULL THEN coalesce('page in ' || lang, 'No description found') END AS description FROM scraped_pages")
def page_titles(spark, d):
    info = H.page_info(F.col("url"), F.col("html"))
    return _html(spark, d).select("page_id", info.alias("i")).select("page_id", "i.title", "i.description")


@query(f"SELECT page_id, CASE WHEN site_key IS NOT NULL THEN 'Menu' || {_strip_sql('page_text')} || 'End' END AS body FROM scraped_pages")
def page_body_text(spark, d):
    return _html(spark, d).select("page_id", H.body_text(F.col("html")).alias("body"))


@query(f"SELECT page_id, CASE WHEN site_key IS NOT NULL THEN trim(site_key || ' & co ' || {_strip_sql('page_text')}, ' ') END AS body FROM scraped_pages")
def page_pruned_text(spark, d):
    return _html(spark, d).select("page_id", H.pruned_text("html").alias("body"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN true ELSE false END AS needs_js FROM scraped_pages WHERE page_text IS NOT NULL AND site_key IS NOT NULL")
def page_needs_js(spark, d):
    note = F.when(F.col("page_id") % 2 == 0, F.lit("<noscript>Please enable it</noscript>")).otherwise(F.lit("<noscript>none</noscript>"))
    return _html(spark, d).where("html is not null").select("page_id", H.needs_scripts(F.concat("html", note)).alias("needs_js"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(url || '?a=1&b=2', 'https://', ''), 'http://', ''), '/', '_'), '?', '_'), '&', '_'), '=', '_') AS name FROM scraped_pages")
def url_safe_name(spark, d):
    return table(spark, d, "scraped_pages").select("page_id", X.safe_name(F.concat("url", F.lit("?a=1&b=2"))).alias("name"))


@query("SELECT page_id, page_id % 3 = 0 AS pdf FROM scraped_pages")
def url_is_pdf(spark, d):
    link = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/a.PDF"))).otherwise(F.col("url"))
    return table(spark, d, "scraped_pages").select("page_id", X.is_pdf_url(link).alias("pdf"))


@query("SELECT page_id, strftime(fetched_at, '%Y%m%dT%H%M%SZ') || '_' || replace(replace(url, 'https://', ''), '/', '_') || '_scraped.txt' AS artifact_name FROM scraped_pages")
def artifact_names(spark, d):
    return table(spark, d, "scraped_pages").select("page_id", X.artifact_name(F.col("url"), F.col("fetched_at"), "_scraped.txt").alias("artifact_name"))


# ---------------------------------------------------------------- JSON


@query("SELECT event_id, props ->> '$.k' AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", J.key(F.col("props"), "k").alias("k"))


@query("SELECT event_id, props AS found FROM events WHERE props IS NOT NULL")
def json_balanced(spark, d):
    said = F.concat(F.lit("Sure! "), "props", F.lit(" - and {more: {}}"))
    return table(spark, d, "events").where("props is not null").select("event_id", J.balanced_object(said).alias("found"))


@query("SELECT event_id, props ->> '$.k' AS k FROM events WHERE props IS NOT NULL")
def json_safe(spark, d):
    said = F.concat("props", F.lit(" trailing words"))
    return table(spark, d, "events").where("props is not null").select("event_id", J.key(J.safe_json(said), "k").alias("k"))


@query("SELECT event_id, chr(10) || 'print(' || props || ')' || chr(10) AS code FROM events WHERE props IS NOT NULL")
def json_fence(spark, d):
    said = F.concat(F.lit("Here:\n```Python\nprint("), "props", F.lit(")\n```\nDone"))
    return table(spark, d, "events").where("props is not null").select("event_id", J.fenced_code(said).alias("code"))


@query("SELECT event_id, '[' || props || ']' AS cut FROM events WHERE props IS NOT NULL")
def json_bare(spark, d):
    said = F.concat(F.lit("```json\nwell ["), "props", F.lit("] so\n```"))
    return table(spark, d, "events").where("props is not null").select("event_id", J.bare_json(said).alias("cut"))


# Hand-made cases: input, balanced object, parsed JSON, bare JSON, code.
_JSON_CASES = (
    ("x {a:{b}} y {c}", "{a:{b}}", None, "{a:{b}} y {c}", None),
    ("} {a}", "", None, "{a}", None),
    ('{"a":1} trailing', '{"a":1}', '{"a": 1}', '{"a":1}', None),
    ('{"a":1,"a":2}', '{"a":1,"a":2}', '{"a": 2}', '{"a":1,"a":2}', None),
    ("no json", "", None, "no json", None),
    ("", "", None, "", None),
    ('Sure [1, {"k": "ü"}] ok', '{"k": "ü"}', '{"k": "ü"}', '[1, {"k": "ü"}]', None),
    ("[1, 2]", "", "[1, 2]", "[1, 2]", None),
    ("Here ```Python\nx = {1}\n``` and ```more```", "{1}", None, "{1}", "\nx = {1}\n"),
    ('{"open": {"a": 1}', "", None, '{"open": {"a": 1}', None),
    ("NaN", "", "NaN", "NaN", None),
    ('{"b": "}"}', '{"b": "}', '{"b": "}"}', '{"b": "}"}', None),
)
_TEXT_CASES = (
    ("", "", ""),
    ("Hi?! Bye", "Hi?|!|Bye", "Hi?! Bye"),
    ("Dr. Who left. Pi is 3.14.", "Dr. Who left.|Pi is 3.14.", "Dr. Who left. Pi is 3.14."),
    ("Wait... what", "Wait...|what", "Wait... what"),
    ("12/02/2025 to 31/02/2025", "12/02/2025 to 31/02/2025", "2025-02-12 to 31/02/2025"),
    ("29/02/2024, 29/02/2023", "29/02/2024, 29/02/2023", "2024-02-29, 29/02/2023"),
)


def _literal(v: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"


def _cases_sql(names: str, cases: tuple) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, c)) + ')' for c in cases)}) t({names})"


@query(_cases_sql("said, balanced, parsed, bare, code", _JSON_CASES))
def json_cases(spark, d):
    """Replies of every odd shape: several objects, closers first, prose around, repeated keys, cut off."""
    said = F.col("said")
    t = spark.createDataFrame([(c[0],) for c in _JSON_CASES], "said string")
    return t.select("said", J.balanced_object(said).alias("balanced"), J.safe_json(said).alias("parsed"), J.bare_json(said).alias("bare"), J.fenced_code(said).alias("code"))


@query(_cases_sql("said, sentences, dates", _TEXT_CASES))
def text_cases(spark, d):
    t = spark.createDataFrame([(c[0],) for c in _TEXT_CASES], "said string")
    return t.select("said", F.array_join(X.sentences(F.col("said")), "|").alias("sentences"), P.iso_dates(F.col("said")).alias("dates"))


# ---------------------------------------------------------------- chats

_TURNS_SQL = "SELECT url AS conv_id, page_id AS turn, CASE WHEN page_id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role, coalesce(page_text, '') AS text FROM scraped_pages"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """The fetches of one address as the turns of a conversation; an address is fetched a few times."""
    t = table(spark, d, "scraped_pages")
    return t.select(F.col("url").alias("conv_id"), F.col("page_id").alias("turn"), F.when(F.col("page_id") % 2 == 0, "assistant").otherwise("user").alias("role"), F.coalesce("page_text", F.lit("")).alias("text"))


@query(f"SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS said FROM ({_TURNS_SQL})")
def chat_history_prefix(spark, d):
    h = chat.with_history(_turns(spark, d))
    said = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return h.select("conv_id", "turn", said.alias("said"))


@query(f"WITH h AS (SELECT conv_id, turn, text, coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || '|', '') AS said FROM ({_TURNS_SQL})) SELECT conv_id, turn, 'Be brief about ' || conv_id || ' {{{{now}}}}|' || said || text AS prompt FROM h")
def chat_prompt(spark, d):
    h = chat.with_history(_turns(spark, d))
    system = chat.fill("Be brief about {conv} {{{{now}}}}", {"conv": F.col("conv_id")})
    prompt = chat.prompt_list(system, F.col("text"), F.col("history"))
    return h.select("conv_id", "turn", F.array_join(F.transform(prompt, lambda m: m["content"]), "|").alias("prompt"))


@query("SELECT record_id AS conv_id, description AS text FROM ideal_anav WHERE description IS NOT NULL")
def chat_rebuild(spark, d):
    t = table(spark, d, "ideal_anav").where("description is not null").select(F.col("record_id").alias("conv_id"), F.posexplode(F.split("description", "(?<= )")).alias("seq", "chunk"))
    return chat.rebuild_messages(t, ("conv_id",))


@query("SELECT url, string_agg('Contents of document ' || regexp_extract(url, '[^/]*$') || ' :' || chr(10) || coalesce(page_text, '') || chr(10) || chr(10), '' ORDER BY page_id) || chr(10) || 'User''s question: ' || 'why ' || url AS prompt FROM scraped_pages GROUP BY url")
def multi_doc_prompt(spark, d):
    t = table(spark, d, "scraped_pages").withColumn("question", F.concat(F.lit("why "), "url")).withColumn("path", F.col("url"))
    return chat.document_prompt(t, "url", "path", "page_text", "page_id", "question")


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN 'online' WHEN page_id % 4 = 2 AND page_id % 8 = 2 THEN 'online' ELSE 'chat' END AS route FROM scraped_pages")
def chat_route(spark, d):
    k = F.col("page_id") % 4
    said = F.when(k == 0, F.lit(" EXIT ")).when(k == 1, F.col("url")).otherwise(F.lit("hello"))
    match = F.when((k == 2) & (F.col("page_id") % 8 == 2), F.col("url"))
    return table(spark, d, "scraped_pages").select("page_id", chat.route(said, match).alias("route"))


@query()
def source_match(spark, d):
    prompts = table(spark, d, "ideal_anav").select(F.col("record_id").alias("prompt_id"), F.lower("programme_name").alias("prompt"))
    sources = table(spark, d, "trusted_sources").select(F.col("domain_name").alias("domain"), "urls")
    return fuzzy.match_sources(prompts, sources).withColumn("ratio", F.round("ratio", 6))


# ---------------------------------------------------------------- functions and agents


def get_budget(call: str, year: int = 2025) -> str:
    """Look up the budget of a call.

    :param call: id of the call
    :param year: year of the budget
    """
    return ""


def get_time() -> str:
    """Tell the time."""
    return ""


FUNCTIONS = (get_budget, get_time)


@query("SELECT * FROM (VALUES ('get_budget', 0, 'call', 'id of the call'), ('get_budget', 1, 'year', 'year of the budget')) t(name, pos, param, param_description)")
def function_registry(spark, d):
    r = registry(spark, FUNCTIONS).select("name", F.inline("parameters"))
    return r.select("name", "pos", "param", "param_description")


def _last(messages: list) -> str:
    return messages[-1]["content"]


@query("SELECT record_id, CASE WHEN record_id % 3 < 2 THEN CASE WHEN record_id % 3 = 0 THEN 'get_budget' ELSE 'get_time' END END AS function, CASE WHEN record_id % 3 < 2 THEN '{\"n\":' || record_id || '}' END AS parameters FROM ideal_anav")
def agent_function_call(spark, d):
    def reply(messages):
        n = int(_last(messages))
        return "Sure: " + json.dumps({"function": ("get_budget", "get_time", "format_disk")[n % 3], "parameters": {"n": n}})

    t = table(spark, d, "ideal_anav").select("record_id", F.col("record_id").cast("string").alias("prompt"))
    return agents.choose_function(t, Rule(reply), FUNCTIONS).select("record_id", "function", "parameters")


@query("SELECT record_id, 'user:' || length(coalesce(description, '')) AS reply FROM ideal_anav")
def agent_ask(spark, d):
    t = table(spark, d, "ideal_anav").select("record_id", F.coalesce("description", F.lit("")).alias("prompt"))
    return agents.ask(t, Rule(lambda m: f"{m[-1]['role']}:{len(_last(m))}")).select("record_id", "reply")


@query("SELECT record_id, 'plan ' || record_id AS reply_1, 'VALID' AS reply_2 FROM ideal_anav")
def agent_chain(spark, d):
    from lychnos.plans.prompts import Role

    t = table(spark, d, "ideal_anav").select("record_id", F.col("record_id").cast("string").alias("prompt"))
    stages = [(Role.PLANNER, Rule(lambda m: f"plan {_last(m)}")), (Role.VALIDATOR, Rule(lambda m: "VALID" if _last(m).startswith("plan") else "INVALID"))]
    return agents.chain(t, stages).select("record_id", "reply_1", "reply_2")


@query("SELECT record_id, coalesce(managing_body, '') AS body, CAST(length(coalesce(managing_body, '')) AS VARCHAR) AS size FROM ideal_anav")
def agent_data_points(spark, d):
    def reply(messages):
        info = re.search(r"Text:\n(.*)\n\nData points: body, size$", _last(messages), re.S).group(1)
        return json.dumps({"body": info, "size": len(info)})

    t = table(spark, d, "ideal_anav").select("record_id", F.coalesce("managing_body", F.lit("")).alias("info"))
    got = agents.extract_points(t, Rule(reply), "info", ["body", "size"], as_json=True)
    return got.select("record_id", F.col("points")["body"].alias("body"), F.col("points")["size"].alias("size"))


@query("SELECT record_id, chr(10) || 'import numpy' || chr(10) || 'x = ' || record_id || chr(10) AS code, '{\"libraries\": [\"numpy\"]}' AS libraries FROM ideal_anav")
def agent_python(spark, d):
    def reply(messages):
        if "import numpy" in _last(messages):
            return '{"libraries": ["numpy"]}'
        return f"Here you go\n```Python\nimport numpy\nx = {_last(messages)}\n```"

    t = table(spark, d, "ideal_anav").select("record_id", F.col("record_id").cast("string").alias("prompt"))
    return agents.write_python(t, Rule(reply)).select("record_id", "code", "libraries")


@query("SELECT record_id, 'house' AS label, 'pic' || record_id AS location FROM ideal_anav")
def agent_objects(spark, d):
    def reply(messages):
        if "images" in messages[-1]:
            return f"a house at {messages[-1]['images'][0]}"
        return json.dumps({"objects": [{"label": "house", "location": _last(messages).rsplit(" ", 1)[1], "description": "d"}]})

    t = table(spark, d, "ideal_anav").select("record_id", F.array(F.concat(F.lit("pic"), "record_id")).alias("images"))
    return agents.detect_objects(t, Rule(reply), "images", objects=["house"]).select("record_id", "label", "location")


@query("SELECT page_id, CASE WHEN page_text IS NULL THEN 'no page' ELSE 'read ' || length(page_text) END AS reply FROM scraped_pages")
def agent_website(spark, d):
    def reply(messages):
        page = messages[0]["content"].split("Text of the page:\n", 1)[1][:-1]
        return "no page" if page == "Website could not be read" else f"read {len(page)}"

    t = table(spark, d, "scraped_pages").select("page_id", "url", "page_text", F.lit("How long?").alias("question"))
    return agents.ask_website(t, Rule(reply)).select("page_id", "reply")


@query("SELECT url, 'documents: ' || count(*) AS reply FROM scraped_pages GROUP BY url")
def agent_documents(spark, d):
    t = table(spark, d, "scraped_pages").withColumn("question", F.lit("How many?")).withColumn("path", F.col("url"))
    rule = Rule(lambda m: f"documents: {_last(m).count('Contents of document ')}")
    return agents.ask_documents(t, rule, "url", "question", path_col="path", text_col="page_text", pos_col="page_id").select("url", "reply")


@query("SELECT record_id, CASE WHEN record_id % 3 = 0 THEN 'internet' ELSE 'no_internet' END AS route FROM ideal_anav")
def agent_route(spark, d):
    def choose(messages):
        n = int(_last(messages).split()[-1])
        return json.dumps({"function": "internet" if n % 3 == 0 else "no_internet" if n % 3 == 1 else "none", "parameters": {}})

    t = table(spark, d, "ideal_anav").select("record_id", F.col("record_id").cast("string").alias("prompt"))
    return agents.route_by_model(t, Rule(lambda m: f"steps for {_last(m)}"), Rule(choose)).select("record_id", "route")


@query("SELECT page_id, CASE WHEN online THEN 'online' ELSE 'chat' END AS route, CASE WHEN online THEN 'online answer' ELSE 'chat answer' END AS reply FROM (SELECT page_id, page_id % 4 = 1 OR (page_id % 4 = 3 AND t.domain_name IS NOT NULL) AS online FROM scraped_pages LEFT JOIN trusted_sources t USING (site_key) WHERE page_id % 4 <> 0)")
def agent_turns(spark, d):
    """Chats: exits, explicit addresses that are found, others that are not, names of trusted sources, and plain talk."""
    k = F.col("page_id") % 4
    named = table(spark, d, "trusted_sources").select("site_key", "domain_name")
    said = F.when(k == 0, F.lit(" EXIT ")).when(k == 1, F.col("url")).when(k == 2, F.lit("https://missing.example")).otherwise(F.coalesce("domain_name", F.lit("0")))
    t = table(spark, d, "scraped_pages").join(named, "site_key", "left").select("page_id", said.alias("prompt"), F.col("url").alias("own"))

    def reply(messages):
        said = _last(messages)
        if messages[0]["content"].startswith("Turn the question"):
            return json.dumps({} if "missing" in said else {"search_query": said})
        if "Found pages as JSON:" in said:
            return json.dumps({"url": json.loads(said.split("Found pages as JSON:\n", 1)[1].split("\nChoose the page", 1)[0])[0]["url"]})
        return "online answer" if said.startswith("From what was found online") else "chat answer"

    def searcher(q):
        return q.select("page_id", F.lit(1).alias("rank"), F.col("search_query").alias("url"), F.lit("t").alias("title"), F.lit("d").alias("description"))

    sources = table(spark, d, "trusted_sources").select(F.col("domain_name").alias("domain"), "urls")
    return agents.answer_turns(t, sources, Rule(reply), searcher, lambda x: x.withColumn("page_text", F.lit("page")), "page_id")


_LATEST_SQL = "SELECT url, arg_max(page_text, page_id) FILTER (page_text IS NOT NULL) AS page_text FROM scraped_pages WHERE url IS NOT NULL GROUP BY url"


def _words_sql(e: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(replace(lower({e}), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


@query(
    f"WITH pages AS ({_LATEST_SQL}), asked AS (SELECT record_id AS prompt_id, programme_name AS prompt FROM ideal_anav WHERE record_id % 100 = 0 AND trim(programme_name) <> ''), "
    f"words AS (SELECT url, {_words_sql('page_text')} AS w FROM pages), terms AS (SELECT *, {_words_sql('prompt')} AS t FROM asked), "
    "hits AS (SELECT prompt_id, url, len(list_intersect(w, t)) AS n FROM words, terms), best AS (SELECT prompt_id, url FROM hits WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY n DESC, url) = 1) "
    "SELECT prompt_id, prompt AS search_query, url, CASE WHEN url IS NOT NULL THEN 'answer of ' || CAST(length('From what was found online: ' || coalesce(nullif(left(page_text, 10000), ''), 'Website could not be read') || chr(10) || 'Answer the question: ' || prompt) AS VARCHAR) || ' characters' END AS reply "
    "FROM asked LEFT JOIN best USING (prompt_id) LEFT JOIN pages USING (url)"
)
def agent_online_search(spark, d):
    latest = F.max_by("page_text", F.when(F.col("page_text").isNotNull(), F.col("page_id")))
    pages = table(spark, d, "scraped_pages").where("url is not null").groupBy("url").agg(latest.alias("page_text"))

    def reply(messages):
        said = _last(messages)
        if messages[0]["content"].startswith("Turn the question"):
            return json.dumps({"search_query": said})
        if "Found pages as JSON:" in said:
            found = json.loads(said.split("Found pages as JSON:\n", 1)[1].split("\nChoose the page", 1)[0])
            return json.dumps({"url": found[0]["url"]} if found else {})
        return f"answer of {len(said)} characters"

    asked = table(spark, d, "ideal_anav").where("record_id % 100 = 0").select(F.col("record_id").alias("prompt_id"), F.col("programme_name").alias("prompt")).where("prompt is not null and trim(prompt) <> ''")
    got = agents.search_online(asked, Rule(reply), agents.page_search(pages), lambda x: x.join(pages.select("url", "page_text"), "url", "left"))
    return got.select("prompt_id", "search_query", "url", "reply")


@query("SELECT p.page_id, p.url, coalesce(r.record_id, -1) AS record_id FROM scraped_pages p LEFT JOIN ideal_anav r USING (page_id)")
def search_hits(spark, d):
    """Hits keep their place where no metadata is found: a left join."""
    p = table(spark, d, "scraped_pages").select("page_id", "url")
    hits = p.join(table(spark, d, "ideal_anav").select("page_id", "record_id"), "page_id", "left")
    return hits.withColumn("record_id", F.coalesce("record_id", F.lit(-1).cast("bigint")))


# ---------------------------------------------------------------- extraction


def _extraction_reply(messages: list) -> str:
    page = _last(messages).split("PAGE CONTENT:\n", 1)[1].rsplit("\n\nRESPONSE SCHEMA:", 1)[0]
    first = page.strip().split("\n")[0]
    if "�" in page or not first:
        return "I cannot read this page"
    record = {"programme_name": first, "managing_body": "Nobody At All", "total_budget": "100 EUR", "eligible_parties": "a, , b", "eligibility_criteria": [None, " x ", {"value": "v"}, {"q": 1, "r": "z"}, 3], "application_start_date": "12/02/2025 to 31/02/2025", "contact_info": ["made@up.example"], "unknown_key": 1, "duration": 0}
    return "Here it is: " + json.dumps(record) if page.startswith("?") else json.dumps([record], ensure_ascii=False)


@query(
    f"SELECT page_id, {_strip_sql(_NAME)} AS programme_name, '' AS managing_body, CASE WHEN regexp_matches(page_text, '(?i)[€$]|EUR|USD|euro|dollar') THEN '100 EUR' ELSE '' END AS total_budget, "
    f"'a|b' AS eligible_parties, 'x|v|1, z|3' AS eligibility_criteria, '2025-02-12 to 31/02/2025' AS application_start_date, array_to_string({_contacts_sql('page_text')}, '|') AS contact_info, '0' AS duration "
    f"FROM scraped_pages WHERE {_strip_sql('page_text')} <> ''"
    if (_NAME := f"string_split({_strip_sql('page_text')}, chr(10))[1]")
    else None
)
def extract_records(spark, d):
    pages = table(spark, d, "scraped_pages").select("page_id", "url", "page_text")
    ok, _ = agents.pages_to_records(pages, Rule(_extraction_reply), keep=["page_id"])
    join = lambda c: F.array_join(c, "|").alias(c)
    return ok.select("page_id", "programme_name", "managing_body", "total_budget", join("eligible_parties"), join("eligibility_criteria"), "application_start_date", join("contact_info"), "duration")


@query(f"SELECT page_id, 'unreadable' AS status FROM scraped_pages WHERE coalesce({_strip_sql('page_text')}, '') = ''")
def extract_rejected(spark, d):
    pages = table(spark, d, "scraped_pages").select("page_id", "url", "page_text")
    _, bad = agents.pages_to_records(pages, Rule(_extraction_reply), keep=["page_id"])
    return bad.select("page_id", "status")


@query("SELECT page_id, 'ok' AS status, '[{\"n\": ' || page_id || '}]' AS result FROM scraped_pages")
def extract_raw(spark, d):
    pages = table(spark, d, "scraped_pages").select("page_id", F.col("page_id").cast("string").alias("url"), F.lit("text").alias("page_text"))
    rule = Rule(lambda m: "```json\n[{\"n\": " + re.search(r"SOURCE URL: (\d+)", _last(m)).group(1) + "}]\n```")
    return agents.pages_to_raw_records(pages, rule, keep=["page_id"]).select("page_id", "status", "result")


# ---------------------------------------------------------------- sources and sinks


@query("SELECT doc_id, replace(text, chr(10) || chr(10), '') AS text FROM documents WHERE text IS NOT NULL")
def source_pdf_text(spark, d):
    """The pages of files, joined without separator; here a file is a text and its pages its paragraphs."""
    files = _docs(spark, d).select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    read = readers.pdf_text(files.withColumn("path", F.col("path").cast("string")), lambda raw: raw.decode().split("\n\n"))
    return read.select(F.col("path").cast("bigint").alias("doc_id"), "text")


@query("SELECT page_id, CASE WHEN lang = 'de' THEN url || '/a.pdf!' WHEN contains(url, '7') THEN NULL ELSE 'text of ' || url END AS page_text, CASE WHEN contains(url, '7') AND lang IS DISTINCT FROM 'de' THEN 'no text' END AS read_error FROM scraped_pages")
def source_links(spark, d):
    """Addresses through the site reader or, for PDF files, the fetcher; a reader without text fails after its retries."""
    t = table(spark, d, "scraped_pages").select("page_id", F.when(F.col("lang") == "de", F.concat("url", F.lit("/a.pdf"))).otherwise(F.col("url")).alias("url"))
    read = readers.read_links(t, lambda url: " " if "7" in url else f"text of {url}", str.encode, lambda raw: [raw.decode(), "!"], retries=1, backoff=0.0)
    return read.select("page_id", "page_text", "read_error")


@query("SELECT page_id, CASE WHEN contains(url, '9') THEN NULL WHEN contains(url, '7') THEN 'shown' ELSE 'plain' END || url AS page_text, CASE WHEN contains(url, '9') THEN NULL WHEN contains(url, '7') THEN 'browser' ELSE 'plain' END AS read_by FROM scraped_pages")
def source_hybrid(spark, d):
    """Plain pages as fetched, pages that want scripts through the browser; some are read by neither."""

    def fetch(url):
        if "9" in url:
            raise OSError("gone")
        return "<html><body><noscript>Please enable scripts</noscript></body></html>" if "7" in url else f"<html><body><p>plain</p> {url}</body></html>"

    def browse(url):
        return None if "9" in url else f"<html><body><p>shown</p>{url}</body></html>"

    t = table(spark, d, "scraped_pages").select("page_id", "url")
    return readers.read_hybrid(t, fetch, browse).select("page_id", "page_text", F.col("by").alias("read_by"))


@query("SELECT page_id, CASE WHEN contains(url, '7') THEN NULL ELSE 'Title of ' || url END AS title, CASE WHEN contains(url, '7') THEN NULL ELSE 'No description found' END AS description FROM scraped_pages")
def search_info(spark, d):
    """Hits with the title and description of their page; null where it could not be read."""

    def fetch(url):
        if "7" in url:
            raise OSError("gone")
        return f"<html><head><title>Title of {url}</title></head><body>b</body></html>"

    return readers.hits_with_info(table(spark, d, "scraped_pages").select("page_id", "url"), fetch).select("page_id", "info.title", "info.description")


@query("SELECT site_key AS domain, u AS url FROM (SELECT site_key, unnest(urls) AS u FROM trusted_sources WHERE site_key IS NOT NULL)")
def sources_loaded(spark, d):
    """The registry of trusted sources through its file; the table is fixed and small."""
    import os
    import tempfile

    rows = table(spark, d, "trusted_sources").where("site_key is not null").select("site_key", "urls").collect()
    with tempfile.TemporaryDirectory() as folder:  # read by the driver alone
        path = os.path.join(folder, "sources.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({r["site_key"]: r["urls"] or [] for r in rows}, f)
        return readers.load_sources(spark, path).select("domain", F.explode("urls").alias("url"))


def _job(spark: SparkSession, d: str) -> str:
    """The extraction job over all addresses; the folder with its results."""
    import uuid

    at = f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
    urls = table(spark, d, "scraped_pages").select("url").distinct()
    agents.extraction_job(urls, lambda url: None if "7" in url else f"? up to 5 EUR at {url}" if "9" in url else f"{url}\nup to 5 EUR", Rule(_extraction_reply), at, retries=0)
    return at


@query("SELECT DISTINCT url, url AS programme_name, '100 EUR' AS total_budget FROM scraped_pages WHERE NOT contains(url, '7') AND NOT contains(url, '9')")
def job_records(spark, d):
    return spark.read.json(f"{_job(spark, d)}/records").select("url", "programme_name", "total_budget")


@query("SELECT DISTINCT url, CASE WHEN contains(url, '7') THEN 'unread' ELSE 'shape' END AS status FROM scraped_pages WHERE contains(url, '7') OR contains(url, '9')")
def job_rejected(spark, d):
    """Dead letters: addresses without text, and replies that are no array of objects."""
    return spark.read.json(f"{_job(spark, d)}/rejected").select("url", "status")


@query("SELECT page_id, page_text, replace(replace(url, 'https://', ''), '/', '_') || '_scraped.txt' AS name FROM scraped_pages")
def texts_written(spark, d):
    import uuid

    at = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    readers.write_text(table(spark, d, "scraped_pages").select("page_id", "url", "page_text"), at)
    return spark.read.parquet(at).select("page_id", "page_text", F.regexp_replace("artifact_name", r"^\d{8}T\d{6}Z_", "").alias("name"))


@query("SELECT record_id AS conv_id, 'read' || length(coalesce(description, '')) || 'characters' AS text FROM ideal_anav")
def stage_pieces(spark, d):
    """A stage whose backend streams: its pieces, put together again."""
    t = table(spark, d, "ideal_anav").select(F.col("record_id").alias("conv_id"), F.lit(0).alias("turn"), chat.prompt_list(F.lit("s"), F.coalesce("description", F.lit(""))).alias("messages"))
    pieces = model_stage.streamed(t, "messages", Rule(lambda m: f"read {len(_last(m))} characters"))
    return chat.rebuild_messages(pieces.where("chunk is not null"), ("conv_id",))


@query("SELECT record_id, CASE WHEN contains(coalesce(programme_name, ''), '7') THEN 'internet' ELSE 'no_internet' END AS route, CASE WHEN contains(coalesce(programme_name, ''), '7') THEN 'online answer' ELSE 'chat answer' END AS reply FROM ideal_anav")
def agent_by_route(spark, d):
    """A model chooses who answers."""

    def reply(messages):
        said = _last(messages)
        if messages[0]["content"].startswith("Turn the question"):
            return json.dumps({"search_query": said})
        if "Found pages as JSON:" in said:
            return json.dumps({"url": "https://found.example"})
        return "online answer" if said.startswith("From what was found online") else "chat answer"

    t = table(spark, d, "ideal_anav").select("record_id", F.coalesce("programme_name", F.lit("")).alias("prompt"))
    hits = lambda q: q.select("record_id", F.lit(1).alias("rank"), F.lit("https://found.example").alias("url"), F.lit("t").alias("title"), F.lit("d").alias("description"))
    choose = Rule(lambda m: json.dumps({"function": "internet" if "7" in _last(m) else "no_internet", "parameters": {}}))
    return agents.answer_by_route(t, Rule(lambda m: f"steps for {_last(m)}"), choose, Rule(reply), hits, lambda x: x.withColumn("page_text", F.lit("page")), "record_id")


# ---------------------------------------------------------------- streaming


@query("SELECT doc_id AS conv_id, text FROM documents WHERE text IS NOT NULL")
def stream_messages(spark, d):
    """Document texts as a stream of lines, put together again by the streaming aggregate."""
    import uuid

    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    raw = spark.readStream.schema("doc_id bigint, text string").parquet(f"{d}/documents.parque[t]").where("text is not null")
    lines = F.split("text", r"(?<=\n)")
    pieces = raw.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.size(lines).alias("n"), F.posexplode(lines).alias("seq", "chunk"))
    pieces = pieces.select("conv_id", "turn", F.col("seq").cast("bigint").alias("seq"), "chunk", (F.col("seq") == F.col("n") - 1).alias("done"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    q = message_log(pieces).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("conv_id bigint, turn bigint, text string").parquet(f"{at}/out/*").select("conv_id", "text")
