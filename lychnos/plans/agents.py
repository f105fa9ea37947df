"""Composite pipelines: DataFrame in, DataFrame out, one ``with_model`` stage per call of a model.

Every function adds columns to its input and keeps the rest. ``log`` columns hold the messages
that the step adds to a conversation, in order. Replies differ from one asking to the next, so where
a function reads them more than once it writes them down first (``shared_checkpoint``): each row is
asked once, and no row is lost or doubled between two outputs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lychnos.functions.jsonx import bare_json, fenced_code, key, safe_json
from lychnos.functions.schema import ARRAY_FIELDS, EXTRACTION_FIELDS
from lychnos.functions.signature import registry, schema_text
from lychnos.functions.text import truncated
from lychnos.operators.chat import MESSAGES, document_prompt, fill, message, prompt_list, route
from lychnos.operators.extraction import read_records, split_outcomes
from lychnos.operators.fuzzy import match_sources
from lychnos.operators.model_stage import with_model
from lychnos.plans.prompts import ANSWER_USER, EXTRACTION_SYSTEM, EXTRACTION_SYSTEM_PLAIN, EXTRACTION_USER, POINTS_USER, PROMPTS, UNFILLED, Role
from lychnos.sources.readers import SiteReader, read_links, write_results
from lychnos.sources.tables import broadcast_if_small, shared_checkpoint


def _system(name: str, extra: str = "", **values: Column) -> Column:
    if name in UNFILLED:
        return F.lit(PROMPTS[name])
    return fill(PROMPTS[name], {"additional_instructions": F.lit(extra), **values})


def _said(*messages: Column) -> Column:
    return F.array(*messages).cast(MESSAGES)


def ask(df: DataFrame, backend, prompt: str = "prompt", role: Role | str = Role.RESPONDER, extra: str = "", history: str | None = None, images: str | None = None, out: str = "reply", system_prompt: str | None = None, **options) -> DataFrame:
    """One question to a general agent: adds ``out``, its error column and ``log``."""
    system = F.lit(system_prompt) if system_prompt is not None else _system(role.value if isinstance(role, Role) else role, extra)
    pics = F.col(images) if images else None
    ready = df.withColumn("messages__", prompt_list(system, F.col(prompt), F.col(history) if history else None, pics))
    got = with_model(ready, "messages__", backend, out, **options).drop("messages__")
    return got.withColumn("log", _said(message("user", F.col(prompt), pics), message("assistant", F.col(out))))


def chain(df: DataFrame, stages: Sequence[tuple[Role, object]], prompt: str = "prompt") -> DataFrame:
    """Agents one after the other; each reads the reply of the one before. Adds ``reply_1``, ``reply_2``, ..."""
    at = prompt
    for i, (role, backend) in enumerate(stages, 1):
        df = ask(df, backend, at, role, out=f"reply_{i}").drop("log")
        at = f"reply_{i}"
    return df


def detect_objects(df: DataFrame, backend, images: str, objects: Sequence[str] | None = None, criteria: str | None = None) -> DataFrame:
    """``label, location, description`` per found object: a description of the picture, then a choice from it."""
    if (objects is None) == (criteria is None):
        raise ValueError("give either objects or criteria")
    wanted = f"Objects: {', '.join(objects)}" if objects is not None else f"Criteria: {criteria}"
    asked = df.withColumn("question__", F.lit("What is in the picture?"))
    seen = ask(asked, backend, "question__", "ObjectDetector", images=images, out="seen", temperature=0.3)
    second = seen.drop("log").withColumn("question__", F.concat(F.lit(f"{wanted}\nDescription: "), F.coalesce("seen", F.lit(""))))
    got = ask(second, backend, "question__", "ObjectFilterer", out="objects_json", format="json", temperature=0.3).drop("log", "question__")
    kind = "struct<objects:array<struct<label:string,location:string,description:string>>>"
    parsed = F.from_json(safe_json("objects_json"), kind)["objects"]
    return got.withColumn("found__", F.explode_outer(parsed)).select(*got.columns, "found__.*")


def write_python(df: DataFrame, backend, prompt: str = "prompt", history: str | None = None) -> DataFrame:
    """``code`` and ``libraries`` (the parsed reply as JSON). The code is never run."""
    first = ask(df, backend, prompt, "PythonAgent", history=history, out="raw_code").drop("log").withColumn("code", fenced_code(F.col("raw_code")))
    second = ask(first, backend, "code", "ImportExtractor", out="raw_libraries", format="json").drop("log")
    done = second.withColumn("libraries", safe_json("raw_libraries"))
    return done.withColumn("log", _said(message("user", F.col(prompt)), message("assistant", F.col("raw_code")), message("assistant", F.col("raw_libraries"))))


def extract_points(df: DataFrame, backend, info: str, points: Sequence[str], as_json: bool = False, extra: str = "") -> DataFrame:
    """Asked data points from a text; with ``as_json`` also ``points``, a map."""
    user = fill(POINTS_USER, {"info": F.col(info), "points": F.concat_ws(", ", *(F.lit(p) for p in points))})
    got = ask(df.withColumn("question__", user), backend, "question__", "DataExtractorJson" if as_json else "DataExtractor", extra).drop("question__")
    return got.withColumn("points", F.from_json(safe_json("reply"), "map<string,string>")) if as_json else got


def ask_documents(docs: DataFrame, backend, key_col: str, question: str, **columns: str) -> DataFrame:
    """One answer per ``key_col`` from its documents (path, text, pos) and question."""
    return ask(document_prompt(docs, key_col, question_col=question, **columns), backend, "prompt", "DocumentReader")


def choose_function(df: DataFrame, backend, functions: Iterable[Callable], prompt: str = "prompt", history: str | None = None, extra: str = "") -> DataFrame:
    """``function`` and ``parameters`` (JSON) where the reply names a registered function, else null."""
    functions = list(functions)
    system = _system("FunctionCaller", extra, schema=F.lit(schema_text(functions)))
    ready = df.withColumn("messages__", prompt_list(system, F.col(prompt), F.col(history) if history else None))
    got = with_model(ready, "messages__", backend, "raw_response", format="json").drop("messages__").withColumn("parsed__", safe_json("raw_response"))
    known = broadcast_if_small(registry(df.sparkSession, functions).select(F.col("name").alias("function")))
    named = got.withColumn("name__", F.when(key(F.col("parsed__"), "parameters").isNotNull(), key(F.col("parsed__"), "function")))
    return named.join(known, F.col("name__") == F.col("function"), "left").withColumn("parameters", F.when(F.col("function").isNotNull(), key(F.col("parsed__"), "parameters"))).drop("name__", "parsed__")


def ask_website(df: DataFrame, backend, question: str = "question", url: str = "url", content: str = "page_text", history: str | None = None, extra: str = "") -> DataFrame:
    """An answer from one page, whose text was read before (see ``read_links``)."""
    system = _system("WebsiteReader", extra, url=F.col(url), content=F.coalesce(F.col(content), F.lit("Website could not be read")))
    ready = df.withColumn("messages__", prompt_list(system, F.col(question), F.col(history) if history else None))
    got = with_model(ready, "messages__", backend, "reply").drop("messages__")
    return got.withColumn("log", _said(message("user", F.col(question)), message("assistant", F.col("reply"))))


def search_query(df: DataFrame, backend, prompt: str = "prompt") -> DataFrame:
    """``search_query``: the query for a question, null if the reply names none."""
    got = ask(df, backend, prompt, "OnlineSearcher", out="query_json", format="json").drop("log")
    return got.withColumn("search_query", key(safe_json("query_json"), "search_query"))


def search_online(df: DataFrame, backend, searcher: Callable[[DataFrame], DataFrame], reader: Callable[[DataFrame], DataFrame], prompt: str = "prompt", id_col: str = "prompt_id", hits: int = 10, history: str | None = None, extra: str = "") -> DataFrame:
    """Question, query, search, choice of a page, reading, answer: three model stages with joins between them.

    ``searcher`` turns (id, search_query) into (id, rank, url, title, description); ``reader`` adds
    ``page_text`` to rows with ``url``. Questions without a query or a choice get a null answer.
    """
    asked = shared_checkpoint(search_query(df, backend, prompt))
    found = searcher(asked.where("search_query is not null").select(id_col, "search_query")).where(F.col("rank") <= hits)
    listed = found.groupBy(id_col).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url", "title", "description"))), lambda h: F.struct(h["url"].alias("url"), h["title"].alias("title"), h["description"].alias("description")))).alias("urls__"))
    ready = asked.join(listed, id_col, "left")
    picker = fill(PROMPTS["UrlPicker"], {"question": F.col(prompt), "urls": F.coalesce("urls__", F.lit("[]")), "additional_instructions": F.lit(extra)})
    before = F.coalesce(F.col(history), F.array().cast(MESSAGES)) if history else F.array().cast(MESSAGES)
    ready = ready.withColumn("messages__", F.when(F.col("search_query").isNotNull(), F.concat(before, F.array(message("user", picker)))))
    picked = with_model(ready, "messages__", backend, "pick_json", format="json").withColumn("url", key(safe_json("pick_json"), "url")).drop("messages__", "urls__")
    read = reader(shared_checkpoint(picked)).withColumn("final__", fill(ANSWER_USER, {"summary": truncated(F.col("page_text")), "question": F.col(prompt)}))
    read = read.withColumn("final__", F.when(F.col("url").isNotNull(), F.col("final__")))
    system = _system(Role.RESPONDER.value, extra)
    read = read.withColumn("messages__", F.when(F.col("final__").isNotNull(), prompt_list(system, F.col("final__"))))
    done = with_model(read, "messages__", backend, "reply").drop("messages__")
    log = _said(message("user", F.col(prompt)), message("assistant", F.col("query_json")), message("user", picker_text(prompt)), message("assistant", F.col("pick_json")), message("user", F.col("final__")), message("assistant", F.col("reply")))
    return done.withColumn("log", log).drop("final__")


def picker_text(prompt: str) -> Column:
    """What the log keeps of the choice of a page."""
    return F.concat(F.lit("Choose a page for: "), F.col(prompt))


#: Pages and queries in a block of the offline search.
BLOCK_PAGES, BLOCK_QUERIES = 512, 1024


def _words(text: Column) -> Column:
    """Distinct words in lower case; the Greek final sigma is a sigma."""
    return F.array_distinct(F.filter(F.split(F.translate(F.lower(text), "ς", "σ"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def _packed(df: DataFrame, size: int) -> DataFrame:
    """Rows to blocks of at most ``size`` rows, without a shuffle: one array per column."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                whole = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, pa.concat_arrays([c])) for c in part.columns], names=b.schema.names)

    return df.mapInArrow(pack, ", ".join(f"`{c}` array<{t}>" for c, t in df.dtypes))


def page_search(pages: DataFrame, hits: int = 10, url: str = "url", text: str = "page_text") -> Callable[[DataFrame], DataFrame]:
    """An offline searcher over a table of pages: words in common with the query, then the address.

    Every word counts, however short or frequent. Pages and queries meet in blocks, and only the
    best ``hits`` per query leave a pair of blocks, so frequent words give no rows. Of an address
    that stands in several rows the best row counts; pages without an address are no hits.
    """
    from pyspark.sql.window import Window

    title = F.substring_index(F.ltrim(F.col(text)), "\n", 1)
    index = pages.where(F.col(text).isNotNull() & F.col(url).isNotNull()).select(F.col(url).alias("url"), title.alias("title"), _words(F.col(text)).alias("words"))

    def run(queries: DataFrame) -> DataFrame:
        id_col = queries.columns[0]
        asked = shared_checkpoint(queries.where(F.col("search_query").isNotNull()).select(F.col(id_col).alias("id"), _words(F.col("search_query")).alias("terms")))
        asked = shared_checkpoint(_packed(asked.repartition(asked.count() // BLOCK_QUERIES + 1), BLOCK_QUERIES))
        both = _packed(index, BLOCK_PAGES).crossJoin(broadcast_if_small(asked))
        best = both.mapInArrow(_best_pages(hits), f"id {dict(queries.dtypes)[id_col]}, url string, title string, n int")
        score = best.groupBy("id", "url").agg(F.max("n").alias("n"), F.max_by("title", F.struct("n", "title")).alias("title"))
        w = Window.partitionBy("id").orderBy(F.desc("n"), "url")
        ranked = score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= hits)
        return ranked.select(F.col("id").alias(id_col), "rank", "url", "title", F.lit("No description found").alias("description"))

    return run


def _best_pages(hits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a block of pages (url, title, words) and one of queries (id, terms) to the best ``hits`` pages of each query."""

    def block(urls: list[str], titles: list[str], words: pa.ListArray, ids: pa.Array, terms: list[list[str]]) -> pa.RecordBatch:
        of: dict[str, list[int]] = {}
        for q, ws in enumerate(terms):
            for w in ws:
                of.setdefault(w, []).append(q)
        flat = words.flatten()
        code = pc.fill_null(pc.index_in(flat, value_set=pa.array(list(of), pa.string())), -1).to_numpy(zero_copy_only=False)
        page = np.repeat(np.arange(len(urls)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        order = np.argsort(code, kind="stable")
        order = order[code[order] >= 0]
        ends = np.searchsorted(code[order], np.arange(len(of) + 1))
        counts = np.zeros((len(urls), len(terms)), np.int64)
        for k, qs in enumerate(of.values()):
            if ends[k] < ends[k + 1]:
                counts[np.ix_(page[order[ends[k] : ends[k + 1]]], qs)] += 1
        by_url = sorted(range(len(urls)), key=lambda i: urls[i])
        first = [j for j, i in enumerate(by_url) if not j or urls[i] != urls[by_url[j - 1]]]
        counts = np.maximum.reduceat(counts[by_url], first, axis=0)
        said: dict[str, str] = {}
        for i in by_url:
            said[urls[i]] = max(titles[i], said.get(urls[i], titles[i]))
        names = list(said)
        m = len(names)
        key = counts * m + (m - 1 - np.arange(m))[:, None]  # more words, then the smaller address
        top = np.argpartition(-key, hits - 1, axis=0)[:hits] if m > hits else np.tile(np.arange(m)[:, None], (1, len(terms)))
        n = np.take_along_axis(counts, top, 0)
        row, q = np.nonzero(n)
        at = top[row, q]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array([names[i] for i in at], pa.string()), pa.array([said[names[i]] for i in at], pa.string()), pa.array(n[row, q], pa.int32())], names=["id", "url", "title", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                urls, titles, words, ids, terms = (c[i].values for c in b.columns)
                yield block(urls.to_pylist(), titles.to_pylist(), words, ids, terms.to_pylist())

    return run


def extraction_messages(url: Column, content: Column, plain: bool = False, fields: tuple[str, ...] = EXTRACTION_FIELDS, arrays: frozenset[str] = ARRAY_FIELDS) -> Column:
    schema = json.dumps([{f: [] if f in arrays else "" for f in fields}], ensure_ascii=False, indent=2)
    user = fill(EXTRACTION_USER, {"url": url, "content": content, "schema": F.lit(schema)})
    return prompt_list(F.lit(EXTRACTION_SYSTEM_PLAIN if plain else EXTRACTION_SYSTEM), user)


def pages_to_records(pages: DataFrame, backend, url: str = "url", content: str = "page_text", keep: Sequence[str] = (), shape: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Pages to checked records and, apart from them, rejected replies."""
    ready = pages.withColumn("messages__", extraction_messages(F.col(url), F.col(content)))
    replies = with_model(ready, "messages__", backend, "reply", format="json", temperature=0.1).drop("messages__")
    return split_outcomes(read_records(shared_checkpoint(replies), "reply", shape), content, [url, *keep], "reply")


def pages_to_raw_records(pages: DataFrame, backend, url: str = "url", content: str = "page_text", keep: Sequence[str] = ()) -> DataFrame:
    """The variant without checks: fences and prose cut off, the parsed list kept as JSON, ``status`` as for records."""
    ready = pages.withColumn("messages__", extraction_messages(F.col(url), F.col(content), plain=True))
    replies = with_model(ready, "messages__", backend, "reply", format="json", temperature=0.1).drop("messages__")
    shaped = replies.withColumn("cut__", bare_json(F.col("reply")))
    read = read_records(shaped, "cut__")
    return read.select(url, *keep, "status", F.when(F.col("status") == "ok", safe_json("cut__")).alias("result"))


def internet() -> str:
    """Use when the request needs current or outside information."""
    return "internet"


def no_internet() -> str:
    """Use when the request can be answered without outside information."""
    return "no_internet"


def route_by_model(df: DataFrame, planner, chooser, prompt: str = "prompt") -> DataFrame:
    """``plan`` and ``route`` (``internet`` or ``no_internet``): a plan is made, then a function is chosen for it; without a choice no internet."""
    planned = ask(df, planner, prompt, Role.PLANNER, out="plan").drop("log", "plan_error")
    chosen = choose_function(planned, chooser, (internet, no_internet), "plan")
    return chosen.withColumn("route", F.coalesce("function", F.lit("no_internet"))).drop("function", "parameters", "raw_response", "raw_response_error")


def answer_by_route(df: DataFrame, planner, chooser, backend, searcher: Callable[[DataFrame], DataFrame], reader: Callable[[DataFrame], DataFrame], id_col: str = "prompt_id", prompt: str = "prompt") -> DataFrame:
    """``(id_col, route, reply)``: a model chooses the route of each prompt; the search agent answers the ones for the internet, a general agent the rest."""
    routed = shared_checkpoint(route_by_model(df, planner, chooser, prompt))
    online = search_online(routed.where("route = 'internet'"), backend, searcher, reader, prompt, id_col)
    plain = ask(routed.where("route = 'no_internet'"), backend, prompt)
    return online.select(id_col, "route", "reply").unionByName(plain.select(id_col, "route", "reply"))


def answer_turns(turns: DataFrame, sources: DataFrame, backend, searcher: Callable[[DataFrame], DataFrame], reader: Callable[[DataFrame], DataFrame], id_col: str = "prompt_id", prompt: str = "prompt", history: str | None = None) -> DataFrame:
    """``(id_col, route, reply)`` for the inputs of chats: exits and blanks are left out, explicit addresses and
    inputs that resemble a trusted source go online, the rest and whatever found nothing online is plain chat.
    """
    first = match_sources(turns, sources, id_col, prompt).groupBy(id_col).agg(F.min(F.struct("domain", "pos", "url"))["url"].alias("trusted_url"))
    routed = turns.join(first, id_col, "left").withColumn("route", route(F.col(prompt), F.col("trusted_url"))).where(F.col("route").isNotNull())
    online = shared_checkpoint(search_online(routed.where("route = 'online'").drop("trusted_url"), backend, searcher, reader, prompt, id_col, history=history))
    found = online.where("reply is not null").select(id_col, "route", "reply")
    plain = routed.join(found.select(id_col), id_col, "left_anti")
    chat = ask(plain, backend, prompt, history=history).select(id_col, F.lit("chat").alias("route"), "reply")
    return found.unionByName(chat)


def extraction_job(urls: DataFrame, site_reader: SiteReader, backend, path: str, url: str = "url", **reading) -> None:
    """Addresses to records and dead letters on disk: read, extract, check, write. Errors stay with their address."""
    pages = shared_checkpoint(read_links(urls, site_reader, url_col=url, **reading))  # pages are fetched once
    ok, bad = pages_to_records(pages.where("page_text is not null"), backend, url)
    unread = pages.where("page_text is null").select(url, F.lit("unread").alias("status"), F.col("read_error").alias("reply"))
    write_results(ok, bad.unionByName(unread), path, url)
