"""Inputs: PDF files, web pages, the registry of trusted sources, templates; and sinks for results.

Whatever needs the network or a foreign library is a callable that the caller may inject, and errors
stay with their row. For plain fetching there are defaults on the standard library.
"""

from __future__ import annotations

import json
import logging
import os
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lychnos.functions.html import body_text, needs_scripts, page_info
from lychnos.functions.schema import ARRAY_FIELDS, EXTRACTION_FIELDS
from lychnos.functions.text import artifact_name, is_pdf_url
from lychnos.sources.tables import shared_checkpoint

log = logging.getLogger("lychnos")

PageExtractor = Callable[[bytes], list[str]]
SiteReader = Callable[[str], str | None]
Fetcher = Callable[[str], bytes]
Searcher = Callable[[DataFrame], DataFrame]
PageFetcher = Callable[[str], str | None]

AGENT = "Mozilla/5.0 (compatible; page reader)"


def fetch_bytes(url: str, timeout: float = 20.0) -> bytes:
    """The default fetcher of files such as PDFs."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as r:
        return r.read()


def fetch_html(url: str, timeout: float = 5.0) -> str:
    """The default fetcher of pages, read in the encoding that the server names."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", errors="replace")


def fetched(urls: DataFrame, fetch: PageFetcher = fetch_html, url_col: str = "url", out: str = "html") -> DataFrame:
    """``urls`` with ``out`` and ``<out>_error``; null addresses are not fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, errors = [], []
            for url in b.column(b.schema.get_field_index(url_col)).to_pylist():
                page = error = None
                if url:
                    try:
                        page = fetch(url)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                got.append(page)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, out, f"{out}_error"])

    return urls.mapInArrow(run, StructType([*urls.schema.fields, StructField(out, StringType()), StructField(f"{out}_error", StringType())]))


def read_hybrid(urls: DataFrame, fetch: PageFetcher = fetch_html, browse: PageFetcher | None = None, url_col: str = "url") -> DataFrame:
    """``urls`` with ``page_text``, ``by`` (``plain``, ``browser`` or null) and ``read_error``.

    Pages are fetched plainly; those that want scripts, or have no text, or could not be fetched go
    on to ``browse``, which gives rendered HTML. Detection and text are native; a page that both fail
    to read has a null text and the last error.
    """
    first = shared_checkpoint(fetched(urls, fetch, url_col))  # each address is fetched once
    wants = F.coalesce(needs_scripts(F.col("html")), F.lit(True))
    plain = first.where(~wants).select(*urls.columns, body_text(F.col("html")).alias("page_text"), F.lit("plain").alias("by"), F.col("html_error").alias("read_error"))
    rest = first.where(wants)
    if browse is None:
        text = F.when(F.col("html").isNotNull(), body_text(F.col("html")))
        other = rest.select(*urls.columns, text.alias("page_text"), F.when(text.isNotNull(), F.lit("plain")).alias("by"), F.col("html_error").alias("read_error"))
    else:
        shown = fetched(rest.select(*urls.columns), browse, url_col)
        text = body_text(F.col("html"))
        other = shown.select(*urls.columns, text.alias("page_text"), F.when(text.isNotNull(), F.lit("browser")).alias("by"), F.col("html_error").alias("read_error"))
    return plain.unionByName(other)


def hits_with_info(hits: DataFrame, fetch: PageFetcher = fetch_html, url_col: str = "url") -> DataFrame:
    """Search hits with ``info``, the title and description of their page; null where it could not be read. Each address is fetched once, however many hits have it."""
    pages = fetched(hits.select(F.col(url_col).alias("url__")).where("url__ is not null").distinct(), fetch, "url__")
    info = pages.select("url__", page_info(F.col("url__"), F.col("html")).alias("info"))
    return hits.join(info, F.col(url_col) == F.col("url__"), "left").drop("url__")


def read_pdfs(spark: SparkSession, path: str, extract: PageExtractor) -> DataFrame:
    """``(path, text)``: the text of all pages of each file, without separator. ``extract`` gives the pages of one file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return pdf_text(files, extract)


def pdf_text(files: DataFrame, extract: PageExtractor, path_col: str = "path", content_col: str = "content") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for raw in b.column(1).to_pylist():
                try:
                    texts.append("".join(p or "" for p in extract(raw)))
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInArrow(run, "path string, text string, error string")


def read_links(urls: DataFrame, site_reader: SiteReader, pdf_fetcher: Fetcher | None = None, extract: PageExtractor | None = None, url_col: str = "url", retries: int = 2, backoff: float = 1.5) -> DataFrame:
    """``urls`` with ``page_text`` and ``read_error``: PDF addresses through the fetcher, others through the site reader.

    Each address is tried ``retries + 1`` times with a fixed pause; a blank text counts as failure.
    """
    src = urls.withColumn("is_pdf__", F.coalesce(is_pdf_url(F.col(url_col)), F.lit(False)))

    def one(url: str | None, pdf: bool) -> tuple[str | None, str | None]:
        error = "no address"
        for attempt in range(retries + 1 if url else 0):
            if attempt:
                time.sleep(backoff)
            try:
                text = "".join(extract(pdf_fetcher(url))) if pdf and pdf_fetcher and extract else site_reader(url)
                if text and text.strip():
                    return text, None
                error = "no text"
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(url_col)
            got = [one(u, p) for u, p in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=[*b.schema.names[:-1], "page_text", "read_error"])

    return src.mapInArrow(run, StructType([*urls.schema.fields, StructField("page_text", StringType()), StructField("read_error", StringType())]))


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """``(domain, urls)`` of a JSON object from domain to addresses; a missing or broken file gives no rows and a warning."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        rows = [(str(k), [str(u) for u in v]) for k, v in got.items()]
    except (OSError, ValueError, AttributeError, TypeError) as e:
        log.warning("no trusted sources: %s", e)
        rows = []
    return spark.createDataFrame(rows, "domain string, urls array<string>")


def load_template(path: str | None = None) -> tuple[tuple[str, ...], frozenset[str]]:
    """Field names and list fields of an extraction template (a JSON array with one object); the default if there is none."""
    try:
        with open(path or "", encoding="utf-8") as f:
            got = json.load(f)
        if isinstance(got, list) and got and isinstance(got[0], dict):
            return tuple(got[0]), frozenset(k for k, v in got[0].items() if isinstance(v, list))
    except (OSError, ValueError):
        pass
    return EXTRACTION_FIELDS, ARRAY_FIELDS


def load_prompts(path: str, base: Mapping[str, str] | None = None) -> dict[str, str]:
    """Prompt templates of a YAML file ``name: {prompt: text}``, over ``base``; read once."""
    import yaml

    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f) or {}
    return {**(base or {}), **{k: v["prompt"] for k, v in got.items()}}


def write_results(records: DataFrame, rejected: DataFrame, path: str, url_col: str = "url") -> None:
    """Records and dead letters as JSON below ``path``, each row with the artifact name that a single file would have."""
    now = F.current_timestamp()
    records.withColumn("artifact_name", artifact_name(F.col(url_col), now, "_extracted.json")).write.mode("overwrite").json(os.path.join(path, "records"))
    rejected.withColumn("artifact_name", artifact_name(F.col(url_col), now, "_raw_llm_output.txt")).write.mode("overwrite").json(os.path.join(path, "rejected"))


def write_text(pages: DataFrame, path: str, url_col: str = "url") -> None:
    """Scraped texts, kept before they are read further, as parquet."""
    pages.withColumn("artifact_name", artifact_name(F.col(url_col), F.current_timestamp(), "_scraped.txt")).write.mode("overwrite").parquet(path)
