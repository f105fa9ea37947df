"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lychnos.llm import mixing, mojibake, pages, residue, survivors, tokens
from lychnos.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_pages(table(spark, sf_dir, "scraped_pages")).select("page_id")


def p1_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out quality of the residue classifier on unseen hosts."""
    return residue.validation(table(spark, sf_dir, "scraped_pages"))


#: What TESTDATA fixes for p2_found: completeness, trust, recency; then the smaller record id.
FIXED_ORDER = ("n_items", "trust", "extracted_at")
#: Truth discovery decides after it, between the values of the surviving record; before the record id it would break that order.
FOUND_ORDER = (*FIXED_ORDER, "record_id", "support")


def _survivors(spark: SparkSession, sf_dir: str, prefer: tuple[str, ...]) -> DataFrame:
    sources = table(spark, sf_dir, "trusted_sources")
    tables = [(table(spark, sf_dir, "anav_llama3b"), ["programme_name"]), (table(spark, sf_dir, "ideal_anav"), ["description", "eligibility_criteria"])]
    return survivors.best_representatives(tables, sources, prefer, whole_texts=["description"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir, FOUND_ORDER).select("call_id", "field_name", "record_id")


def p2_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors where the support found by truth discovery comes first."""
    return _survivors(spark, sf_dir, ("support", *FIXED_ORDER)).drop("value_key")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_body(table(spark, sf_dir, "scraped_pages"))


def p5_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree over blocks and its quality on held-out labelled sites."""
    return pages.tree_validation(spark)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: encoded, then decoded from raw bytes."""
    return tokens.decode(p7_ids(spark, sf_dir), "doc_id")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_validation, p2_found, p2_supported, p5_found, p5_validation, p7_ids, p7_decoded, p8_mix, p8_shares, p9_found, p9_repaired)}
_STANDS = ", ".join(f"'{x}'" for x in survivors.STAND_INS)
_FOLD = r"lower(regexp_replace({0}, '[\s\x{{a0}}]+', '', 'g'))"
_USABLE = r"(regexp_matches({0}, '[\p{{L}}\p{{N}}]') AND " + _FOLD + f" NOT IN ({_STANDS}))"
_STEM = r"regexp_replace(description, '^[\s\x{a0}]+|[\s\x{a0}.…()\[\]]+$', '', 'g')"
P2_SQL = f"""
WITH texts AS (SELECT call_id, record_id, {_STEM} AS stem FROM ideal_anav WHERE {_USABLE.format("description")}),
begun AS (SELECT DISTINCT a.call_id, a.record_id FROM texts a JOIN texts b ON a.call_id = b.call_id AND length(b.stem) > length(a.stem) AND starts_with(b.stem, a.stem)),
items AS (SELECT call_id, record_id, len(list_distinct(list_filter(list_transform(eligibility_criteria, lambda x: {_FOLD.format("x")}), lambda x: {_USABLE.format("x")}))) AS k FROM ideal_anav),
claims AS (
  SELECT 'programme_name' AS field_name, call_id, record_id, site_key, extracted_at, 1 AS k FROM anav_llama3b WHERE {_USABLE.format("programme_name")}
  UNION ALL SELECT 'description', call_id, record_id, site_key, extracted_at, 1 FROM ideal_anav WHERE {_USABLE.format("description")} AND record_id NOT IN (SELECT record_id FROM begun)
  UNION ALL SELECT 'eligibility_criteria', r.call_id, r.record_id, r.site_key, r.extracted_at, i.k FROM ideal_anav r JOIN items i USING (record_id) WHERE i.k > 0),
groups AS (
  SELECT 'anav' AS t, call_id FROM anav_llama3b WHERE trim(call_id) <> '' GROUP BY call_id HAVING count(DISTINCT record_id) > 1
  UNION ALL SELECT 'ideal', call_id FROM ideal_anav WHERE trim(call_id) <> '' GROUP BY call_id HAVING count(DISTINCT record_id) > 1),
ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.field_name, c.call_id ORDER BY k DESC, coalesce(t.trust_level, 0) DESC, extracted_at DESC, record_id) AS place
  FROM claims c LEFT JOIN trusted_sources t USING (site_key)
  JOIN groups g ON g.call_id = c.call_id AND g.t = CASE WHEN c.field_name = 'programme_name' THEN 'anav' ELSE 'ideal' END)
SELECT call_id, field_name, record_id FROM ranked WHERE place = 1
"""
ORACLES = {"p2_found": P2_SQL, "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
