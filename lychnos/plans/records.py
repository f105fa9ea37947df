"""Queries over the record tables: packed fields, quantities and drifting files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from lychnos.functions.schema import EXTRACTION_FIELDS
from lychnos.operators import drift, packed, quantities
from lychnos.sources.tables import table

RECORD_TABLES = ("anav_llama3b", "ideal_anav", "ideal_hlektra")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hlektra = packed.split_packed(table(spark, sf_dir, "ideal_hlektra"), "record_id", ["eligible_parties", "funding_sources", "contact_info"], "ingested_at")
    anav = packed.split_packed(table(spark, sf_dir, "anav_llama3b"), "record_id", ["contact_info"], "ingested_at")
    return hlektra.unionByName(anav)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = table(spark, sf_dir, "fx_rates")
    return reduce(DataFrame.unionByName, (quantities.normalised_quantities(table(spark, sf_dir, t), fx) for t in RECORD_TABLES))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "record_files"))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.union_records(table(spark, sf_dir, "record_files"), list(EXTRACTION_FIELDS))


def p6_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.type_alternatives(table(spark, sf_dir, "record_files"))


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p6_found, p6_records, p6_alternatives)}
#: Every value with its path from the JSON functions of SQL; names of word characters are not quoted.
_ALTERNATIVES = r"""
WITH lines AS (SELECT feed_id, file_id, exported_at, CASE WHEN json_valid(raw_json) THEN raw_json END AS j FROM record_files),
nodes AS (SELECT l.feed_id, l.file_id, l.exported_at, regexp_replace(t.fullkey, '"([\p{L}\p{N}_]+)"', '\1', 'g') AS place, t.type, CASE WHEN t.type = 'ARRAY' THEN list_transform(json_extract(t.value, '$[*]'), lambda x: json_type(x)) END AS inner_types
  FROM lines l, json_tree(l.j) t WHERE json_type(l.j) = 'OBJECT' AND t.fullkey <> '$'),
kinds AS (SELECT feed_id, file_id, exported_at, regexp_extract(place, '^\$\.([^.\[]+)', 1) AS name, regexp_replace(regexp_replace(place, '^\$\.[^.\[]+', ''), '\[\d+\]', '[]', 'g') AS path,
  CASE type WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'true/false' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL
    WHEN 'ARRAY' THEN CASE WHEN len(inner_types) = 0 THEN NULL WHEN list_contains(inner_types, 'OBJECT') THEN 'list of objects' ELSE 'list of texts' END ELSE 'number' END AS kind FROM nodes)
SELECT feed_id, name, path, kind, count(DISTINCT (file_id, exported_at)) AS n_files, min(exported_at) AS first_file_time FROM kinds WHERE kind IS NOT NULL GROUP BY ALL
"""

#: Signs of scales and currencies around a number, looked for in this order: a plain way beside the automaton, for the forms that the tables hold.
_SCALE_SIGNS = ((9, "δισ|billion|bn"), (6, "εκ\\.|εκατ|million|mln|meur|(?:^|[^\\p{L}])m(?:[^\\p{L}]|$)"), (3, "χιλ|thousand|τ\\.|keur|(?:^|[^\\p{L}])k(?:[^\\p{L}]|$)"), (-2, "cent"))
_CURRENCY_SIGNS = (
    ("USD", "\\$|usd|dollar|δολάρ"), ("GBP", "£|gbp|pound|στερλίν"), ("CHF", "chf|swiss|ελβετικ"), ("SEK", "sek|swedish|σουηδικ"), ("NOK", "nok|norwegian|νορβηγικ"),
    ("DKK", "dkk|danish|δανικ|δανίας"), ("PLN", "pln|zł|zloty|ζλότι"), ("BGN", "bgn|лв|lev|λέβα"), ("EUR", "€|eur|ευρώ|cent"),
)


def _cases(text: str, signs: tuple, literal) -> str:
    return f"CASE {' '.join(f'WHEN regexp_matches({text}, {chr(39)}{pattern}{chr(39)}) THEN {literal(v)}' for v, pattern in signs)} END"


def _quantities_sql() -> str:
    texts = "concat_ws(chr(10), description, programme_objective, funding_coverage, application_process, additional_details)"
    rows = []
    for t in RECORD_TABLES:
        for f in (*quantities.AMOUNT_FIELDS, *quantities.RATE_FIELDS):
            rows.append(f"SELECT record_id, '{f}' AS field_name, lower(regexp_replace(replace({f}, chr(160), ' '), '\\([^()]*\\)', ' ', 'g')) AS s, {texts} AS notes, ingested_at FROM {t} WHERE regexp_matches({f}, '\\d')")
    written = "'\\d+(?:[., ]\\d{3})*(?:[.,]\\d+)?'"
    general = "CASE WHEN regexp_matches(notes, '(?i)amounts are in thousand|sums above in €k|τιμές σε χιλ|ποσά δίνονται σε χιλιάδες') THEN 3 ELSE 0 END"
    budget = "CASE WHEN field_name = 'total_budget' AND regexp_matches(notes, 'quoted in millions of euro|αναφέρεται σε εκατομμύρια ευρώ') THEN 6 END"
    stated = "nullif(regexp_extract(notes, '(?:[Aa]mounts in|Ποσά σε|[Ππ]οσά εκφράζονται σε [^.(]*\\() ?([A-Z]{3})\\b', 1), '')"
    number = "CAST(CASE WHEN regexp_matches(num, '[.,]\\d{3}$') OR NOT regexp_matches(num, '[.,]\\d+$') THEN regexp_replace(num, '[^0-9]', '', 'g') ELSE regexp_replace(regexp_extract(num, '^(.*)[.,]\\d+$', 1), '[^0-9]', '', 'g') || '.' || regexp_extract(num, '\\d+$') END AS DOUBLE)"
    return f"""
WITH fields AS ({' UNION ALL '.join(rows)}),
amounts AS (SELECT *, regexp_extract(s, {written}) AS num, replace(s, regexp_extract(s, {written}), ' ') AS around FROM fields WHERE field_name <> 'interest_rate' AND regexp_matches(s, '\\d')),
units AS (SELECT *, {_cases('around', _SCALE_SIGNS, str)} AS scale, {_cases('around', _CURRENCY_SIGNS, lambda c: f"'{c}'")} AS unit FROM amounts),
told AS (SELECT *, CASE WHEN scale IS NULL AND unit IS NULL THEN coalesce({budget}, {general}) ELSE coalesce(scale, 0) END AS power,
  CASE WHEN scale IS NULL AND unit IS NULL AND {budget} IS NULL THEN coalesce({stated}, 'EUR') ELSE coalesce(unit, 'EUR') END AS currency FROM units),
euro AS (SELECT record_id, field_name, ingested_at, floor({number} * pow(10, power) * eur_per_unit + 0.5 + 1e-7) AS v FROM told JOIN fx_rates ON currency = currency_code),
rates AS (SELECT *, replace(regexp_extract(s, '\\d+(?:[.,]\\d+)?'), ',', '.') AS num FROM fields WHERE field_name = 'interest_rate' AND regexp_matches(s, '\\d')),
points AS (SELECT record_id, field_name, ingested_at, floor(CAST(num AS DOUBLE) * CASE WHEN regexp_matches(s, '‰') THEN 10 WHEN regexp_matches(s, 'bp|basis|μονάδ') THEN 1 WHEN regexp_matches(s, '%|per ?cent|pct|τοις εκατ') THEN 100
  WHEN regexp_matches(num, '\\.\\d{{3}}') THEN 10000 ELSE 100 END + 0.5 + 1e-7) AS v FROM rates)
SELECT record_id, field_name, CAST(arg_max(v, ingested_at) AS BIGINT) AS amount_norm FROM (SELECT * FROM euro UNION ALL SELECT * FROM points) GROUP BY record_id, field_name
"""


# A plain way to split, without skeletons: pieces between delimiters outside brackets and quotes, list marks and quotes taken off.
_BLANKS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
_CONTACT = r"(?:\p{L}[\p{L}.]{1,14}[:.] ?)?(?:https?://[^\s\x{a0};,|\"]+|[^\s\x{a0};,|\"@]+@[^\s\x{a0};,|\"@]+|\+\d{1,3}(?: \d{2,4}){2,4}|\d{3}-\d{3}-\d{4})"
_PIECE = r"(?:\([^()]*\)|\"[^\"]*\"|«[^»]*»|“[^”]*”|\d,\d|[^;|,\n\r\t•·(\"«“]|[(\"«“])+"


def _trimmed(e: str) -> str:
    return f"regexp_replace({e}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"


def _pieces_sql(t: str) -> str:
    literal = f"list_transform(regexp_extract_all({t}, '\'\'[^\'\']*\'\'|\"[^\"]*\"'), lambda x: substr(x, 2, length(x) - 2))"
    marked = f"regexp_replace(regexp_replace({t}, '(^|[\\s;,|•])(?:\\d{{1,3}}\\)|\\p{{L}}\\)|\\d{{1,2}}\\.)\\s', '\\1;', 'g'), '\\s/\\s', ';', 'g')"
    cut = f"list_transform(regexp_extract_all({marked}, '{_PIECE}'), lambda x: regexp_replace({_trimmed('x')}, '^[-–*]{_BLANKS}+', ''))"
    contacts = f"regexp_extract_all(x, '{_CONTACT}')"
    more = f"flatten(list_transform({cut}, lambda x: CASE WHEN len({contacts}) > 1 THEN {contacts} ELSE [x] END))"
    return f"CASE WHEN regexp_matches({t}, '^\\[\\s*[\'\'\"].*[\'\'\"]\\s*\\]$') THEN {literal} ELSE {more} END"


def _packed_sql() -> str:
    fields = [("ideal_hlektra", f, f"[{f}]") for f in ("eligible_parties", "funding_sources", "contact_info")] + [("anav_llama3b", "contact_info", "contact_info")]
    latest = " UNION ALL ".join(f"SELECT record_id, '{f}' AS field_name, arg_max({parts}, ingested_at) AS parts FROM {t} GROUP BY record_id" for t, f, parts in fields)
    unquoted = _trimmed(f"regexp_replace({_trimmed('x')}, '^\"([^\"]*)\"$|^«([^«»]*)»$|^“([^“”]*)”$', '\\1\\2\\3')")
    items = f"list_filter(list_transform(flatten(list_transform(list_filter(parts, lambda x: x IS NOT NULL), lambda p: {_pieces_sql(_trimmed('p'))})), lambda x: {unquoted}), lambda x: x <> '')"
    return f"WITH latest AS ({latest}), cut AS (SELECT record_id, field_name, {items} AS items FROM latest) SELECT record_id, field_name, CAST(generate_subscripts(items, 1) AS INTEGER) AS pos, unnest(items) AS item_text FROM cut"


ORACLES: dict[str, str] = {"p3_found": _packed_sql(), "p4_found": _quantities_sql(), "p6_alternatives": _ALTERNATIVES}
