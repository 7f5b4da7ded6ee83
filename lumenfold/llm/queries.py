"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm.decontam import op4_decontamination
from lumenfold.llm.language_crf import op9_language_id
from lumenfold.llm.licenses import op5_license_scan, op5_sql
from lumenfold.llm.mixing import op3_source_mixing
from lumenfold.llm.pii import op10_pii
from lumenfold.llm.quality import base_counts, op2_quality_rules
from lumenfold.llm.secret_scan import op8_secret_scan
from lumenfold.llm.simhash import op6_simhash_dedup
from lumenfold.llm.token_counts import op7_token_counts
from lumenfold.llm.url_filter import RULES, op1_url_filter


def _over(op: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


def _columns(op: Callable[..., DataFrame], table: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _over(op, table)(spark, sf_dir).select(*names)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": _over(op1_url_filter, "pages"),
        "op2_quality_rules": _over(op2_quality_rules, "documents"),
        "op3_source_mixing": _over(op3_source_mixing, "documents"),
        "op4_decontamination": _over(op4_decontamination, "documents", "benchmark"),
        "op5_license_scan": _over(op5_license_scan, "documents"),
        "op6_simhash_dedup": _over(op6_simhash_dedup, "documents"),
        "op7_token_counts": _over(op7_token_counts, "documents"),
        "op8_secret_scan": _over(op8_secret_scan, "documents"),
        "op9_language_id": _over(op9_language_id, "documents"),
        "op10_pii": _over(op10_pii, "documents"),
        # the columns of four operators that SQL can express
        "url_rules": _columns(op1_url_filter, "pages", "page_id", "host", "path", "rule"),
        "quality_base_counts": _columns(base_counts, "documents", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
        "secret_base_spans": _columns(op8_secret_scan, "documents", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"),
        "personal_base_spans": _columns(op10_pii, "documents", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"),
    }


OP4_SQL = """
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM low),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bwin),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, item_id, dwin.n, i FROM dwin JOIN bwin USING (win) WHERE dwin.n = bwin.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


def _url_sql() -> str:
    low = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    cases = " ".join(f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}') THEN '{d}{p}'" for d, p, _ in rules)
    return f"""WITH u AS (SELECT page_id, {low} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {cases} END AS rule FROM u"""


QUALITY_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
five AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM five) WHERE n > 1),
spread AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN spread USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c"""


def _spans_sql(kinds: dict[str, tuple[str, str]], order: str) -> str:
    """Counts and hash of the matches of each kind's pattern that fulfil its condition on m; offsets are the lengths of what lies before."""
    parts = []
    for k, (kind, (pattern, holds)) in enumerate(kinds.items()):
        quoted = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {k} AS k, m, a AS start, a + length(m) AS stop FROM (
  SELECT doc_id, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a
  FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS ms, regexp_split_to_array(t, '{quoted}') AS gaps FROM d WHERE regexp_matches(t, '{quoted}')))) WHERE {holds}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    none = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in kinds)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY {order}) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, {none}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)"""


_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""^(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""".replace("'", "''")
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"(list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN ({_DIGITS})[i]::INT ELSE 2 * ({_DIGITS})[i]::INT - CASE WHEN ({_DIGITS})[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"
SECRET_KINDS = {"assign": (_ASSIGN, f"length(regexp_extract(m, '{_VALUE}', 1)) >= 6"), "access": ("AKIA[A-Z0-9]+", "length(m) >= 20"), "hex": ("[0-9a-f]+", "length(m) >= 24")}
PERSONAL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INT), 0) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": OP4_SQL, "op5_license_scan": op5_sql(), "url_rules": _url_sql(), "quality_base_counts": QUALITY_SQL,
        "secret_base_spans": _spans_sql(SECRET_KINDS, "start, k"), "personal_base_spans": _spans_sql(PERSONAL_KINDS, "k, start"),
    }
