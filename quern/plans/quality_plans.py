"""Quality queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import quality
from quern.runtime import fresh_folder, table
from quern.sources.versioned import VersionedTable


def _docs(spark, folder):
    return table(spark, folder, "documents")


def _r6(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


RATIOS = r"""
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(t) - length(replace(t, ' ', '')) AS spaces,
  length(regexp_replace(t, '\s+', '', 'g')) AS text_chars,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM d),
l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(ls, lambda x: length(x) >= 8)) AS line FROM b) GROUP BY ALL),
rep AS (SELECT doc_id, sum(CASE WHEN n > 2 THEN n ELSE 0 END) / sum(n) AS rr FROM l GROUP BY doc_id),
r AS (SELECT b.doc_id, letters, spaces, text_chars, CASE WHEN letters > 0 THEN spaces / letters ELSE 0.0 END AS space_ratio, coalesce(rr, 0.0) AS repeated_line_ratio,
  CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda x: lower(regexp_replace(regexp_extract(x, '^(\S+)', 1), '^[`|]+|[`|]+$', '', 'g')) IN ('set','show','delete','edit','commit','request','clear')
    OR starts_with(x, '|') OR regexp_matches(x, '\s{2,}\S'))) / len(ls) ELSE 0.0 END AS structured_ratio
  FROM b LEFT JOIN rep USING (doc_id))
"""
STATUS = """CASE WHEN text_chars < 400 OR letters < 80 THEN 'fail' WHEN repeated_line_ratio >= 0.45 THEN 'fail'
  WHEN space_ratio < {t} AND structured_ratio < 0.7 THEN 'fail' WHEN space_ratio < {t} THEN 'review' ELSE 'pass' END"""
REASON = """CASE WHEN text_chars < 400 OR letters < 80 THEN 'almost no extractable text' WHEN repeated_line_ratio >= 0.45 THEN 'text is mostly repeated headers or footers'
  WHEN space_ratio < {t} AND structured_ratio < 0.7 THEN 'space-to-letter ratio indicates stripped spaces' WHEN space_ratio < {t} THEN 'low space ratio in mostly structured text' ELSE 'source text passed quality checks' END"""
GATE = """SELECT doc_id, status, CAST(CASE WHEN status = 'pass' THEN 100 ELSE greatest(0, 100 - CASE WHEN space_ratio < {t} THEN 45 ELSE 0 END
  - CASE WHEN text_chars < 400 THEN 35 ELSE 0 END - CAST(floor(repeated_line_ratio * 50) AS INT)) END AS INT) AS score, status <> 'pass' AS blocked, reason
  FROM (SELECT *, """ + STATUS + " AS status, " + REASON + " AS reason FROM r{more})"
CALIBRATED = """,
s AS (SELECT DISTINCT space_ratio AS v FROM r WHERE space_ratio >= 0.01),
g AS (SELECT v AS lo, lead(v) OVER (ORDER BY v) AS hi FROM s),
th AS (SELECT least(0.09, greatest(0.035, coalesce((SELECT (lo + hi) / 2 FROM g WHERE hi IS NOT NULL AND lo <= 0.14 ORDER BY hi - lo DESC, lo DESC LIMIT 1), 0.08))) AS threshold)
"""
POINTS = "(VALUES (0), (5), (25), (50), (75), (95), (100))"


def quarantined(s, f):
    """The documents that are blocked, kept in a table and read back."""
    kept = VersionedTable(s, fresh_folder(s, "quarantine"))
    quality.quarantine(_docs(s, f), kept)
    return kept.read().select("doc_id", "status", "reason")


QUERIES = {
    "q_source_ratios": lambda s, f: _r6(quality.ratios(_docs(s, f)), "space_ratio", "repeated_line_ratio", "structured_ratio"),
    "q_quality_gate_fixed": lambda s, f: quality.gate(_docs(s, f)),
    "q_quality_gate_calibrated": lambda s, f: quality.gate(_docs(s, f), None),
    "q_quarantine": quarantined,
    "q_quality_status_counts": lambda s, f: quality.gate(_docs(s, f)).groupBy("status").agg(F.count("*").alias("documents"), F.sum("score").alias("scores")),
    "q_ratio_distribution": lambda s, f: _r6(quality.percentiles(quality.ratios(_docs(s, f)), "space_ratio"), "value"),
    "q_vocabulary": lambda s, f: quality.vocabulary(_docs(s, f)),
    "q_gate_vs_stored": lambda s, f: quality.gate(_docs(s, f)).join(
        table(s, f, "source_quality").where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.lower(F.trim("status")), F.struct("updated_at", "score", "status")).alias("stored")), "doc_id"
    ).groupBy("status", "stored").agg(F.count("*").alias("documents")),
    "q_token_cost": lambda s, f: _docs(s, f).groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("-")).alias("source")).agg(F.sum(T.token_cost(F.col("text"))).alias("tokens"), F.count("*").alias("documents")),
    "q_catalog_search": lambda s, f: table(s, f, "source_document").where(F.lower(F.concat_ws(" ", "document_key", "title", "category", "source_pdf")).contains("release")).select("document_key", "title", "category", "updated_at"),
}
SQL = {
    "q_quarantine": "SELECT doc_id, status, reason FROM (WITH " + RATIOS + GATE.format(t="0.08", more="") + ") WHERE blocked",
    "q_source_ratios": "WITH " + RATIOS + " SELECT doc_id, letters, spaces, text_chars, round(space_ratio, 6) AS space_ratio, round(repeated_line_ratio, 6) AS repeated_line_ratio, round(structured_ratio, 6) AS structured_ratio FROM r",
    "q_quality_gate_fixed": "WITH " + RATIOS + GATE.format(t="0.08", more=""),
    "q_quality_gate_calibrated": "WITH " + RATIOS + CALIBRATED + GATE.format(t="threshold", more=", th"),
    "q_quality_status_counts": "SELECT status, count(*) AS documents, sum(score) AS scores FROM (WITH " + RATIOS + GATE.format(t="0.08", more="") + ") GROUP BY status",
    "q_ratio_distribution": "WITH " + RATIOS + f", o AS (SELECT space_ratio, row_number() OVER (ORDER BY space_ratio) - 1 AS k, count(*) OVER () AS n FROM r) SELECT p AS point, round(space_ratio, 6) AS value FROM {POINTS} q(p) JOIN o ON k = CAST(round_even(p / 100 * (n - 1), 0) AS BIGINT)",
    "q_vocabulary": r"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS word FROM documents) GROUP BY word",
    "q_gate_vs_stored": "WITH " + RATIOS + ", g AS (" + GATE.format(t="0.08", more="") + "), s AS (SELECT doc_id, lower(trim(status)) AS stored FROM source_quality WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC NULLS LAST, score DESC NULLS LAST, status DESC) = 1) SELECT status, stored, count(*) AS documents FROM g JOIN s USING (doc_id) GROUP BY ALL",
    "q_token_cost": "SELECT coalesce(lower(trim(source)), '-') AS source, CAST(sum(ceil(length(coalesce(text, '')) / 4)) AS BIGINT) AS tokens, count(*) AS documents FROM documents GROUP BY 1",
    "q_catalog_search": "SELECT document_key, title, category, updated_at FROM source_document WHERE contains(lower(concat_ws(' ', document_key, title, category, source_pdf)), 'release')",
}
