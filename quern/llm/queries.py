"""Queries over the driver tables for the operators of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import history, leakage, mixing, pieces, quality, residue, scanned, spans, survivors
from quern.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scanned.noise(table(spark, folder, "rewrite_packet"))


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scanned.repair(table(spark, folder, "rewrite_packet"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(table(spark, folder, "documents"))


def p2_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_types(table(spark, folder, "documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.chosen(table(spark, folder, "source_part"), table(spark, folder, "source_root")).select("document_key", "field_name", "part_id")


P3_FOUND = r"""
WITH n AS (
  SELECT * FROM source_part WHERE document_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY document_key, part_key ORDER BY scanned_at DESC NULLS LAST, part_id DESC) = 1),
g AS (SELECT document_key FROM n GROUP BY document_key HAVING count(*) >= 2),
r AS (
  SELECT n.*, s.root_rank FROM n JOIN g USING (document_key)
  LEFT JOIN source_root s ON s.root_name = regexp_replace(lower(trim(n.root_name)), '[_\s]+', '-', 'g')),
v AS (
  SELECT *, regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}]', '', 'g'), '\p{N}+$', '') AS t,
    regexp_replace(lower(title), '[^\p{L}\p{N}]', '', 'g') AS tb,
    regexp_replace(regexp_replace(lower(source_pdf), '[^\p{L}\p{N}]', '', 'g'), '\p{N}+$', '') AS p,
    regexp_replace(lower(source_pdf), '[^\p{L}\p{N}]', '', 'g') AS pb FROM r),
bad AS (SELECT unnest(['na','nan','nil','none','null','unknown','unnamed','untitled','tbd','tba','todo','notitle','noname','novalue','missing','undefined',
  'notavailable','notapplicable','notset','empty','blank','placeholder','tobedetermined','tobedefined']) AS w),
f AS (
  SELECT *, 'text' AS field_name FROM v WHERE regexp_matches(body, '[\p{L}\p{N}]')
  UNION ALL SELECT *, 'title' FROM v WHERE tb <> '' AND (t = '' OR t NOT IN (SELECT w FROM bad))
  UNION ALL SELECT *, 'source_pdf' FROM v WHERE pb <> '' AND (p = '' OR p NOT IN (SELECT w FROM bad))
  UNION ALL SELECT *, 'pages' FROM v WHERE pages > 0)
SELECT document_key, field_name, part_id FROM f
QUALIFY row_number() OVER (PARTITION BY document_key, field_name ORDER BY root_rank DESC NULLS LAST, coalesce(has_front_matter, 0) DESC,
  coalesce(text_chars, 0) DESC, scanned_at DESC NULLS LAST, part_id) = 1
"""


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.survivors(table(spark, folder, "source_part"), table(spark, folder, "source_root"))


def p3_marks(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.marks(table(spark, folder, "source_part"), table(spark, folder, "source_root"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.duplicates(table(spark, folder, "source_part"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.found(table(spark, folder, "rewrite_packet"))


P5_FOUND = r"""
WITH t AS (SELECT DISTINCT packet_id, source_segment AS s FROM rewrite_packet WHERE packet_id IS NOT NULL AND length(source_segment) > 3000),
m AS (SELECT packet_id, list_max(list_transform(string_split_regex(s, '\n\s*\n'), lambda x: length(trim(x, chr(32) || chr(9) || chr(10) || chr(13))))) AS blank,
  list_max(list_transform(string_split(s, chr(10)), lambda x: length(trim(x, chr(32) || chr(9) || chr(13))))) AS line, list_max(list_transform(string_split_regex(s, '\s+'), lambda x: length(x))) AS word FROM t)
SELECT packet_id, CASE WHEN blank <= 2800 THEN 'blank_line' WHEN line <= 2800 THEN 'line_break' WHEN word <= 2800 THEN 'space' ELSE 'none' END AS coarsest_cut FROM m
"""


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.pieces(table(spark, folder, "rewrite_packet"), table(spark, folder, "source_document"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.pairs(table(spark, folder, "knowledge_card"), table(spark, folder, "similarity_input")).select("card_id", "input_id")


P7_FOUND = r"""
WITH c AS (SELECT card_id, regexp_extract_all(lower(fact), '[\p{L}\p{N}]+') AS w FROM knowledge_card),
s AS (SELECT input_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM (SELECT input_id, unnest(source_segments) AS t FROM similarity_input)),
cw AS (SELECT DISTINCT card_id, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT card_id, w, unnest(range(1, len(w) - 11)) AS i FROM c)),
sw AS (SELECT DISTINCT input_id, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT input_id, w, unnest(range(1, len(w) - 11)) AS i FROM s))
SELECT DISTINCT card_id, input_id FROM cw JOIN sw USING (g)
"""


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shares(table(spark, folder, "knowledge_card"), table(spark, folder, "similarity_input"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p8_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.overlaps(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


P8_FOUND = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_item),
dw AS (SELECT doc_id, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
ew AS (SELECT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)
"""


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[1]


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[0]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents")).select("doc_id", "residue_kind")


def p10_clean(spark: SparkSession, folder: str) -> DataFrame:
    return residue.without_residue(table(spark, folder, "documents")).select("doc_id", "source", "lang", "n_chars")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_repaired": p1_repaired, "p2_found": p2_found, "p2_statistics": p2_statistics, "p3_found": p3_found, "p3_survivors": p3_survivors, "p3_marks": p3_marks, "p4_found": p4_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p7_found": p7_found, "p7_shares": p7_shares, "p8_found": p8_found, "p8_overlaps": p8_overlaps, "p9_mixture": p9_mixture, "p9_report": p9_report, "p10_found": p10_found, "p10_clean": p10_clean}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND, "p5_found": P5_FOUND, "p7_found": P7_FOUND, "p8_found": P8_FOUND}
