"""Queries on the structure, overlap, prose and facts of texts, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import extract, graph, overlap, prose, structure, textrules
from quern.runtime import table


def _t(s, f, name):
    return table(s, f, name)


def _rules(s):
    return s.createDataFrame(extract.DOMAINS, "domain string, keyword string, priority int")


def _links(s, f):
    p = _t(s, f, "source_part")
    return p.where("duplicate_of is not null").select(F.col("part_key").alias("src"), F.col("duplicate_of").alias("dst")).distinct()


LINES = """l AS (SELECT packet_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM (SELECT packet_id, string_split(source_segment, chr(10)) AS ls FROM rewrite_packet WHERE source_segment IS NOT NULL)),
a AS (SELECT *, TRY_CAST(nullif(regexp_extract(line, '<!-- page (\\d{1,6}) -->', 1), '') AS INT) AS mark, starts_with(line, '```') AS fence FROM l),
b AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS page, fence OR (sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER w) % 2 = 1 AS fenced FROM a WINDOW w AS (PARTITION BY packet_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, NOT fenced AND regexp_matches(line, '^#{1,6} \\S') AS is_heading FROM b),
d AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY packet_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM c)"""
TOK = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
RUNS = """c AS (SELECT card_id, generated_path, """ + TOK.format(x="fact") + """ AS w FROM knowledge_card WHERE generated_path IS NOT NULL AND fact IS NOT NULL),
s AS (SELECT input_id, generated_path, seg, """ + TOK.format(x="t") + """ AS w FROM (SELECT input_id, generated_path, generate_subscripts(source_segments, 1) AS seg, unnest(source_segments) AS t FROM similarity_input WHERE generated_path IS NOT NULL) WHERE t IS NOT NULL),
cw AS (SELECT card_id, generated_path, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM c)),
sw AS (SELECT input_id, generated_path, seg, j, array_to_string(list_slice(w, j, j + 7), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 6)) AS j FROM s)),
m AS (SELECT card_id, input_id, seg, i, i - j AS diag FROM cw JOIN sw USING (generated_path, g)),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY card_id, input_id, seg, diag ORDER BY i) AS k FROM m),
runs AS (SELECT card_id, input_id, max(n) + 7 AS run FROM (SELECT card_id, input_id, seg, diag, k, count(*) AS n FROM isl GROUP BY ALL) GROUP BY 1, 2)"""
UNITS = extract.UNITS
SIGNAL = "regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"

QUERIES = {
    "q_line_pages": lambda s, f: structure.annotated(_t(s, f, "rewrite_packet"), "packet_id", "source_segment").groupBy("packet_id", F.coalesce("page", F.lit(0)).alias("page")).agg(F.count("*").alias("lines"), F.sum(F.col("fenced").cast("int")).alias("fenced_lines")),
    "q_heading_sections": lambda s, f: structure.sections(_t(s, f, "rewrite_packet"), "packet_id", "source_segment"),
    "q_segment_pack": lambda s, f: structure.packed(_t(s, f, "rewrite_packet"), "packet_id", "source_segment"),
    "q_longest_run": lambda s, f: overlap.longest_runs(_t(s, f, "knowledge_card"), _t(s, f, "similarity_input")),
    "q_overlap_band": lambda s, f: overlap.bands(_t(s, f, "knowledge_card"), _t(s, f, "similarity_input")),
    "q_overlap_counts": lambda s, f: overlap.bands(_t(s, f, "knowledge_card"), _t(s, f, "similarity_input")).groupBy("band").agg(F.count("*").alias("cards")),
    "q_prose_patterns": lambda s, f: prose.pattern_counts(_t(s, f, "documents")),
    "q_prose_sentences": lambda s, f: prose.sentence_rules(prose.sentences(_t(s, f, "documents"))).groupBy("doc_id").agg(
        F.count("*").alias("sentences"), F.sum("words").alias("words"), *[F.sum(F.col(c).cast("int")).alias(c) for c in ("length", "passive", "tense", "cluster")]),
    "q_long_sentences": lambda s, f: prose.sentence_rules(prose.sentences(_t(s, f, "documents"))).where("length").select("doc_id", "no", "words", "mode", "sentence"),
    "q_prose_score": lambda s, f: prose.scores(_t(s, f, "documents")),
    "q_numeric_facts": lambda s, f: extract.numeric_facts(_t(s, f, "rewrite_packet"), "packet_id", "source_segment"),
    "q_unit_totals": lambda s, f: extract.numeric_facts(_t(s, f, "documents"), "doc_id", "text").groupBy("unit").agg(F.count("*").alias("facts"), F.min("value").alias("least"), F.max("value").alias("most")),
    "q_commands": lambda s, f: extract.commands(_t(s, f, "rewrite_packet"), "packet_id", "source_segment"),
    "q_constraints": lambda s, f: extract.constraints(_t(s, f, "documents"), "doc_id", "text"),
    "q_table_cells": lambda s, f: extract.table_cells(_t(s, f, "rewrite_packet"), "packet_id", "source_segment"),
    "q_domain_classify": lambda s, f: extract.classify(_t(s, f, "source_document"), _rules(s), "document_key", [F.col("title"), F.col("source_pdf"), F.col("category")]),
    "q_domain_distribution": lambda s, f: extract.classify(_t(s, f, "source_document"), _rules(s), "document_key", [F.col("title"), F.col("source_pdf"), F.col("category")]).groupBy("domain").agg(F.count("*").alias("documents"), F.round(F.avg("confidence"), 4).alias("confidence")),
    "q_lifecycle": lambda s, f: extract.lifecycle(_t(s, f, "rewrite_packet"), "packet_id", "source_segment"),
    "q_command_coverage": lambda s, f: command_coverage(s, f),
    "q_package_findings": lambda s, f: textrules.package_findings(_t(s, f, "rewrite_packet"), _t(s, f, "knowledge_card"), _t(s, f, "similarity_input")),
    "q_typed_facts": lambda s, f: textrules.typed_facts(_t(s, f, "rewrite_packet"), "packet_id", "source_segment"),
    "q_fence_leaks": lambda s, f: textrules.fence_leaks(_t(s, f, "rewrite_packet"), "packet_id", "source_segment"),
    "q_unfenced_commands": lambda s, f: textrules.unfenced_commands(_t(s, f, "rewrite_packet"), "packet_id", "source_segment"),
    "q_cited_without_section": lambda s, f: _t(s, f, "knowledge_card").select(F.regexp_extract(F.coalesce("citation_key", F.lit("")), r"\[([^\]\s]+)", 1).alias("anchor")).where("anchor <> ''").distinct().join(
        structure.sections(_t(s, f, "rewrite_packet"), "packet_id", "source_segment").select("anchor"), "anchor", "left_anti"),
    "q_reference_bfs": lambda s, f: graph.reachable(_links(s, f), _links(s, f).select(F.col("src").alias("node")), 4),
}


def command_coverage(s, f):
    """Per packet: commands in its text, commands that detected_commands lists, and how many of these the text has."""
    p = _t(s, f, "rewrite_packet")
    have = extract.commands(p, "packet_id", "source_segment").select("packet_id", "command").distinct()
    listed = p.select("packet_id", F.explode_outer(F.array_distinct(F.coalesce("detected_commands", F.array()))).alias("command")).where("command is not null").withColumn("command", F.trim("command")).distinct()
    both = have.withColumn("a", F.lit(1)).join(listed.withColumn("b", F.lit(1)), ["packet_id", "command"], "full")
    return both.groupBy("packet_id").agg(F.count("a").alias("in_text"), F.count("b").alias("listed"), F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)).alias("matched"))


RULES = ", ".join(f"('{d}', '{k}', {p})" for d, k, p in extract.DOMAINS)
CLASSIFY = f"""r(domain, keyword, priority) AS (VALUES {RULES}),
s AS (SELECT DISTINCT document_key, place, sig FROM (SELECT document_key, 0 AS place, {SIGNAL.format(x='title')} AS sig FROM source_document UNION ALL SELECT document_key, 1, {SIGNAL.format(x='source_pdf')} FROM source_document UNION ALL SELECT document_key, 2, {SIGNAL.format(x='category')} FROM source_document)),
h AS (SELECT document_key, domain, place, priority FROM s JOIN r ON contains(' ' || sig || ' ', ' ' || keyword || ' ') QUALIFY row_number() OVER (PARTITION BY document_key ORDER BY place, priority, domain) = 1),
cl AS (SELECT document_key, coalesce(domain, 'general') AS domain, CAST(coalesce(round(CAST(1.0 - place * 0.2 - (priority - 1) * 0.1 AS DOUBLE), 2), 0.2) AS DOUBLE) AS confidence FROM (SELECT DISTINCT document_key FROM source_document) LEFT JOIN h USING (document_key))"""
LIFE = ", ".join("len(regexp_extract_all(t, '\\b(?:" + "|".join(w) + f")\\b')) AS {d}" for d, w in extract.LIFECYCLE.items())
CMDS = "SELECT packet_id, page, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS command FROM d WHERE fenced AND regexp_extract(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^(\\w+)', 1) IN ('set','show','delete','edit','commit','request','clear')"
SQL = {
    "q_line_pages": "WITH " + LINES + " SELECT packet_id, coalesce(page, 0) AS page, count(*) AS lines, CAST(sum(CASE WHEN fenced THEN 1 ELSE 0 END) AS BIGINT) AS fenced_lines FROM d GROUP BY 1, 2",
    "q_heading_sections": "WITH " + LINES + """, g AS (SELECT packet_id, section, min(CASE WHEN is_heading THEN regexp_replace(line, '^#{1,6} +', '') END) AS title, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM d GROUP BY 1, 2),
      k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')), '[^\\p{L}\\p{N}\\s_-]', '', 'g'), '\\s', '-', 'g') AS slug FROM g),
      n AS (SELECT *, row_number() OVER (PARTITION BY packet_id, slug ORDER BY section) - 1 AS r FROM k)
      SELECT packet_id, CAST(section AS BIGINT) AS section, title, CASE WHEN r > 0 THEN slug || '-' || r ELSE slug END AS anchor, lines, chars FROM n""",
    "q_longest_run": "WITH " + RUNS + " SELECT card_id, input_id, CAST(run AS INT) AS run FROM runs",
    "q_overlap_band": "WITH " + RUNS + ", b AS (SELECT card_id, max(run) AS run FROM runs GROUP BY 1) SELECT card_id, CAST(coalesce(run, 0) AS INT) AS run, CASE WHEN run > 12 THEN 'failed' WHEN run >= 8 THEN 'warned' ELSE 'cleared' END AS band FROM (SELECT DISTINCT card_id FROM knowledge_card) LEFT JOIN b USING (card_id)",
    "q_overlap_counts": "WITH " + RUNS + ", b AS (SELECT card_id, max(run) AS run FROM runs GROUP BY 1) SELECT CASE WHEN run > 12 THEN 'failed' WHEN run >= 8 THEN 'warned' ELSE 'cleared' END AS band, count(*) AS cards FROM (SELECT DISTINCT card_id FROM knowledge_card) LEFT JOIN b USING (card_id) GROUP BY 1",
    "q_prose_patterns": "SELECT doc_id, " + ", ".join("CAST(len(regexp_extract_all(lower(coalesce(text, '')), '" + p.replace("'", "''") + f"')) AS BIGINT) AS {r}" for r, p in prose.PATTERNS.items()) + " FROM documents",
    "q_numeric_facts": f"SELECT packet_id, TRY_CAST(string_split(m, ' ')[1] AS BIGINT) AS value, string_split(m, ' ')[2] AS unit FROM (SELECT packet_id, unnest(regexp_extract_all(source_segment, '(\\d+ (?:{UNITS}))\\b', 1)) AS m FROM rewrite_packet)",
    "q_unit_totals": f"SELECT string_split(m, ' ')[2] AS unit, count(*) AS facts, min(TRY_CAST(string_split(m, ' ')[1] AS BIGINT)) AS least, max(TRY_CAST(string_split(m, ' ')[1] AS BIGINT)) AS most FROM (SELECT unnest(regexp_extract_all(text, '(\\d+ (?:{UNITS}))\\b', 1)) AS m FROM documents) GROUP BY 1",
    "q_commands": "WITH " + LINES + " " + CMDS,
    "q_command_coverage": "WITH " + LINES + ", h AS (SELECT DISTINCT packet_id, command FROM (" + CMDS + ")), l2 AS (SELECT DISTINCT packet_id, trim(c) AS command FROM (SELECT packet_id, unnest(detected_commands) AS c FROM rewrite_packet) WHERE c IS NOT NULL) SELECT coalesce(h.packet_id, l2.packet_id) AS packet_id, count(h.command) AS in_text, count(l2.command) AS listed, CAST(sum(CASE WHEN h.command IS NOT NULL AND l2.command IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched FROM h FULL JOIN l2 ON h.packet_id = l2.packet_id AND h.command = l2.command GROUP BY 1",
    "q_constraints": r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '```[^`]*```', ' ', 'g'), '\s+', ' ', 'g'), '([A-Z][^.!?]*[.!?])', 1)) AS fact FROM documents)
      SELECT * FROM (SELECT doc_id, CASE WHEN regexp_matches(lower(fact), '\b(?:must|cannot|only|required)\b') THEN 'MUST' WHEN regexp_matches(lower(fact), '\b(?:should|recommended)\b') THEN 'SHOULD' ELSE 'INFO' END AS mark, fact FROM s) WHERE mark <> 'INFO'""",
    "q_domain_classify": "WITH " + CLASSIFY + " SELECT * FROM cl",
    "q_domain_distribution": "WITH " + CLASSIFY + " SELECT domain, count(*) AS documents, round(avg(confidence), 4) AS confidence FROM cl GROUP BY 1",
    "q_lifecycle": f"SELECT *, CASE WHEN greatest(day0, day1, day2, day2plus) >= 3 THEN CASE greatest(day0, day1, day2, day2plus) WHEN day0 THEN 'day0' WHEN day1 THEN 'day1' WHEN day2 THEN 'day2' ELSE 'day2plus' END ELSE 'day0' END AS tag FROM (SELECT packet_id, {LIFE} FROM (SELECT packet_id, lower(coalesce(source_segment, '')) AS t FROM rewrite_packet))",
    "q_package_findings": """WITH c AS (SELECT *, upper(regexp_replace(coalesce(mark, ''), '[^A-Za-z]', '', 'g')) AS m, regexp_replace(regexp_replace(lower(fact), '[^\\p{L}\\p{N}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS k FROM knowledge_card)
      SELECT 'size' AS "check", CAST(packet_id AS VARCHAR) AS subject FROM rewrite_packet WHERE strlen(source_segment) > 12288
      UNION ALL SELECT 'citation', CAST(card_id AS VARCHAR) FROM c WHERE coalesce(trim(citation_key), '') = '' UNION ALL SELECT 'mark', CAST(card_id AS VARCHAR) FROM c WHERE m NOT IN ('MUST', 'SHOULD', 'INFO')
      UNION ALL SELECT 'duplicate', CAST(card_id AS VARCHAR) FROM (SELECT card_id, min(card_id) OVER (PARTITION BY k) AS low FROM c WHERE fact IS NOT NULL) WHERE card_id > low
      UNION ALL SELECT 'orphan', CAST(card_id AS VARCHAR) FROM c WHERE generated_path IS NOT NULL AND generated_path NOT IN (SELECT generated_path FROM similarity_input WHERE generated_path IS NOT NULL)
      UNION ALL SELECT 'zero', generated_path FROM (SELECT DISTINCT generated_path FROM similarity_input WHERE generated_path IS NOT NULL) WHERE generated_path NOT IN (SELECT generated_path FROM c WHERE generated_path IS NOT NULL)""",
    "q_fence_leaks": "WITH " + LINES + " SELECT packet_id, line_no, line FROM d WHERE fenced AND regexp_matches(line, '^[A-Z][a-z]+(?: \\S+){4,}[.]$')",
    "q_unfenced_commands": "WITH " + LINES + ", h AS (SELECT *, regexp_extract(line, '^(\\w+)', 1) IN ('set','show','delete','edit','commit','request','clear') AND NOT regexp_matches(line, '[.,;:]|\\b(?:the|a|an|of|to|if)\\b') AS hit FROM d WHERE NOT fenced), r AS (SELECT *, line_no - row_number() OVER (PARTITION BY packet_id, hit ORDER BY line_no) AS run FROM h) SELECT packet_id, line_no, line, count(*) OVER (PARTITION BY packet_id, run) > 1 AS fence FROM r WHERE hit",
    "q_cited_without_section": "WITH " + LINES + """, g AS (SELECT packet_id, section, min(CASE WHEN is_heading THEN regexp_replace(line, '^#{1,6} +', '') END) AS title FROM d GROUP BY 1, 2),
      k AS (SELECT packet_id, section, regexp_replace(regexp_replace(lower(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')), '[^\\p{L}\\p{N}\\s_-]', '', 'g'), '\\s', '-', 'g') AS slug FROM g),
      n AS (SELECT slug, row_number() OVER (PARTITION BY packet_id, slug ORDER BY section) - 1 AS r FROM k), spots AS (SELECT CASE WHEN r > 0 THEN slug || '-' || r ELSE slug END AS anchor FROM n)
      SELECT DISTINCT regexp_extract(citation_key, '\\[([^\\]\\s]+)', 1) AS anchor FROM knowledge_card WHERE regexp_extract(coalesce(citation_key, ''), '\\[([^\\]\\s]+)', 1) NOT IN (SELECT anchor FROM spots) AND regexp_extract(coalesce(citation_key, ''), '\\[([^\\]\\s]+)', 1) <> ''""",
    "q_reference_bfs": """WITH RECURSIVE e AS (SELECT DISTINCT part_key AS src, duplicate_of AS dst FROM source_part WHERE duplicate_of IS NOT NULL), w AS (
      SELECT DISTINCT src AS start, src AS node, 0 AS depth FROM e UNION SELECT w.start, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 4)
      SELECT start, node, min(depth) AS depth FROM w GROUP BY 1, 2""",
}
