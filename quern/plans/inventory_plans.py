"""Inventory, register, reference and queue queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import codeqa, gates, inventory, textrules
from quern.runtime import table

NOW = "2026-06-01 00:00:00"


def _t(s, f, name):
    return table(s, f, name)


def _scans(s, f, first: bool):
    batch = F.col("batch_no") == 0
    return _t(s, f, "source_part").where(batch if first else ~batch).select(F.coalesce("document_key", F.lit("-")).alias("document_key"), "relative_path", F.lower(F.trim("content_hash")).alias("content_hash"))


def _measured(s, f):
    return _t(s, f, "source_part").where("document_key is not null").groupBy("document_key").agg(F.countDistinct("part_key").alias("part_count"), F.max("pages").alias("pages"))


def _register(s, f):
    return _t(s, f, "source_document").groupBy("document_key").agg(F.max("part_count").cast("long").alias("part_count"), F.max("pages").alias("pages"))


def _citations(s, f):
    """Every path of the file log without its first folder, as a short citation of it."""
    return _t(s, f, "file_sample").select(F.regexp_replace("relative_path", "^[^/]+/", "").alias("citation"))


def _kind(title="title"):
    """The last two words of a title without its version: titles of one kind of manual form the family."""
    return F.regexp_extract(T.family_key(F.col(title)), "([a-z]+-[a-z]+)$", 1)


SLUG = "regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
ROOT = "regexp_replace(lower(trim({x})), '[_\\s]+', '-', 'g')"
STEM = "regexp_replace(regexp_replace({x}, '^.*/', ''), '\\.[A-Za-z0-9]{{1,5}}$', '')"
SPLIT = "-(?:\\d{1,3}|part-?\\d{1,3}|[0-9a-f]{8})$"
FAMILY = SLUG.format(x="regexp_replace(lower({t}), '[,]?\\s*\\b(?:release|version|rev|v)?\\s*\\d+(?:\\.[0-9x]+)+(?:r\\d+)?\\b', ' ', 'g')")
KIND = "regexp_extract(" + FAMILY + ", '([a-z]+-[a-z]+)$', 1)"
OWN, BASE = SLUG.format(x=STEM.format(x="relative_path")), SLUG.format(x="regexp_replace(" + STEM.format(x="relative_path") + f", '{SPLIT}', '')")

QUERIES = {
    "q_part_groups": lambda s, f: inventory.part_groups(_t(s, f, "source_part")),
    "q_duplicate_winner": lambda s, f: inventory.duplicate_winners(_t(s, f, "source_part"), _t(s, f, "source_root")),
    "q_edition_families": lambda s, f: inventory.edition_families(_t(s, f, "source_document"), _kind()),
    "q_version_families": lambda s, f: inventory.version_families(_t(s, f, "source_document"), _kind()),
    "q_version_invariant": lambda s, f: inventory.version_families(_t(s, f, "source_document"), _kind()).groupBy("family").agg(F.sum(F.col("is_current").cast("int")).alias("current"), F.count("*").alias("members")).withColumn("holds", F.col("current") == 1),
    "q_page_savings": lambda s, f: inventory.page_savings(inventory.version_families(_t(s, f, "source_document"), _kind()), _t(s, f, "source_document")),
    "q_priority_topk": lambda s, f: inventory.priority(_t(s, f, "source_document"), _t(s, f, "source_root")).orderBy(F.desc("score"), "document_key").limit(50),
    "q_changed_parts": lambda s, f: inventory.changed_parts(_t(s, f, "source_part")),
    "q_left_concat_parts": lambda s, f: inventory.parts_of_documents(_t(s, f, "source_document"), _t(s, f, "source_part")),
    "q_category_totals": lambda s, f: _t(s, f, "source_document").groupBy(F.coalesce(inventory.root_key(F.col("category")), F.lit("-")).alias("category")).agg(
        F.count("*").alias("documents"), F.sum(F.when(F.col("pages") > 0, F.col("pages"))).alias("pages"), F.sum(F.when(F.col("pages") >= 20, 1).otherwise(0)).alias("large")),
    "q_finding_diff": lambda s, f: gates.set_diff(_scans(s, f, True), _scans(s, f, False), ["document_key", "relative_path", "content_hash"]),
    "q_ratchet_gate": lambda s, f: gates.ratchet(gates.set_diff(_scans(s, f, True), _scans(s, f, False), ["document_key", "relative_path", "content_hash"])),
    "q_full_outer_register": lambda s, f: gates.compare(_register(s, f), _measured(s, f), "document_key", ["part_count", "pages"]),
    "q_register_duplicates": lambda s, f: gates.duplicate_keys(_t(s, f, "source_document"), "document_key"),
    "q_orphan_parts": lambda s, f: _t(s, f, "source_part").select("document_key").distinct().where("document_key is not null").join(_t(s, f, "source_document").select("document_key"), "document_key", "left_anti"),
    "q_documents_without_parts": lambda s, f: _t(s, f, "source_document").select("document_key").distinct().join(_t(s, f, "source_part").where("document_key is not null").select("document_key"), "document_key", "left_anti"),
    "q_citation_resolution": lambda s, f: gates.resolve_suffix(_citations(s, f), _t(s, f, "source_part").select(F.col("relative_path").alias("path"))),
    "q_queue_progress": lambda s, f: gates.queue_state(_t(s, f, "work_item")).groupBy("status").agg(F.count("*").alias("documents")),
    "q_claimable": lambda s, f: gates.claimable(gates.queue_state(_t(s, f, "work_item")), NOW).select("document_key", "status", "priority"),
    "q_claim_batch": lambda s, f: gates.assign(gates.queue_state(_t(s, f, "work_item")), NOW, 8, 4),
    "q_latest_event": lambda s, f: _t(s, f, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*"),
    "q_usage_counts": lambda s, f: _t(s, f, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("state")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")),
    "q_compliance_score": lambda s, f: compliance(_t(s, f, "knowledge_card"), _t(s, f, "rewrite_packet"), _t(s, f, "similarity_input")),
    "q_untested_parts": lambda s, f: _t(s, f, "part").join(_t(s, f, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey", "p_brand"),
    "q_tag_coverage": lambda s, f: _t(s, f, "part").join(_t(s, f, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("used", F.lit(1)), "p_partkey", "left").groupBy("p_brand").agg(
        F.count("*").alias("parts"), F.count("used").alias("covered")),
    "q_reference_buckets": lambda s, f: reference_buckets(_t(s, f, "source_document"), _t(s, f, "documents")),
    "q_dominant_caller": lambda s, f: _t(s, f, "file_sample").groupBy("document_key", "root_name").agg(F.count("*").alias("n"), F.min("sample_id").alias("first")).groupBy("document_key").agg(F.max_by(F.struct("root_name", "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("d")).select("document_key", F.col("d.root_name").alias("root_name"), F.col("d.n").alias("n")),
    "q_card_marks": lambda s, f: _t(s, f, "knowledge_card").groupBy(card_mark().alias("mark")).agg(F.count("*").alias("cards"), F.countDistinct("generated_path").alias("paths")),
    "q_fact_dedup": lambda s, f: fact_dedup(_t(s, f, "knowledge_card")),
    "q_card_dedup": lambda s, f: card_dedup(_t(s, f, "knowledge_card")),
    "q_citation_keys": lambda s, f: _t(s, f, "knowledge_card").where("citation_key is not null").select(F.regexp_extract("citation_key", r"\[([^\]\s]+)", 1).alias("slug"), F.nullif(F.regexp_extract("citation_key", r"p(\d+)", 1), F.lit("")).try_cast("int").alias("page")).groupBy("slug").agg(F.count("*").alias("uses"), F.countDistinct("page").alias("pages")),
    "q_page_bounds": lambda s, f: _t(s, f, "rewrite_packet").select("packet_id", T.page_bounds(F.col("page_range")).alias("b")).select("packet_id", F.col("b.first").alias("first_page"), F.col("b.last").alias("last_page")),
    "q_scalar_functions": lambda s, f: _t(s, f, "source_document").select(
        "document_key", T.slug(F.col("title")).alias("slug"), T.heading_slug(F.col("title")).alias("anchor"), T.signal(F.col("title")).alias("signal"), T.document_key(F.col("source_pdf")).alias("source_key"),
        F.concat_ws(".", F.transform(T.version_numbers(F.col("title")), lambda x: x.cast("string"))).alias("version"), T.family_key(F.col("title")).alias("family"), F.datediff(F.lit("2026-12-31").cast("date"), F.col("updated_at").cast("date")).alias("age_days"),
        F.date_add(F.col("updated_at").cast("date"), 180).alias("review_on")),
}


def card_mark():
    """MUST, SHOULD, or INFO for anything else."""
    m = F.upper(F.regexp_replace(F.coalesce("mark", F.lit("")), "[^A-Za-z]", ""))
    return F.when(m.startswith("MUST"), "MUST").when(m.startswith("SHOULD"), "SHOULD").otherwise("INFO")


def fact_dedup(cards):
    """One card per mark and normalised fact: the longest fact, then the lowest card_id."""
    key = T.signal(F.col("fact"))
    return cards.where("fact is not null").groupBy(card_mark().alias("mark"), key.alias("k")).agg(
        F.max_by("card_id", F.struct(F.length("fact").alias("n"), (-F.col("card_id")).alias("f"))).alias("card_id"), F.count("*").alias("copies")
    ).select("card_id", "mark", "copies")


def card_dedup(cards):
    """One card per normalised fact: the most specific citation (its length, 10 more with a page), then the first."""
    c = F.coalesce("citation_key", F.lit(""))
    score = F.length(c) + F.when(c.rlike(r"p\d+"), 10).otherwise(0)
    return cards.where("fact is not null").groupBy(T.signal(F.col("fact")).alias("k")).agg(F.max_by("card_id", F.struct(score.alias("s"), (-F.col("card_id")).alias("f"))).alias("card_id"), F.min("card_id").alias("first_seen")).select("card_id", "first_seen")


def compliance(cards, packets, inputs):
    """Score and grade of each check of the package rules: its violations cost by severity, capped by kind of mark."""
    found = textrules.package_findings(packets, cards, inputs)
    severity = F.when(F.col("check").isin("orphan", "zero"), "high").when(F.col("check") == "duplicate", "low").otherwise("medium")
    paths = cards.select(F.col("card_id").cast("string").alias("subject"), F.coalesce("generated_path", F.lit("-")).alias("path")).distinct()
    rows = found.where(F.col("check").isin("citation", "mark", "duplicate", "orphan")).join(paths, "subject").withColumn("severity", severity)
    return codeqa.capped(rows, "path", F.col("check"), codeqa._cost())


def reference_buckets(documents, texts):
    """How many source documents are referenced by 0, 1, 2-3 and 4 or more texts, and their pages."""
    refs = texts.where("document_key is not null").groupBy("document_key").agg(F.count("*").alias("refs"))
    d = documents.groupBy("document_key").agg(F.max("pages").alias("pages")).join(refs, "document_key", "left").fillna({"refs": 0})
    bucket = F.when(F.col("refs") == 0, "0").when(F.col("refs") == 1, "1").when(F.col("refs") <= 3, "2-3").otherwise("4+")
    return d.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("documents"), F.sum(F.when(F.col("pages") > 0, F.col("pages")).otherwise(0)).alias("pages"))


MARK = "CASE WHEN m LIKE 'MUST%' THEN 'MUST' WHEN m LIKE 'SHOULD%' THEN 'SHOULD' ELSE 'INFO' END"
CARDS = "(SELECT *, upper(regexp_replace(coalesce(mark, ''), '[^A-Za-z]', '', 'g')) AS m, regexp_replace(regexp_replace(lower(fact), '[^\\p{L}\\p{N}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS k FROM knowledge_card)"
SCANS = "SELECT DISTINCT coalesce(document_key, '-') AS document_key, relative_path, lower(trim(content_hash)) AS content_hash FROM source_part WHERE batch_no {op} 0"
DIFF = "WITH a AS (" + SCANS.format(op="=") + "), b AS (" + SCANS.format(op="<>") + """),
d AS (SELECT coalesce(b.document_key, a.document_key) AS document_key, coalesce(b.relative_path, a.relative_path) AS relative_path,
  CASE WHEN b.relative_path IS NOT NULL THEN b.content_hash ELSE a.content_hash END AS content_hash,
  CASE WHEN a.relative_path IS NULL THEN 'new' WHEN b.relative_path IS NULL THEN 'removed' ELSE 'unchanged' END AS change
  FROM a FULL JOIN b ON a.document_key = b.document_key AND a.relative_path = b.relative_path AND a.content_hash IS NOT DISTINCT FROM b.content_hash)"""
VERSIONS = """
d AS (SELECT document_key, min(title) AS title, max(pages) AS pages, max(text_chars) AS chars FROM source_document GROUP BY 1),
v AS (SELECT document_key, """ + KIND.format(t="title") + """ AS family, (SELECT max(x) FROM (SELECT unnest(list_transform(regexp_extract_all(title, '\\b(\\d+(?:\\.\\d+)+)', 1), lambda v: list_transform(string_split(v, '.'), lambda y: TRY_CAST(y AS INT)))) AS x)) AS ver,
  coalesce(pages, 0) AS pages, coalesce(chars, 0) AS chars FROM d),
w AS (SELECT *, count(*) OVER (PARTITION BY family) AS family_size, row_number() OVER (PARTITION BY family ORDER BY ver DESC, pages DESC, chars DESC, document_key) AS k FROM v WHERE ver IS NOT NULL AND family <> '')
"""
STATE = """SELECT document_key, lower(trim(status)) AS status, priority, attempt_count, lease_expires_at, updated_at FROM work_item
  QUALIFY row_number() OVER (PARTITION BY document_key ORDER BY coalesce(updated_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, run_id DESC, lower(trim(status)) DESC, priority DESC, attempt_count DESC) = 1"""
CLAIM = "SELECT * FROM (" + STATE + f") WHERE status IN ('pending', 'failed') OR (status = 'leased' AND lease_expires_at <= TIMESTAMPTZ '{NOW}+00')"
DUPKEY = "coalesce(nullif(" + SLUG.format(x="regexp_replace(lower(source_pdf), '\\.pdf$', '')") + ", ''), nullif(" + SLUG.format(x="title") + ", ''))"

SQL = {
    "q_page_savings": "WITH " + VERSIONS + " SELECT family, count(*) AS members, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS superseded, CAST(sum(greatest(pages, 0)) AS BIGINT) AS pages, CAST(sum(CASE WHEN k > 1 THEN greatest(pages, 0) ELSE 0 END) AS BIGINT) AS saved_pages FROM w WHERE family_size > 1 GROUP BY family",
    "q_part_groups": f"""WITH p AS (SELECT part_id, {ROOT.format(x='root_name')} AS root, {BASE} AS base, {OWN} AS own, regexp_matches({STEM.format(x='relative_path')}, '{SPLIT}') AS split, nullif(trim(title), '') AS title, pages, text_chars FROM source_part),
      g AS (SELECT root, base, count(DISTINCT own) AS stems, bool_or(split) AS any_split FROM p GROUP BY 1, 2)
      SELECT root, CASE WHEN stems > 1 AND any_split THEN base ELSE own END AS group_key, CASE WHEN stems > 1 AND any_split THEN 'split_set' ELSE 'filename' END AS method, count(*) AS parts, max(pages) AS pages,
        arg_min(title, part_id) FILTER (WHERE title IS NOT NULL) AS title, CAST(sum(text_chars) AS BIGINT) AS text_chars FROM p JOIN g USING (root, base) GROUP BY 1, 2, 3""",
    "q_duplicate_winner": f"""WITH p AS (SELECT part_id, {ROOT.format(x='root_name')} AS root, {DUPKEY} AS k, coalesce(has_front_matter, 0) AS front, coalesce(text_chars, 0) AS chars FROM source_part),
      w AS (SELECT p.*, first_value(part_id) OVER (PARTITION BY k ORDER BY coalesce(r.root_rank, -1) DESC, front DESC, chars DESC, part_id) AS winner FROM p LEFT JOIN source_root r ON r.root_name = p.root WHERE k IS NOT NULL)
      SELECT part_id, k AS duplicate_key, part_id = winner AS is_winner, CASE WHEN part_id <> winner THEN winner END AS duplicate_of FROM w""",
    "q_edition_families": f"""WITH d AS (SELECT DISTINCT document_key, {KIND.format(t='title')} AS family, title, pages FROM source_document)
      SELECT family, count(*) AS members, count(DISTINCT title) AS titles, coalesce(array_to_string(list_sort(list(DISTINCT pages) FILTER (WHERE pages IS NOT NULL)), ','), '') AS page_counts FROM d WHERE family <> '' GROUP BY family HAVING count(*) > 1""",
    "q_version_families": "WITH " + VERSIONS + " SELECT document_key, family, array_to_string(ver, '.') AS version, k = 1 AS is_current, family_size FROM w WHERE family_size > 1",
    "q_version_invariant": "WITH " + VERSIONS + " SELECT family, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS current, count(*) AS members, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) = 1 AS holds FROM w WHERE family_size > 1 GROUP BY family",
    "q_priority_topk": f"""WITH d AS (SELECT document_key, {ROOT.format(x='category')} AS c, coalesce(pages, 0) AS p, lower(trim(status)) AS st, coalesce(r.root_rank, 0) AS rk FROM source_document d LEFT JOIN source_root r ON r.root_name = {ROOT.format(x='d.root_name')})
      SELECT document_key, max(coalesce(CASE c WHEN 'guides' THEN 400 WHEN 'cli-reference' THEN 350 WHEN 'hardware' THEN 300 WHEN 'release-notes' THEN 200 WHEN 'courses' THEN 150 WHEN 'design-notes' THEN 100 WHEN 'flyers' THEN 20 END, 0)
        + least(greatest(p, 0), 2500) // 5 + CASE WHEN st = 'ok' THEN 50 ELSE 0 END + rk * 25) AS score FROM d GROUP BY 1 ORDER BY score DESC, document_key LIMIT 50""",
    "q_changed_parts": """WITH p AS (SELECT part_key, document_key, part_id, scanned_at, nullif(lower(trim(content_hash)), '') AS h FROM source_part),
      o AS (SELECT part_key, first_value(h) OVER (PARTITION BY part_key ORDER BY scanned_at, part_id) AS old_hash, first_value(h) OVER (PARTITION BY part_key ORDER BY scanned_at DESC, part_id DESC) AS new_hash FROM p WHERE h IS NOT NULL),
      k AS (SELECT part_key, document_key FROM p QUALIFY row_number() OVER (PARTITION BY part_key ORDER BY scanned_at DESC, part_id DESC) = 1)
      SELECT DISTINCT part_key, document_key, old_hash, new_hash FROM o JOIN k USING (part_key) WHERE old_hash <> new_hash""",
    "q_left_concat_parts": "WITH p AS (SELECT document_key, array_to_string(list_sort(list(DISTINCT relative_path)), ',') AS files FROM source_part WHERE document_key IS NOT NULL GROUP BY 1) SELECT document_key, coalesce(files, '') AS files FROM (SELECT DISTINCT document_key FROM source_document) d LEFT JOIN p USING (document_key)",
    "q_category_totals": f"SELECT coalesce({ROOT.format(x='category')}, '-') AS category, count(*) AS documents, CAST(sum(CASE WHEN pages > 0 THEN pages END) AS BIGINT) AS pages, CAST(sum(CASE WHEN pages >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM source_document GROUP BY 1",
    "q_finding_diff": DIFF + " SELECT * FROM d",
    "q_ratchet_gate": DIFF + ", c AS (SELECT CAST(count(*) FILTER (WHERE change = 'new') AS BIGINT) AS n, count(*) FILTER (WHERE change = 'removed') AS r, count(*) FILTER (WHERE change = 'unchanged') AS u FROM d) SELECT n AS new, r AS removed, u AS unchanged, CASE WHEN n + u = 0 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END AS exit_code FROM c",
    "q_full_outer_register": """WITH a AS (SELECT document_key, max(part_count) AS pc, max(pages) AS pg FROM source_document GROUP BY 1), b AS (SELECT document_key, count(DISTINCT part_key) AS pc, max(pages) AS pg FROM source_part WHERE document_key IS NOT NULL GROUP BY 1),
      j AS (SELECT coalesce(a.document_key, b.document_key) AS document_key, CASE WHEN a.document_key IS NULL THEN 'only_right' WHEN b.document_key IS NULL THEN 'only_left' ELSE concat_ws(',', CASE WHEN a.pc IS DISTINCT FROM b.pc THEN 'part_count' END, CASE WHEN a.pg IS DISTINCT FROM b.pg THEN 'pages' END) END AS drift
      FROM a FULL JOIN b ON a.document_key = b.document_key) SELECT * FROM j WHERE drift <> ''""",
    "q_register_duplicates": "SELECT document_key, count(*) AS n FROM source_document GROUP BY 1 HAVING count(*) > 1",
    "q_orphan_parts": "SELECT DISTINCT document_key FROM source_part WHERE document_key IS NOT NULL AND document_key NOT IN (SELECT document_key FROM source_document)",
    "q_documents_without_parts": "SELECT DISTINCT document_key FROM source_document WHERE document_key NOT IN (SELECT document_key FROM source_part WHERE document_key IS NOT NULL)",
    "q_citation_resolution": """WITH c AS (SELECT DISTINCT regexp_replace(relative_path, '^[^/]+/', '') AS citation FROM file_sample), h AS (SELECT DISTINCT relative_path AS p FROM source_part),
      j AS (SELECT citation, sum(CASE WHEN p = citation OR ends_with(p, '/' || citation) THEN 1 ELSE 0 END) AS matches, bool_or(p = citation) AS exact FROM c LEFT JOIN h ON string_split(c.citation, '/')[-1] = string_split(h.p, '/')[-1] GROUP BY 1)
      SELECT citation, CAST(matches AS BIGINT) AS matches, CASE WHEN exact THEN 'exact' WHEN matches = 1 THEN 'suffix' WHEN matches > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM j""",
    "q_queue_progress": "SELECT status, count(*) AS documents FROM (" + STATE + ") GROUP BY 1",
    "q_claimable": "SELECT document_key, status, priority FROM (" + CLAIM + ")",
    "q_claim_batch": "SELECT document_key, priority, updated_at FROM (" + CLAIM + ") ORDER BY priority DESC, updated_at ASC NULLS FIRST, document_key LIMIT 32",
    "q_latest_event": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "q_usage_counts": "SELECT event_type, json_extract_string(props, '$.k') AS state, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    "q_compliance_score": """WITH c AS (SELECT *, coalesce(generated_path, '-') AS path, upper(regexp_replace(coalesce(mark, ''), '[^A-Za-z]', '', 'g')) AS m, regexp_replace(regexp_replace(lower(fact), '[^\\p{L}\\p{N}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS k FROM knowledge_card),
      p AS (SELECT card_id, path FROM (SELECT DISTINCT card_id, path FROM c)),
      v AS (SELECT card_id, 'citation' AS g, 3 AS cost FROM c WHERE coalesce(trim(citation_key), '') = '' UNION ALL SELECT card_id, 'mark', 3 FROM c WHERE m NOT IN ('MUST', 'SHOULD', 'INFO')
        UNION ALL SELECT card_id, 'duplicate', 1 FROM (SELECT card_id, min(card_id) OVER (PARTITION BY k) AS low FROM c WHERE fact IS NOT NULL) WHERE card_id > low
        UNION ALL SELECT card_id, 'orphan', 6 FROM c WHERE generated_path IS NOT NULL AND generated_path NOT IN (SELECT generated_path FROM similarity_input WHERE generated_path IS NOT NULL)),
      t AS (SELECT path, g, least(sum(cost), 20) AS p FROM v JOIN p USING (card_id) GROUP BY 1, 2), u AS (SELECT path, CAST(greatest(0, 100 - sum(p)) AS INT) AS score FROM t GROUP BY 1)
      SELECT path, score, CASE WHEN score >= 97 THEN 'A+' WHEN score >= 93 THEN 'A' WHEN score >= 90 THEN 'A-' WHEN score >= 87 THEN 'B+' WHEN score >= 83 THEN 'B' WHEN score >= 80 THEN 'B-' WHEN score >= 77 THEN 'C+' WHEN score >= 73 THEN 'C' WHEN score >= 70 THEN 'C-' WHEN score >= 67 THEN 'D+' WHEN score >= 63 THEN 'D' WHEN score >= 60 THEN 'D-' ELSE 'F' END AS grade FROM u""",
    "q_untested_parts": "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
    "q_tag_coverage": "SELECT p_brand, count(*) AS parts, count(u) AS covered FROM part LEFT JOIN (SELECT DISTINCT l_partkey, 1 AS u FROM lineitem WHERE l_returnflag = 'R') ON p_partkey = l_partkey GROUP BY 1",
    "q_reference_buckets": """WITH r AS (SELECT document_key, count(*) AS n FROM documents WHERE document_key IS NOT NULL GROUP BY 1), d AS (SELECT document_key, max(pages) AS pages FROM source_document GROUP BY 1)
      SELECT CASE WHEN coalesce(n, 0) = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' ELSE '4+' END AS bucket, count(*) AS documents, CAST(sum(CASE WHEN pages > 0 THEN pages ELSE 0 END) AS BIGINT) AS pages FROM d LEFT JOIN r USING (document_key) GROUP BY 1""",
    "q_dominant_caller": "SELECT document_key, root_name, n FROM (SELECT document_key, root_name, count(*) AS n, min(sample_id) AS fs FROM file_sample GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY document_key ORDER BY n DESC, fs) = 1",
    "q_card_marks": f"SELECT {MARK} AS mark, count(*) AS cards, count(DISTINCT generated_path) AS paths FROM {CARDS} GROUP BY 1",
    "q_fact_dedup": f"SELECT card_id, mark, copies FROM (SELECT card_id, {MARK} AS mark, count(*) OVER (PARTITION BY {MARK}, k) AS copies, row_number() OVER (PARTITION BY {MARK}, k ORDER BY length(fact) DESC, card_id) AS r FROM {CARDS} WHERE fact IS NOT NULL) WHERE r = 1",
    "q_card_dedup": f"SELECT card_id, first_seen FROM (SELECT card_id, min(card_id) OVER (PARTITION BY k) AS first_seen, row_number() OVER (PARTITION BY k ORDER BY length(coalesce(citation_key, '')) + CASE WHEN regexp_matches(citation_key, 'p\\d+') THEN 10 ELSE 0 END DESC, card_id) AS r FROM {CARDS} WHERE fact IS NOT NULL) WHERE r = 1",
    "q_citation_keys": "SELECT regexp_extract(citation_key, '\\[([^\\]\\s]+)', 1) AS slug, count(*) AS uses, count(DISTINCT TRY_CAST(nullif(regexp_extract(citation_key, 'p(\\d+)', 1), '') AS INT)) AS pages FROM knowledge_card WHERE citation_key IS NOT NULL GROUP BY 1",
    "q_page_bounds": "SELECT packet_id, list_min(n) AS first_page, list_max(n) AS last_page FROM (SELECT packet_id, list_transform(list_slice(regexp_extract_all(coalesce(page_range, ''), '(\\d{1,6})', 1), 1, 2), lambda x: CAST(x AS INT)) AS n FROM rewrite_packet)",
    "q_scalar_functions": f"""SELECT document_key, {SLUG.format(x='title')} AS slug, regexp_replace(regexp_replace(lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g')), '[^\\p{{L}}\\p{{N}}\\s_-]', '', 'g'), '\\s', '-', 'g') AS anchor,
      regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS signal, concat_ws('-', substr(sha1(source_pdf), 1, 12), nullif(right({SLUG.format(x='source_pdf')}, 200), '')) AS source_key,
      coalesce(array_to_string((SELECT max(x) FROM (SELECT unnest(list_transform(regexp_extract_all(title, '\\b(\\d+(?:\\.\\d+)+)', 1), lambda v: list_transform(string_split(v, '.'), lambda y: TRY_CAST(y AS INT)))) AS x)), '.'), '') AS version,
      {FAMILY.format(t='title')} AS family, date_diff('day', CAST(updated_at AS DATE), DATE '2026-12-31') AS age_days, CAST(CAST(updated_at AS DATE) + INTERVAL 180 DAY AS DATE) AS review_on FROM source_document""",
}
