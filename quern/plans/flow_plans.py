"""Streaming, incremental, repair and code queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import codeqa, gates, incremental, quality, repair
from quern.runtime import fresh_folder, table
from quern.sources import readers
from quern.sources.versioned import VersionedTable, process_new
from quern.streaming import watcher

# Modules for the code rules: the driver tables hold no source code.
MODULES = [
    ("pkg/a.py", "import os\nfrom pkg import b\n\ndef area(w, h):\n    return w * h\n\ndef _hidden():\n    return 1\n\ndef area_wrapper(x):\n    return area(x, x)\n\ndef later():\n    pass\n"),
    ("pkg/b.py", "import logging\n\ndef ask(a, b, c, d, e, f):\n    for i in range(3):\n        if a:\n            if b:\n                while c:\n                    for j in d:\n                        if e and f:\n                            logging.info(f'{i} {j}')\n    return input()\n\nalias = ask\nroot = 'C:\\\\temp'\n"),
    ("pkg/broken.py", "def x(:\n"),
    ("tests/test_a.py", "import pytest\nfrom pkg.a import area\n\ndef test_area():\n    assert area(1, 2) == 2\n\ndef test_true():\n    assert True\n\ndef test_none():\n    assert area(1, 1) is not None  # noqa: weak_is_not_none\n\ndef test_nothing():\n    area(1, 1)\n\ndef test_same():\n    x = area(1, 1)\n    assert x == x\n\ndef test_raises():\n    with pytest.raises(Exception):\n        area()\n"),
]


def _modules(s):
    return s.createDataFrame(MODULES, "path string, source string")


def _all_findings(s):
    m = _modules(s)
    tests = m.where(F.col("path").startswith("tests/"))
    found = codeqa.structure_findings(m).unionByName(codeqa.style_findings(m)).unionByName(codeqa.test_findings(tests))
    return codeqa.suppressed(found, m)


def quiet_states(s, f, batches=3):
    """The sample log streamed in several micro-batches; samples that arrived late stand in later ones."""
    root = fresh_folder(s, "watch")
    # One file per range of arrival; the stream may take them in any order.
    table(s, f, "file_sample").repartitionByRange(batches, "arrived_at").write.parquet(f"{root}/samples")
    return watcher.watch(s, f"{root}/samples", f"{root}/watch", files_per_batch=1).read()


def quiet_gate(s, f):
    states = quiet_states(s, f)
    part = F.split("file", "\n")
    return states.select(part[0].alias("document_key"), part[1].alias("root_name"), part[2].alias("relative_path"), "size_bytes", "modified_ns", "stable", "samples")


def versioned_changes(s, f):
    """Two appends and a delete of the card table, read back as changes by a consumer that keeps its progress."""
    cards = table(s, f, "knowledge_card").select("card_id", "mark", "citation_key")
    source, sink = VersionedTable(s, fresh_folder(s, "source")), VersionedTable(s, fresh_folder(s, "sink"))
    half = F.col("card_id") <= cards.count() // 2
    source.commit(cards.where(half))
    process_new(source, sink, "cards", lambda d: d)
    source.commit(cards.where(~half))
    source.delete("mark is null")
    process_new(source, sink, "cards", lambda d: d)
    return sink.read().groupBy("_change").agg(F.count("*").alias("n"), F.countDistinct("card_id").alias("cards"))


def upserted(s, f):
    t = VersionedTable(s, fresh_folder(s, "upsert"))
    d = table(s, f, "source_document").groupBy("document_key").agg(F.max("pages").alias("pages"))
    readers.upsert(t, d, ["document_key"])
    readers.upsert(t, d.where("pages is null").withColumn("pages", F.lit(0)), ["document_key"])
    return t.read().select("document_key", "pages")


QUERIES = {
    "s_quiet_gate": quiet_gate,
    "s_ready_documents": lambda s, f: watcher.ready_sets(quiet_states(s, f), table(s, f, "file_sample").select(F.concat_ws("\n", "document_key", "root_name", "relative_path").alias("file"), F.col("document_key").alias("group"))),
    "q_file_states": lambda s, f: incremental.file_states(table(s, f, "file_sample"), table(s, f, "work_item")).select("document_key", "root_name", "relative_path", "present_hash", "processed_hash"),
    "q_pending_kinds": lambda s, f: incremental.pending_files(table(s, f, "file_sample"), table(s, f, "work_item")).groupBy("change").agg(F.count("*").alias("files")),
    "q_versioned_changes": versioned_changes,
    "q_upsert": upserted,
    "q_word_segments": lambda s, f: repair.segmented(spaceless(table(s, f, "documents")), quality.word_counts(table(s, f, "documents")), "doc_id", "text").select("doc_id", F.size("words").alias("words"), F.concat_ws(" ", "words").alias("repaired")),
    "q_segment_accuracy": lambda s, f: segment_accuracy(s, f),
    "q_code_findings": lambda s, f: _all_findings(s),
    "q_code_scores": lambda s, f: codeqa.scores(_all_findings(s)),
    "q_code_metrics": lambda s, f: codeqa.function_metrics(_modules(s)),
    "q_code_coverage": lambda s, f: codeqa.comment_coverage(_modules(s)),
    "q_code_hotspots": lambda s, f: codeqa.hotspots(_modules(s)),
    "q_code_untested": lambda s, f: codeqa.untested(_modules(s).where(~F.col("path").startswith("tests/")), _modules(s).where(F.col("path").startswith("tests/"))),
    "q_nearest_roots": lambda s, f: gates.nearest_names(table(s, f, "source_part").select(F.col("root_name").alias("name")), table(s, f, "source_root").select(F.col("root_name").alias("name"))),
    "q_number_allocation": lambda s, f: gates.free_numbers(table(s, f, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 500).alias("number")), table(s, f, "nation").select(F.col("n_name").alias("name")), 500, 1500),
}


def spaceless(documents):
    """Documents of which the text has hardly any blanks."""
    return documents.where((F.length("text") > 200) & (F.length(F.regexp_replace("text", r"\S", "")) * 25 < F.length("text"))).select("doc_id", "text")


def segment_accuracy(s, f):
    """All texts with everything between their words removed, cut again and compared."""
    docs = table(s, f, "documents")
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), 1)
    rows = docs.select(F.array_join(words, " ").alias("wanted")).where("wanted <> ''").withColumn("glued", F.replace("wanted", F.lit(" "), F.lit("")))
    cut_again = repair.segmented(rows, quality.word_counts(docs), "wanted", "glued").withColumn("wanted", F.split("wanted", " "))
    return repair.accuracy(cut_again, "words", "wanted").select("lines", F.round("place_accuracy", 3).alias("place_accuracy"))


TAIL = """k AS (SELECT document_key, root_name, relative_path, size_bytes, modified_ns, row_number() OVER w AS r, count(*) OVER (PARTITION BY document_key, root_name, relative_path) AS samples,
  first_value(size_bytes) OVER w AS s0, first_value(modified_ns) OVER w AS m0 FROM file_sample WINDOW w AS (PARTITION BY document_key, root_name, relative_path ORDER BY sampled_at DESC, sample_id DESC)),
t AS (SELECT document_key, root_name, relative_path, any_value(s0) AS size_bytes, any_value(m0) AS modified_ns, CAST(coalesce(min(r) FILTER (WHERE size_bytes IS DISTINCT FROM s0 OR modified_ns IS DISTINCT FROM m0) - 1, max(r)) AS BIGINT) AS stable, max(samples) AS samples FROM k GROUP BY 1, 2, 3)"""
STATES = """WITH events AS (SELECT document_key, run_id, lower(trim(status)) AS st, updated_at FROM work_item),
done AS (SELECT document_key, run_id FROM events WHERE st = 'done' QUALIFY row_number() OVER (PARTITION BY document_key ORDER BY updated_at DESC NULLS LAST, run_id DESC) = 1),
run AS (SELECT d.document_key, max(l.updated_at) AS leased_at FROM done d LEFT JOIN events l ON l.document_key = d.document_key AND l.run_id = d.run_id AND l.st = 'leased' GROUP BY 1),
s AS (SELECT f.*, r.leased_at FROM file_sample f LEFT JOIN run r ON f.document_key = r.document_key),
st AS (SELECT document_key, root_name, relative_path, arg_max(content_hash, (sampled_at, sample_id)) FILTER (WHERE content_hash IS NOT NULL) AS present_hash,
  arg_max(content_hash, (sampled_at, sample_id)) FILTER (WHERE content_hash IS NOT NULL AND sampled_at <= leased_at) AS processed_hash, bool_or(coalesce(sampled_at <= leased_at, false)) AS was_seen,
  arg_max(coalesce(stable_checks, -1), (sampled_at, sample_id)) AS stable_checks FROM s GROUP BY 1, 2, 3)"""
SQL = {
    "s_quiet_gate": "WITH " + TAIL + " SELECT * FROM t",
    "s_ready_documents": "WITH " + TAIL + " SELECT document_key AS \"group\", count(*) AS files FROM t GROUP BY 1 HAVING min(stable) >= 2",
    "q_file_states": STATES + " SELECT document_key, root_name, relative_path, present_hash, processed_hash FROM st",
    "q_pending_kinds": STATES + " SELECT CASE WHEN was_seen THEN 'changed' ELSE 'added' END AS change, count(*) AS files FROM st WHERE stable_checks >= 2 AND (NOT was_seen OR present_hash IS DISTINCT FROM processed_hash) GROUP BY 1",
    "q_versioned_changes": "SELECT 'insert' AS _change, count(*) FILTER (WHERE card_id <= (SELECT count(*) // 2 FROM knowledge_card) OR mark IS NOT NULL) AS n, count(DISTINCT card_id) FILTER (WHERE card_id <= (SELECT count(*) // 2 FROM knowledge_card) OR mark IS NOT NULL) AS cards FROM knowledge_card UNION ALL SELECT 'delete', count(*), count(DISTINCT card_id) FROM knowledge_card WHERE mark IS NULL AND card_id <= (SELECT count(*) // 2 FROM knowledge_card)",
    "q_upsert": "SELECT document_key, coalesce(max(pages), 0) AS pages FROM source_document GROUP BY 1",
    "q_nearest_roots": "WITH n AS (SELECT DISTINCT root_name AS stale FROM source_part WHERE root_name NOT IN (SELECT root_name FROM source_root)), d AS (SELECT stale, root_name, levenshtein(stale, root_name) AS k FROM n, source_root), b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY stale ORDER BY k, root_name) = 1) SELECT stale, CASE WHEN k <= length(stale) // 2 THEN root_name END AS nearest, CASE WHEN k <= length(stale) // 2 THEN k END AS distance FROM b",
    "q_number_allocation": "WITH taken AS (SELECT n_name AS name, n_nationkey + 500 AS number FROM nation WHERE n_regionkey = 1), fresh AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_name) AS k FROM nation WHERE n_regionkey <> 1), free AS (SELECT x AS number, row_number() OVER (ORDER BY x) AS k FROM range(500, 1501) r(x) WHERE x NOT IN (SELECT number FROM taken)) SELECT name, CAST(number AS INT) AS number FROM taken UNION ALL SELECT name, CAST(number AS INT) FROM fresh JOIN free USING (k)",
}
