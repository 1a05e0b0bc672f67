"""Corpus inventory: grouping of split parts, duplicate winners, editions, versions, priority, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.runtime import salted_join

SPLIT = r"-(?:\d{1,3}|part-?\d{1,3}|[0-9a-f]{8})$"


def stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[A-Za-z0-9]{1,5}$", "")


def base_stem(path: Column) -> Column:
    """Stem without the marks of a split file: part numbers and hash suffixes."""
    return F.regexp_replace(stem(path), SPLIT, "")


def is_split(path: Column) -> Column:
    return stem(path).rlike(SPLIT)


def root_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[_\\s]+", "-")


def part_groups(parts: DataFrame) -> DataFrame:
    """One row per logical document: group_key, method, parts, pages, title, text_chars.

    Files of one root and base stem merge if there are several and any carries a split mark; else each stem
    stands alone. The first title in order of arrival stands; empty strings count as missing.
    """
    p = parts.select(
        "part_id", root_key(F.col("root_name")).alias("root"), T.slug(base_stem(F.col("relative_path"))).alias("base"), T.slug(stem(F.col("relative_path"))).alias("own"),
        is_split(F.col("relative_path")).alias("split"), F.nullif(F.trim("title"), F.lit("")).alias("title"), "pages", "text_chars", "relative_path",
    )
    # First level: by stem; second level: by base. Both combine before the shuffle.
    own = p.groupBy("root", "base", "own").agg(
        F.count("*").alias("files"), F.max("split").alias("split"), F.min(F.when(F.col("title").isNotNull(), F.struct("part_id", "title"))).alias("t"),
        F.max("pages").alias("pages"), F.sum("text_chars").alias("chars"),
    )
    signal = own.groupBy("root", "base").agg(F.count("*").alias("stems"), F.max("split").alias("any_split"))
    merged = (F.col("stems") > 1) & F.col("any_split")
    joined = own.join(signal, ["root", "base"])
    return joined.groupBy("root", F.when(merged, F.col("base")).otherwise(F.col("own")).alias("group_key"), F.when(merged, "split_set").otherwise("filename").alias("method")).agg(
        F.sum("files").alias("parts"), F.max("pages").alias("pages"), F.min("t").alias("t"), F.sum("chars").alias("text_chars")
    ).select("root", "group_key", "method", "parts", "pages", F.col("t.title").alias("title"), "text_chars")


def duplicate_key(source_pdf: Column, title: Column) -> Column:
    """Slug of the source, else of the title; null where both are missing."""
    return F.coalesce(F.nullif(T.slug(F.regexp_replace(F.lower(source_pdf), r"\.pdf$", "")), F.lit("")), F.nullif(T.slug(title), F.lit("")))


def duplicate_winners(parts: DataFrame, roots: DataFrame) -> DataFrame:
    """part_id, duplicate_key, is_winner, duplicate_of: the winner has the best root, then front matter, then text."""
    rank = roots.select(root_key(F.col("root_name")).alias("root"), "root_rank")
    rows = parts.select("part_id", root_key(F.col("root_name")).alias("root"), duplicate_key(F.col("source_pdf"), F.col("title")).alias("duplicate_key"), F.coalesce("has_front_matter", F.lit(0)).alias("front"), F.coalesce("text_chars", F.lit(0)).alias("chars"))
    rows = rows.where("duplicate_key is not null").join(rank, "root", "left")
    best = F.struct(F.coalesce("root_rank", F.lit(-1)).alias("r"), "front", "chars", (-F.col("part_id")).alias("first"))
    winners = rows.groupBy("duplicate_key").agg(F.max_by("part_id", best).alias("winner"))
    joined = salted_join(rows.select("part_id", "duplicate_key"), winners, "duplicate_key", "part_id")
    wins = F.col("part_id") == F.col("winner")
    return joined.select("part_id", "duplicate_key", wins.alias("is_winner"), F.when(~wins, F.col("winner")).alias("duplicate_of"))


def edition_families(documents: DataFrame, family: Column | None = None) -> DataFrame:
    """family, members, titles, page_counts of titles that share a slug without version, where there are several."""
    family = T.family_key(F.col("title")) if family is None else family
    d = documents.select("document_key", family.alias("family"), "title", "pages").dropDuplicates()
    return d.where("family <> ''").groupBy("family").agg(
        F.count("*").alias("members"), F.countDistinct("title").alias("titles"), F.concat_ws(",", F.array_sort(F.collect_set("pages"))).alias("page_counts")
    ).where("members > 1")


def version_families(documents: DataFrame, family: Column | None = None) -> DataFrame:
    """document_key, family, version, is_current, family_size: the newest version of a family is current.

    A family needs two documents with a version; ties go to more pages, more text, then the lower key.
    """
    d = documents.groupBy("document_key").agg(F.min("title").alias("title"), F.max("pages").alias("pages"), F.max("text_chars").alias("chars"))
    family = T.family_key(F.col("title")) if family is None else family
    d = d.select("document_key", family.alias("family"), T.version_numbers(F.col("title")).alias("version"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chars", F.lit(0)).alias("chars")).where("version is not null and family <> ''")
    best = d.groupBy("family").agg(F.count("*").alias("family_size"), F.max(F.struct("version", "pages", "chars")).alias("top"))
    first = d.join(best.where("family_size > 1"), "family").where(F.struct("version", "pages", "chars") == F.col("top")).groupBy("family").agg(F.min("document_key").alias("current"))
    out = d.join(best.where("family_size > 1").select("family", "family_size"), "family").join(first, "family")
    return out.select("document_key", "family", F.concat_ws(".", F.transform("version", lambda x: x.cast("string"))).alias("version"), (F.col("document_key") == F.col("current")).alias("is_current"), "family_size")


def priority(documents: DataFrame, roots: DataFrame, categories: dict[str, int] | None = None) -> DataFrame:
    """document_key, score: category weight, pages up to 2500 by fives, a bonus for status ok and for the root's rank."""
    weights = categories or {"guides": 400, "cli-reference": 350, "hardware": 300, "release-notes": 200, "courses": 150, "design-notes": 100, "flyers": 20}
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    rank = roots.select(root_key(F.col("root_name")).alias("root"), "root_rank")
    d = documents.select("document_key", root_key(F.col("root_name")).alias("root"), root_key(F.col("category")).alias("category"), "pages", F.lower(F.trim("status")).alias("status")).join(rank, "root", "left")
    pages = F.least(F.greatest(F.coalesce("pages", F.lit(0)), F.lit(0)), F.lit(2500))
    score = F.coalesce(F.element_at(table, F.col("category")), F.lit(0)) + F.floor(pages / 5).cast("int") + F.when(F.col("status") == "ok", 50).otherwise(0) + F.coalesce("root_rank", F.lit(0)) * 25
    return d.groupBy("document_key").agg(F.max(score).alias("score"))


def changed_parts(parts: DataFrame) -> DataFrame:
    """part_key, document_key, old_hash, new_hash of files whose newest scan has other content than the first."""
    h = F.lower(F.trim("content_hash"))
    at = F.struct("scanned_at", "part_id")
    known = F.when(h.isNotNull() & (h != ""), at)
    seen = parts.groupBy("part_key").agg(F.min_by(h, known).alias("old_hash"), F.max_by(h, known).alias("new_hash"), F.max_by("document_key", at).alias("document_key"))
    return seen.where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select("part_key", "document_key", "old_hash", "new_hash")


def parts_of_documents(documents: DataFrame, parts: DataFrame) -> DataFrame:
    """document_key and its files as one sorted, comma-separated list; documents without files have an empty one.

    The list of a document is as long as its distinct files are, however often they were scanned.
    """
    files = parts.where("document_key is not null").select("document_key", "relative_path").distinct().groupBy("document_key").agg(F.concat_ws(",", F.array_sort(F.collect_list("relative_path"))).alias("files"))
    return documents.select("document_key").distinct().join(files, "document_key", "left").select("document_key", F.coalesce("files", F.lit("")).alias("files"))


def page_savings(families: DataFrame, documents: DataFrame) -> DataFrame:
    """family, members, superseded, pages, saved_pages of version families, most saved pages first."""
    pages = documents.groupBy("document_key").agg(F.greatest(F.coalesce(F.max("pages"), F.lit(0)), F.lit(0)).alias("pages"))
    old = ~F.col("is_current")
    return families.join(pages, "document_key").groupBy("family").agg(
        F.count("*").alias("members"), F.sum(old.cast("int")).alias("superseded"), F.sum("pages").alias("pages"), F.sum(F.when(old, F.col("pages")).otherwise(0)).alias("saved_pages")
    ).orderBy(F.desc("saved_pages"), "family")
