"""Readers and writers: Markdown trees, front matter, catalogs, JSON, upserts, canonical reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.versioned import VersionedTable


def markdown(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """root_name, path, relative_path, content_hash, size_bytes, text of every .md file below the roots, names with a leading _ left out.

    Roots that do not exist are skipped. Content is read by Spark; only folder names are listed on the driver.
    """
    out = None
    for name, folder in roots.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            continue
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
        relative = F.regexp_replace("path", f"^.*?{_quoted(folder.rstrip('/'))}/", "")
        df = df.select(F.lit(name).alias("root_name"), "path", relative.alias("relative_path"), F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes"), F.decode("content", "UTF-8").alias("text"))
        df = df.where(~F.element_at(F.split("relative_path", "/"), -1).startswith("_"))
        out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.createDataFrame([], "root_name string, path string, relative_path string, content_hash string, size_bytes long, text string")
    return out


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def front_matter(text: Column) -> Column:
    """Map of the scalar lines between a leading --- and the next; the last of repeated keys stands. Empty without one."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^\x{FEFF}?---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w -]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^:]+):", 1))).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"^[\"']|[\"']$", "").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def body(text: Column) -> Column:
    """The text after its front matter."""
    return F.regexp_replace(text, r"(?s)^\x{FEFF}?---[ \t]*\n.*?\n---[ \t]*(?:\n|$)", "")


def page_markers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"<!-- page (\d{1,6}) -->"), 1), lambda x: x.cast("int"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; a byte order mark before the first name is dropped, names are trimmed."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").option("multiLine", "true").csv(path)
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def with_catalog(parts: DataFrame, entries: DataFrame, keys: list[tuple[Column, Column]], values: list[str]) -> DataFrame:
    """Parts left-joined to catalog entries over several keys; the first key that hits gives all values."""
    out = parts
    for i, (left, right) in enumerate(keys):
        side = entries.groupBy(right.alias(f"_k{i}")).agg(F.first(F.struct(*values), ignorenulls=True).alias(f"_v{i}")).where(F.col(f"_k{i}").isNotNull() & (F.col(f"_k{i}") != ""))
        out = out.withColumn(f"_l{i}", left).join(side, F.col(f"_l{i}") == F.col(f"_k{i}"), "left").drop(f"_l{i}", f"_k{i}")
    hit = F.coalesce(*[F.col(f"_v{i}") for i in range(len(keys))])
    return out.withColumn("_hit", hit).select(*parts.columns, *[F.nullif(F.trim(F.col(f"_hit.{v}")), F.lit("")).alias(f"catalog_{v}") for v in values])


def json_files(spark: SparkSession, glob: str, schema: str, key: str) -> DataFrame:
    """Objects of many JSON files; of one key the file that sorts last stands. Malformed input fails."""
    df = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(glob).withColumn("_file", F.col("_metadata.file_path"))
    columns = [c for c in df.columns if c not in ("_file", key)]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("_file")).alias("v")).select(key, "v.*")


def api_endpoints(documents: DataFrame, text: str = "text") -> DataFrame:
    """path, operation_id, tags, parameters of every GET of an OpenAPI document; a missing id is made of the path."""
    schema = "struct<paths:map<string,map<string,struct<operationId:string,tags:array<string>,parameters:array<struct<name:string,required:boolean>>>>>>"
    paths = documents.select(F.explode(F.from_json(text, schema)["paths"]).alias("path", "ops"))
    get = F.element_at("ops", "get")
    made = F.concat(F.lit("get"), F.regexp_replace(F.initcap(F.regexp_replace("path", "[^A-Za-z0-9]+", " ")), " ", ""))
    return paths.select("path", get.alias("get")).where("get is not null").select("path", F.coalesce("get.operationId", made).alias("operation_id"), "get.tags", "get.parameters")


def upsert(table: VersionedTable, rows: DataFrame, keys: list[str]) -> int:
    """Rows replace those of the same keys, as one new version; see ``VersionedTable.upsert``."""
    return table.upsert(rows, keys)


def write_topics(segments: DataFrame, folder: str) -> None:
    """Segments as one Parquet tree, partitioned by domain."""
    segments.write.mode("overwrite").partitionBy("domain").parquet(folder)


def write_tsv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(folder)


def canonical_json(rows: DataFrame, order: list[str]) -> str:
    """A report as JSON with sorted keys and a total order: equal input, equal bytes. For results that fit a report;
    larger ones go to ``write_json``."""
    found = [r.asDict(recursive=True) for r in rows.orderBy(*order).toLocalIterator()]
    return json.dumps(found, sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n"


def write_json(rows: DataFrame, folder: str) -> None:
    """Every row as one JSON object with sorted keys, whatever the size."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(folder)


def markdown_report(title: str, rows: DataFrame, order: list[str]) -> str:
    """A result as a Markdown table, cells escaped; all rows of it."""
    from quern.functions.text import cell

    shown = rows.select(*[cell(F.col(c).cast("string")).alias(c) for c in rows.columns]) if rows.columns else rows
    head = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    body_lines = ["| " + " | ".join("" if v is None else v for v in r) + " |" for r in shown.orderBy(*order).toLocalIterator()]
    return "\n".join([f"# {title}", "", *head, *body_lines]) + "\n"
