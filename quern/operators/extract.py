"""Facts in technical text, rule-based classes and life-cycle tags: column expressions over lines and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import structure

UNITS = "seconds|minutes|hours|milliseconds|megabytes|kilobytes|packets|sessions|frames|degrees|meters|watts|percent|hops|retries"
NUMERIC = rf"(\d+) ({UNITS})\b"
#: Default rules: domain, keyword, priority (lower first). A rule table with these columns may replace them.
DOMAINS = [("security", "security", 1), ("security", "firewall", 2), ("upgrade", "upgrade path", 1), ("upgrade", "migration", 2), ("reference", "command reference", 1), ("reference", "hardware manual", 2), ("operations", "monitoring", 1), ("operations", "operations", 2), ("start", "quick start", 1), ("start", "setup guide", 2), ("training", "service course", 1), ("news", "release bulletin", 1), ("field", "field notes", 1)]
LIFECYCLE = {"day0": ("before", "prepare", "plan", "order"), "day1": ("set", "install", "register", "create", "connect"), "day2": ("monitor", "report", "log", "count", "poll", "check"), "day2plus": ("upgrade", "replace", "rebuild", "migrate", "repair")}


def numeric_facts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, value, unit: every number with a unit."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(\d+ (?:{UNITS}))\b"), 1)
    return texts.select(key, F.explode(found).alias("m")).select(key, F.split("m", " ")[0].try_cast("long").alias("value"), F.split("m", " ")[1].alias("unit"))


def commands(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, page, line_no, command: fenced lines that begin with a command word."""
    rows = structure.annotated(texts, key, text).where(F.col("fenced"))
    line = T.stripped(F.col("line"))
    return rows.where(F.regexp_extract(line, r"^(\w+)", 1).isin(*T.COMMANDS)).select(key, "page", "line_no", line.alias("command"))


def constraints(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, mark, fact: sentences with must, cannot or only (MUST) or should (SHOULD), outside fences."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"```[^`]*```", " "), r"\s+", " ")
    sentence = F.explode(F.regexp_extract_all(body, F.lit(r"([A-Z][^.!?]*[.!?])"), 1))
    rows = texts.select(key, sentence.alias("fact"))
    low = F.lower("fact")
    return rows.select(key, F.when(low.rlike(r"\b(?:must|cannot|only|required)\b"), "MUST").when(low.rlike(r"\b(?:should|recommended)\b"), "SHOULD").otherwise("INFO").alias("mark"), "fact").where("mark <> 'INFO'")


def table_cells(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, header, value: cells of pipe tables with their header, which is the first row of a run of rows."""
    from pyspark.sql import Window

    rows = structure.annotated(texts, key, text).where(~F.col("fenced"))
    is_row = F.col("line").startswith("|")
    w = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("row", is_row).withColumn("begins", (F.col("row") & ~F.coalesce(F.lag("row").over(w), F.lit(False))).cast("int"))
    rows = rows.withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("row")
    cells = F.filter(F.transform(F.split("line", r"\|"), T.stripped), lambda c: c != "")
    rows = rows.withColumn("cells", cells).where(~F.col("line").rlike(r"^[|\s:-]+$"))
    head = F.first(F.when(F.col("begins") == 1, F.col("cells")), ignorenulls=True).over(Window.partitionBy(key, "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("head", head).where("begins = 0")
    return rows.select(key, "line_no", F.explode(F.arrays_zip("head", "cells")).alias("z")).where("z.head is not null and z.cells is not null").select(key, "line_no", F.col("z.head").alias("header"), F.col("z.cells").alias("value"))


def classify(documents: DataFrame, rules: DataFrame, key: str, signals: list[str]) -> DataFrame:
    """key, domain, confidence: the first hit by signal, then rule priority, then domain; else general at 0.2.

    Rules are a small table by nature; each signal of a document meets them in one pass of the scan.
    """
    from quern.runtime import broadcast_if_small

    s = documents.select(key, F.posexplode(F.array(*[T.signal(F.coalesce(c, F.lit(""))) for c in signals])).alias("place", "signal")).dropDuplicates([key, "place", "signal"])
    words = F.explode(F.array_distinct(F.split(F.col("keyword"), " ")))
    # A keyword can only be contained in a signal that has its first word: an equi-join instead of a cross join.
    first = rules.withColumn("w", F.split("keyword", " ")[0])
    hits = s.withColumn("w", F.explode(F.array_distinct(F.split("signal", " ")))).join(broadcast_if_small(first), "w").where(F.concat(F.lit(" "), "signal", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("keyword"), F.lit(" "))))
    best = hits.groupBy(key).agg(F.min(F.struct("place", "priority", "domain")).alias("b"))
    confidence = F.round(F.lit(1.0) - F.col("b.place") * 0.2 - (F.col("b.priority") - 1) * 0.1, 2)
    return documents.select(key).distinct().join(best, key, "left").select(key, F.coalesce("b.domain", F.lit("general")).alias("domain"), F.coalesce(confidence, F.lit(0.2)).alias("confidence"))


def lifecycle(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key and the share-deciding counts of each stage's words; ``tag`` is the stage with most, at least 3, else day0."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = {d: F.regexp_count(low, F.lit(r"\b(?:" + "|".join(w) + r")\b")).cast("long") for d, w in LIFECYCLE.items()}
    rows = texts.select(key, *[c.alias(d) for d, c in counts.items()])
    best: Column = F.lit("day0")
    top = F.greatest(*[F.col(d) for d in LIFECYCLE])
    for d in reversed(LIFECYCLE):
        best = F.when((F.col(d) == top) & (top >= 3), d).otherwise(best)
    return rows.withColumn("tag", best)
