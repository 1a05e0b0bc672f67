"""Comparisons with a baseline, references that resolve or not, registers and queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_diff(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of both sides with ``change``: new, removed or unchanged. Keys compare null-safely and count once."""
    a = baseline.select(*keys).distinct().withColumn("_old", F.lit(True)).alias("a")
    b = current.select(*keys).distinct().withColumn("_new", F.lit(True)).alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = a.join(b, on, "full")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").otherwise("unchanged")
    return both.select(*[F.when(F.col("_new").isNotNull(), F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys], change.alias("change"))


def ratchet(diff: DataFrame, had_baseline: bool = True) -> DataFrame:
    """One row: new, removed, unchanged and exit_code (0 clean, 1 regression, 2 no baseline or nothing checked)."""
    counts = diff.agg(*[F.coalesce(F.sum(F.when(F.col("change") == c, 1).otherwise(0)), F.lit(0)).alias(c) for c in ("new", "removed", "unchanged")])
    empty = (F.col("new") + F.col("unchanged")) == 0
    return counts.withColumn("exit_code", F.when(F.lit(not had_baseline) | empty, 2).when(F.col("new") > 0, 1).otherwise(0))


def compare(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and ``drift``: only_left, only_right, or the comma-separated columns whose values differ; equal rows are left out."""
    a = left.select(F.col(key).alias("k"), *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("in_a"))
    b = right.select(F.col(key).alias("k"), *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("in_b"))
    changed = F.concat_ws(",", *[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns])
    drift = F.when(F.col("in_a").isNull(), "only_right").when(F.col("in_b").isNull(), "only_left").otherwise(changed)
    return a.join(b, "k", "full").select(F.col("k").alias(key), drift.alias("drift")).where("drift <> ''")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand on more than one row: an error wherever a register is compared."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def resolve_suffix(citations: DataFrame, files: DataFrame) -> DataFrame:
    """citation, matches, status for paths that may be cited by their end only.

    The join is on the file's base name; the longer part is checked as a suffix at a folder boundary.
    """
    base = F.element_at(F.split(F.col("path"), "/"), -1)
    have = files.select("path").distinct().withColumn("base", base).withColumnRenamed("path", "have")
    cited = citations.select(F.col("citation").alias("path")).distinct().withColumn("base", base)
    hit = (F.col("have") == F.col("path")) | F.col("have").endswith(F.concat(F.lit("/"), F.col("path")))
    found = cited.join(have, "base", "left").groupBy("path").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("matches"), F.max(F.col("have") == F.col("path")).alias("exact"))
    return found.select(F.col("path").alias("citation"), "matches", F.when(F.col("exact"), "exact").when(F.col("matches") == 1, "suffix").when(F.col("matches") > 1, "ambiguous").otherwise("missing").alias("status"))


def nearest_names(stale: DataFrame, symbols: DataFrame) -> DataFrame:
    """stale, nearest, distance: the known name at the least edit distance, if it is at most half the length.

    Names meet over shared character pairs instead of a cross join. None is lost: a name of n characters has n + 1
    pairs with its ends marked, one edit touches two of them, so names without a common pair are (n + 1) / 2 edits
    apart or more, for the longer of both, which is above half the length of the stale one.
    """
    def pairs(c: str):
        p = F.concat(F.lit("^"), F.lower(c), F.lit("$"))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2))))

    known = symbols.select(F.col("name").alias("symbol")).distinct()
    lost = stale.select(F.col("name").alias("stale")).distinct().join(known, F.col("stale") == F.col("symbol"), "left_anti")
    met = lost.select("stale", F.explode(pairs("stale")).alias("g")).join(known.select("symbol", F.explode(pairs("symbol")).alias("g")), "g").select("stale", "symbol").distinct()
    near = met.withColumn("distance", F.levenshtein("stale", "symbol"))
    best = near.groupBy("stale").agg(F.min(F.struct("distance", "symbol")).alias("b"))
    return lost.join(best, "stale", "left").select("stale", F.when(F.col("b.distance") <= F.floor(F.length("stale") / 2), F.col("b.symbol")).alias("nearest"), F.when(F.col("b.distance") <= F.floor(F.length("stale") / 2), F.col("b.distance")).alias("distance"))


def queue_state(work: DataFrame) -> DataFrame:
    """document_key, status, priority, attempts: the latest event of each document, null times first."""
    at = F.struct(F.coalesce("updated_at", F.lit(0).cast("timestamp")), "run_id", F.lower(F.trim("status")), "priority", "attempt_count")
    return work.groupBy("document_key").agg(F.max_by(F.struct(F.lower(F.trim("status")).alias("status"), "priority", "attempt_count", "lease_expires_at", "updated_at"), at).alias("e")).select("document_key", "e.*")


def claimable(state: DataFrame, now: str) -> DataFrame:
    """Queue rows that may be claimed at ``now``: pending, failed, or leased with an expired lease."""
    return state.where(F.col("status").isin("pending", "failed") | ((F.col("status") == "leased") & (F.col("lease_expires_at") <= F.lit(now).cast("timestamp"))))


def assign(state: DataFrame, now: str, workers: int, each: int) -> DataFrame:
    """Deterministic claim of a batch: the first workers x each rows by priority, time and key, dealt out in turn."""
    top = claimable(state, now).orderBy(F.desc("priority"), F.asc_nulls_first("updated_at"), "document_key").limit(workers * each)
    return top.select("document_key", "priority", "updated_at")


def free_numbers(taken: DataFrame, wanted: DataFrame, low: int, high: int) -> DataFrame:
    """name, number: names that have one keep it, the rest get the free numbers of [low, high] in order of name.

    More names than free numbers are an error.
    """
    from pyspark.sql import Window

    spark = taken.sparkSession
    numbers = spark.range(low, high + 1).select(F.col("id").cast("int").alias("number"))
    free = numbers.join(taken.select("number"), "number", "left_anti").withColumn("k", F.row_number().over(Window.orderBy("number")))
    new = wanted.select("name").distinct().join(taken.select("name"), "name", "left_anti").orderBy("name").limit(high - low + 1).withColumn("k", F.row_number().over(Window.orderBy("name")))
    if wanted.select("name").distinct().join(taken.select("name"), "name", "left_anti").count() > free.count():
        raise ValueError(f"no free number left in [{low}, {high}]")
    kept = wanted.select("name").distinct().join(taken.select("name", "number"), "name", "left")
    given = new.join(free, "k", "left").select("name", F.col("number").alias("fresh"))
    return kept.join(given, "name", "left").select("name", F.coalesce("number", "fresh").alias("number"))
