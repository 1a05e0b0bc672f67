"""Watching files by samples: how long each has been at rest, kept up incrementally.

The state of a file folds: the summary of a batch says how its samples end, and joins the summary before it. That
holds for samples that come in order. A file that a batch names with a sample not later than the newest one known
is decided again from all its samples, which the log of samples keeps (the source's own files, taken in as they
are). Order is by (sampled_at, sample_id) throughout, so the state does not depend on how samples arrive.

A micro-batch is aggregated like any table (a file with a third of the samples is combined before the shuffle),
and log and state are committed with its number: a batch that is replayed after a failure changes nothing. Only
the states of files that a batch names are written.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import cut
from quern.sources.versioned import VersionedTable

#: A file with this share of all samples or more meets its summary by broadcast; at most 1 / share do.
HOT_SHARE = 0.01
#: Added to the priority of a document whose files changed. Fixed value.
REFRESH_BONUS = 100_000


def _keyed(samples: DataFrame) -> DataFrame:
    """file, value, at (a sample without a time is the earliest)."""
    file = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("document_key", "root_name", "relative_path")])
    at = F.struct(F.coalesce("sampled_at", F.lit(0).cast("timestamp")).alias("sampled_at"), "sample_id")
    return samples.select(file.alias("file"), F.struct("size_bytes", "modified_ns").alias("value"), at.alias("at"))


def summaries(samples: DataFrame) -> DataFrame:
    """file, size_bytes, modified_ns, stable, samples, first, newest, whole: the newest look at each file, how many
    samples at the end are like it, the places in time of its first and last sample, and whether all are alike."""
    return _summed(_keyed(samples))


def _summed(rows: DataFrame) -> DataFrame:
    by_value = rows.groupBy("file", "value").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    now = by_value.groupBy("file").agg(F.max_by("value", "last").alias("now"), F.sum("n").alias("samples"), F.min("first").alias("first"), F.max("last").alias("newest"))
    ends = by_value.join(now.select("file", F.col("newest").alias("end")), "file").groupBy("file").agg(F.max(F.when(F.col("last") != F.col("end"), F.col("last"))).alias("change"))
    now = cut(now.join(ends, "file"))
    # Samples after the last change: the few files with many samples meet their row by broadcast, the others by a join.
    total = now.agg(F.sum("samples")).first()[0] or 0
    hot = F.broadcast(now.where(F.col("samples") >= max(1000, total * HOT_SHARE)).select("file", "change"))
    cold = now.where(F.col("samples") < max(1000, total * HOT_SHARE)).select("file", "change")
    after = (F.col("change").isNull() | (F.col("at") > F.col("change"))).cast("int")
    light = rows.select("file", "at")
    tail = light.join(hot, "file").unionByName(light.join(cold, "file")).groupBy("file").agg(F.sum(after).alias("stable"))
    return now.join(tail, "file").select("file", "now.size_bytes", "now.modified_ns", "stable", "samples", "first", "newest", (F.col("stable") == F.col("samples")).alias("whole"))


STATE = ["file", "size_bytes", "modified_ns", "stable", "samples", "first", "newest"]


def folded(state: DataFrame | None, batch: DataFrame, log: DataFrame) -> DataFrame:
    """The states of the files that a batch of samples names. ``log`` has all samples so far, with those of the batch."""
    new = summaries(batch)
    if state is None:
        return new.select(*STATE)
    s, b = state.alias("s"), cut(new).alias("b")
    known = F.col("s.samples").isNotNull()
    both = cut(b.join(s, "file", "left").select("b.*", F.struct("s.*").alias("s"), (known & (F.col("b.first") <= F.col("s.newest"))).alias("late")))
    like = F.struct("size_bytes", "modified_ns").eqNullSafe(F.struct("s.size_bytes", "s.modified_ns"))
    stable = F.when(F.col("s.samples").isNotNull() & F.col("whole") & like, F.col("s.stable") + F.col("stable")).otherwise(F.col("stable"))
    on_time = both.where(~F.col("late")).select(
        "file", "size_bytes", "modified_ns", stable.alias("stable"), (F.col("samples") + F.coalesce("s.samples", F.lit(0))).alias("samples"), F.coalesce("s.first", "first").alias("first"), "newest"
    )
    again = _summed(_keyed(log).join(both.where("late").select("file"), "file", "left_semi")).select(*STATE)
    return on_time.unionByName(again)


def watch(spark: SparkSession, source: str, root: str, name: str = "watcher", files_per_batch: int | None = None, poll_seconds: float | None = None, duty: float = 0.2, rounds: int | None = None) -> VersionedTable:
    """Work off what is new in a folder or file of samples and return the table of states.

    Without ``poll_seconds`` one pass is made. With it passes repeat, at least that many seconds and so many that
    no more than the share ``duty`` of the time is spent working, until ``rounds`` are done.
    """
    log, table = VersionedTable(spark, f"{root}/log"), VersionedTable(spark, f"{root}/state")

    def step(batch: DataFrame, number: int) -> None:
        if log.manifest(log.version())["progress"].get(name, -1) < number:
            files = [r[0] for r in batch.select("_source").distinct().collect()]  # the files of one micro-batch, which the stream itself lists
            log.commit(adopt=files, progress={name: number})
        base = table.version()
        manifest = table.manifest(base)
        if manifest["progress"].get(name, -1) >= number:
            return
        old = table.read(base) if manifest["data"] else None
        table.upsert(folded(old, batch, log.read()), ["file"], {name: number}, base)

    schema = spark.read.parquet(source).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        stream = reader.parquet(source)
    else:  # a file source watches folders; of this one it takes the file alone
        stream = reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    stream = stream.select("*", F.col("_metadata.file_path").alias("_source"))
    done = 0
    while True:
        began = time.monotonic()
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
        done += 1
        if poll_seconds is None or done == rounds:
            return table
        time.sleep(pause(time.monotonic() - began, poll_seconds, duty))


def pause(worked: float, poll_seconds: float = 10.0, duty: float = 0.2) -> float:
    """Seconds to rest after a pass that took ``worked``: the poll interval, or longer where the duty share asks for it."""
    return max(poll_seconds, worked * (1 - duty) / duty)


def at_rest(states: DataFrame, samples: int = 2) -> DataFrame:
    """Files whose last ``samples`` looks or more are alike."""
    return states.where(F.col("stable") >= samples)


def ready_sets(states: DataFrame, peers: DataFrame, samples: int = 2) -> DataFrame:
    """group: the groups of ``peers`` (file, group) of which every file is at rest; files never seen hold a group back."""
    j = peers.select("file", "group").distinct().join(states.select("file", "stable"), "file", "left")
    return j.groupBy("group").agg(F.min(F.coalesce("stable", F.lit(0))).alias("least"), F.count("*").alias("files")).where(F.col("least") >= samples).select("group", "files")


def prune(table: VersionedTable, present: DataFrame) -> int:
    """Forget the states of files that are no longer there (``present`` has file); returns the version."""
    rows = table.rows()
    return table.version() if rows is None else table.commit(hide=rows.join(present.select("file"), "file", "left_anti"))


def refreshed(queue: DataFrame, changed: DataFrame, bonus: int = REFRESH_BONUS) -> DataFrame:
    """The queue (document_key, status, priority) after files changed: documents of ``changed`` are pending again, ahead of all others.

    A document that was lifted before is not lifted twice; documents not in the queue stay out of it.
    """
    hit = changed.select("document_key").distinct().withColumn("_hit", F.lit(True))
    lifted = F.when(F.col("priority") >= bonus, F.col("priority")).otherwise(F.coalesce("priority", F.lit(0)) + bonus)
    j = queue.join(hit, "document_key", "left")
    return j.select("document_key", F.when(F.col("_hit"), "pending").otherwise(F.col("status")).alias("status"), F.when(F.col("_hit"), lifted).otherwise(F.col("priority")).alias("priority"))
