"""Session-level helpers shared by every operator: tables, lineage cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes; beyond it the plan falls back to a shuffle join.
BROADCAST_BYTES = 32 * 1024 * 1024


def session(cores: str = "*", partitions: int = 8, app: str = "quern") -> SparkSession:
    """A local session for tests and benches. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves a local master only; on a cluster its
    absence is an error, since a machine-local folder would be lost with its executor.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="quern-checkpoint-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder: later jobs read the rows, a lost executor costs nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    # Unless the cluster decides otherwise, a checkpoint goes with the last frame that reads it.
    spark.sparkContext._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one query's tables in the shared folder. It is deleted when the session's file systems close."""
    folder = f"{shared_folder(spark).rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``fresh_folder`` whose tables no later job reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; an upper bound for scans, filters and projections of them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when the estimated size is under the limit; else the frame as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def heavy_keys(df: DataFrame, key: str, share: float = 0.002) -> list:
    """Keys that hold at least ``share`` of the rows.

    At most ``1 / share`` keys can reach that share, so the list is bounded whatever the input.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    total = df.count()
    least = max(2.0, share * total)
    return [r[0] for r in counts.where(F.col("count") >= least).select(key).collect()]


def salted_join(big: DataFrame, small: DataFrame, key: str, spread_by: str, salts: int = 16, share: float = 0.01) -> DataFrame:
    """Left join of ``big`` with ``small``, which has one row per key.

    Keys that hold ``share`` of the rows of ``big`` or more (at most 1 / share of them) are spread over
    ``salts`` partitions, and only their rows of ``small`` are copied.
    """
    heavy = heavy_keys(big, key, share)
    is_heavy = F.col(key).isin(heavy) if heavy else F.lit(False)
    salt = F.when(is_heavy, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.withColumn("_salt", F.explode(copies))
    return big.withColumn("_salt", salt).join(right, [key, "_salt"], "left").drop("_salt")


def most_frequent(counted: DataFrame, count: str, at_most: int) -> list:
    """Rows whose count reaches a threshold that no more than ``at_most`` rows reach.

    The threshold comes from a histogram of a few hundred buckets, so neither the driver nor any task sorts
    or holds more than the rows that are returned. ``counted`` is read twice.
    """
    bucket = F.floor(F.log2(F.col(count).cast("double")) * 8)
    counted = counted.where(F.col(count) > 0)
    sizes = sorted(((r["b"], r["n"]) for r in counted.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    taken, least = 0, None
    for b, n in sizes:
        if taken + n > at_most:
            break
        taken, least = taken + n, b
    return [] if least is None else counted.where(bucket >= least).collect()


def hashed_sample(df: DataFrame, rows: int, *key: str) -> list:
    """About ``rows`` rows at most, one per key, chosen by the hash of the key: the same on any partitioning, never gathered to be chosen.

    The share is a threshold on 63 bits of the hash, so it holds at any number of rows. A table whose few keys all
    miss the threshold (many repeated rows of each) gives one row of every key instead; a sample that is
    empty although the table is not is an error, since a classifier fitted on nothing would answer silently.
    """
    n = df.count()
    if n <= rows:
        return df.dropDuplicates(list(key)).collect()
    at = F.xxhash64(F.lit(17), *key).bitwiseAND(F.lit((1 << 63) - 1))
    found = df.where(at < F.lit((1 << 63) * rows // n)).dropDuplicates(list(key)).collect()
    if not found:
        found = df.dropDuplicates(list(key)).limit(rows).collect()
    if not found:
        raise ValueError(f"no row of {n} was sampled")
    return found
