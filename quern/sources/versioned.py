"""A Parquet table kept in immutable versions, each described by one manifest file.

A manifest names the folders (or single files) of data that make up its version, the deletion vectors that hide
rows of them, and how far each consumer has come (``progress``). Folders are immutable once they are named, so a
manifest grows by a line per commit and not by one per file. A manifest is written aside and then takes its final
name in one step that fails if the name is taken: of two writers one fails, and a writer that dies at any moment
leaves nothing behind that a reader could see. A consumer's output and its progress stand in the same manifest, so
a run that dies before its commit is repeated whole and one that committed is not.

The one step is a hard link on a local file system and a rename without overwrite elsewhere, which HDFS does
atomically. An object store without an atomic rename needs a file system whose rename is conditional.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = ("_file", "_row")
#: Begins the name of a data folder that has subfolders by column value.
COMMIT = "commit_id="


class Conflict(RuntimeError):
    """Another writer created the version first."""


class VersionedTable:
    """``root`` may be any folder that Hadoop's file systems reach and all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # -- manifests --

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/_versions/{version:020d}.json"

    def version(self) -> int:
        """The latest version; 0 for a table without one."""
        folder = self._path(f"{self.root}/_versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        """data and vectors (paths), progress and version."""
        if version == 0:
            return {"version": 0, "data": [], "vectors": [], "progress": {}}
        stream = self._fs.open(self._path(self._manifest_path(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, aside: str, target: str) -> None:
        """Give a finished file its final name; fails if that exists."""
        if self._fs.getUri().getScheme() == "file":
            local = [self._path(p).toUri().getPath() for p in (aside, target)]
            try:
                os.link(*local)
            except FileExistsError as e:
                raise Conflict(target) from e
            return
        jvm = self.spark._jvm
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        modes = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        modes[0] = none
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(target).toUri(), self._conf).rename(self._path(aside), self._path(target), modes)
        except Exception as e:
            if self._fs.exists(self._path(target)):
                raise Conflict(target) from e
            raise

    def _create(self, version: int, data: list[str], vectors: list[str], progress: dict) -> int:
        target = self._manifest_path(version)
        if self._fs.exists(self._path(target)):
            raise Conflict(target)
        aside = self._path(f"{self.root}/_aside/{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "data": data, "vectors": vectors, "progress": progress}, sort_keys=True).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._path(f"{self.root}/_versions"))
        try:
            self._publish(aside.toString(), target)
        finally:
            self._fs.delete(aside, False)
        return version

    # -- writes --

    def _write(self, df: DataFrame, kind: str, partition_by: list[str] | None = None) -> str:
        folder = f"{self.root}/{kind}/{COMMIT if partition_by else ''}{uuid.uuid4().hex}"
        df.write.parquet(folder, partitionBy=partition_by)
        return folder

    def commit(self, df: DataFrame | None = None, progress: dict[str, int] | None = None, base: int | None = None, replace: bool = False, hide: DataFrame | None = None, adopt: list[str] | None = None, partition_by: list[str] | None = None) -> int:
        """One new version: rows of ``df`` appended (or in place of all rows), rows at ``hide`` (_file, _row) hidden by
        a deletion vector, existing Parquet files or folders of ``adopt`` taken in as they are, and progress recorded."""
        base = self.version() if base is None else base
        old = self.manifest(base)
        data, vectors = ([], []) if replace else (list(old["data"]), list(old["vectors"]))
        if hide is not None:
            vectors.append(self._write(hide.select(*PLACE), "deleted"))
        if df is not None:
            data.append(self._write(df, "data", partition_by))
        return self._create(base + 1, data + list(adopt or []), vectors, {**old["progress"], **(progress or {})})

    def delete(self, condition: str) -> int:
        """Hide the rows that meet the condition: a deletion vector of (file, row index), no rewrite."""
        base = self.version()
        rows = self.rows(base)
        return self.commit(base=base, hide=None if rows is None else rows.where(condition))

    def upsert(self, rows: DataFrame, keys: list[str], progress: dict[str, int] | None = None, base: int | None = None) -> int:
        """Rows take the place of those of the same keys, as one new version.

        Only rows that are new or differ are written, and only rows that they replace are hidden, so ``changes``
        tells what changed. Of several given rows of one key the greatest stands; keys compare null-safely.
        """
        base = self.version() if base is None else base
        others = [c for c in rows.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max(F.struct(*others) if others else F.lit(True)).alias("_new"))
        old = self.rows(base)
        if old is None:
            return self.commit(rows.select(*keys, "_new.*") if others else rows.select(*keys), progress, base)
        have = old.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *PLACE, (F.struct(*others) if others else F.lit(True)).alias("_old"))
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        from quern.runtime import cut

        met = cut(rows.join(have, on, "left").where(F.col("_file").isNull() | ~F.col("_new").eqNullSafe(F.col("_old"))))
        new = met.select(*keys, "_new").dropDuplicates(keys)
        return self.commit(new.select(*keys, "_new.*") if others else new.select(*keys), progress, base, hide=met.where("_file is not null"))

    # -- reads --

    def _hidden(self, vectors: list[str]) -> DataFrame:
        return self.spark.read.schema("_file string, _row long").parquet(*vectors)

    def _at(self, data: list[str], vectors: list[str]) -> DataFrame:
        plain, split = [d for d in data if COMMIT not in d], [d for d in data if COMMIT in d]
        read = [self.spark.read.parquet(*plain)] if plain else []
        if split:  # folders with subfolders by column value have a common base
            read.append(self.spark.read.option("basePath", f"{self.root}/data").parquet(*split))
        read = [r.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")).drop(COMMIT[:-1]) for r in read]
        df = read[0] if len(read) == 1 else read[0].unionByName(read[1])
        return df.join(self._hidden(vectors), list(PLACE), "left_anti") if vectors else df

    def rows(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version with their places (_file, _row); None for a version without data."""
        m = self.manifest(self.version() if version is None else version)
        return self._at(m["data"], m["vectors"]) if m["data"] else None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, by default the latest. A table without data has no schema to read."""
        rows = self.rows(version)
        if rows is None:
            raise ValueError(f"version {version} of {self.root} holds no data")
        return rows.drop(*PLACE)

    def changes(self, old: int, new: int | None = None) -> DataFrame | None:
        """Rows inserted or deleted between two versions, with column ``_change``; None where no manifest entry differs.

        Only folders that were added or removed and rows that were hidden since are read.
        """
        a, b = self.manifest(old), self.manifest(self.version() if new is None else new)
        added = [f for f in b["data"] if f not in set(a["data"])]
        removed = [f for f in a["data"] if f not in set(b["data"])]
        stayed = [f for f in a["data"] if f in set(b["data"])]
        vectors = [v for v in b["vectors"] if v not in set(a["vectors"])]
        parts = []
        if added:
            parts.append(self._at(added, b["vectors"]).withColumn("_change", F.lit("insert")))
        if removed:
            parts.append(self._at(removed, a["vectors"]).withColumn("_change", F.lit("delete")))
        if stayed and vectors:
            parts.append(self._at(stayed, a["vectors"]).join(self._hidden(vectors), list(PLACE), "left_semi").withColumn("_change", F.lit("delete")))
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out.drop(*PLACE)


def process_new(source: VersionedTable, sink: VersionedTable, name: str, step: Callable[[DataFrame], DataFrame]) -> int:
    """Run ``step`` over what changed in ``source`` since ``sink`` last committed under ``name``.

    Returns the processed source version. Rows of a failed run are met again by the next one, rows of a
    committed run are not: output and progress are one commit.
    """
    base = sink.version()
    done = int(sink.manifest(base)["progress"].get(name, 0))
    now = source.version()
    if now == done:
        return done
    delta = source.changes(done, now)
    sink.commit(None if delta is None else step(delta), {name: now}, base=base)
    return now
