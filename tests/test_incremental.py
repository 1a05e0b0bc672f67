"""Manifests, pending files and versioned tables."""

from __future__ import annotations

import datetime as dt

import pytest

from quern.operators import incremental
from quern.sources import readers
from quern.sources.versioned import Conflict, VersionedTable, process_new

T0 = dt.datetime(2026, 1, 1)
SAMPLES = "sample_id long, document_key string, root_name string, relative_path string, size_bytes long, modified_ns long, stable_checks int, content_hash string, sampled_at timestamp, status string, salt int"
WORK = "document_key string, run_id long, status string, updated_at timestamp, sample_id long"


def at(h):
    return T0 + dt.timedelta(hours=h)


def sample(i, doc, path, hour, content, stable=2):
    return (i, doc, "r", path, 1, 1, stable, content, at(hour), "x", 1)


def pending(spark, samples, work):
    df = incremental.pending_files(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame([(*w, 1) for w in work], WORK))
    return {(r["document_key"], r["relative_path"]): r["change"] for r in df.collect()}


def run(doc, n, start, end, status="done"):
    return [(doc, n, "Leased", at(start)), (doc, n, f" {status.upper()}", at(end))]


def test_pending(spark):
    samples = [
        sample(1, "a", "same", 1, "h1"), sample(2, "a", "same", 9, None),
        sample(3, "a", "edited", 1, "h1"), sample(4, "a", "edited", 9, "h2"),
        sample(5, "a", "late", 4, "h1"), sample(6, "a", "moving", 1, "h1"), sample(7, "a", "moving", 9, "h2", stable=1),
        sample(8, "a", "back", 1, "h1"), sample(9, "a", "back", 8, "h2"), sample(10, "a", "back", 9, "h1"),
        sample(11, "b", "x", 1, "h1"), sample(12, "c", "x", 1, "h1"), sample(13, "a", "unknown", 9, "h", stable=None),
    ]
    work = [*run("a", 1, 3, 5), *run("a", 2, 9, 10, "failed"), ("a", 3, "leased", at(11)), *run("b", 1, 3, 5, "failed"), ("c", 1, "done", at(9)), ("c", 0, "pending", None)]
    assert pending(spark, samples, work) == {("a", "edited"): "changed", ("a", "late"): "added", ("b", "x"): "added", ("c", "x"): "added"}
    assert pending(spark, samples + samples, work + work) == pending(spark, samples, work)


def test_pending_odd_rows(spark):
    samples = [sample(1, None, "x", 1, None), sample(2, "a", "never hashed", 1, None), (None, "a", None, None, None, None, 3, "h", at(2), None, None)]
    assert pending(spark, samples, run("a", 1, 3, 5)) == {(None, "x"): "added"}
    assert pending(spark, [], []) == {} and pending(spark, samples, []) != {} and pending(spark, [], run("a", 1, 1, 2)) == {}


def test_hot_file_is_spread(spark):
    samples = [sample(i, "hot", "log", i, f"h{i}") for i in range(400)] + [sample(1000 + i, f"d{i}", "f", 1, "h") for i in range(100)]
    got = pending(spark, samples, run("hot", 1, 399, 400))
    assert ("hot", "log") not in got and len(got) == 100


def test_manifest_delta(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), (None, "1"), ("d", None)], "k string, t string")
    new = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), (None, "1"), ("c", "1"), ("d", None)], "k string, t string")
    got = {(r["k"], r["change"]) for r in incremental.manifest_delta(old, new, ["k"], "t").collect()}
    assert got == {("b", "changed"), ("c", "added")}
    assert {r["change"] for r in incremental.manifest_delta(old, new.limit(0), ["k"], "t").collect()} == {"removed"}


def test_versions_and_exactly_once(spark, tmp_path):
    source, sink = VersionedTable(spark, f"{tmp_path}/source"), VersionedTable(spark, f"{tmp_path}/sink")
    source.commit(spark.range(0, 100).repartition(3))
    assert process_new(source, sink, "job", lambda d: d) == 1
    source.commit(spark.range(100, 150))
    source.delete("id % 10 = 0")
    source.delete("id = 1")
    assert source.read().count() == 150 - 15 - 1

    def broken(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        process_new(source, sink, "job", broken)
    assert process_new(source, sink, "job", lambda d: d) == 4
    assert process_new(source, sink, "job", lambda d: d) == 4
    rows = sink.read()
    assert rows.where("_change = 'insert'").count() == 100 + 45
    assert sorted(r["id"] for r in rows.where("_change = 'delete'").collect()) == sorted([*range(0, 100, 10), 1])
    assert source.read(1).count() == 100 and source.changes(4, 4) is None


def test_second_writer_fails(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.commit(spark.range(3), base=0)
    with pytest.raises(Conflict):
        t.commit(spark.range(5), base=0)
    assert t.read().count() == 3


def test_upsert(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/u")
    readers.upsert(t, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    readers.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_upsert_changes_only_what_changed(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/u")
    t.upsert(spark.range(1000).selectExpr("id k", "id % 7 v"), ["k"])
    t.upsert(spark.createDataFrame([(5, 100), (6, 6), (2000, 1)], "k long, v long"), ["k"])
    got = {(r["_change"], r["k"], r["v"]) for r in t.changes(1, 2).collect()}
    assert got == {("delete", 5, 5), ("insert", 5, 100), ("insert", 2000, 1)} and t.read().count() == 1001


def test_writer_that_dies_inside_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    source, sink = VersionedTable(spark, f"{tmp_path}/source"), VersionedTable(spark, f"{tmp_path}/sink")
    source.commit(spark.range(10))

    def dies(self, aside, target):
        raise RuntimeError("lost")

    for moment in ("_create", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(VersionedTable, moment, dies if moment == "_publish" else lambda *a: dies(None, None, None))
            with pytest.raises(RuntimeError):
                process_new(source, sink, "job", lambda d: d)
        assert sink.version() == 0 and sink.manifest(0)["progress"] == {}
    assert process_new(source, sink, "job", lambda d: d) == 1 and sink.read().count() == 10


def test_refresh_is_exact_over_versions_and_failures(spark, tmp_path, monkeypatch):
    tables = {n: VersionedTable(spark, f"{tmp_path}/{n}") for n in ("samples", "work", "sink")}
    steps = [
        ([sample(1, "a", "x", 1, "h1"), sample(2, "b", "x", 1, "h1"), sample(3, None, "x", 1, "h")], run("a", 1, 3, 5)),
        ([sample(4, "a", "x", 8, "h2"), sample(5, "c", "x", 2, "h1")], []),
        ([sample(6, "b", "x", 0, "h0")], run("b", 1, 3, 5)),
        ([], run("a", 2, 9, 10)),
        ([sample(7, None, "x", 4, "h2", stable=1)], [("c", 1, "done", at(3))]),
    ]
    seen_s, seen_w = [], []
    for k, (s, w) in enumerate(steps):
        seen_s, seen_w = seen_s + s, seen_w + w
        if s:
            tables["samples"].commit(spark.createDataFrame(s, SAMPLES))
        if w or not k:
            tables["work"].commit(spark.createDataFrame([(*x, 1) for x in w], WORK))
        with monkeypatch.context() as m:  # the run dies inside its commit
            m.setattr(VersionedTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                incremental.refresh_pending(*tables.values())
        version = incremental.refresh_pending(*tables.values())
        assert incremental.refresh_pending(*tables.values()) == version
        got = {(r["document_key"], r["relative_path"]): r["change"] for r in tables["sink"].read().collect()}
        assert got == pending(spark, seen_s, seen_w), k


def test_late_samples(spark, tmp_path):
    import os

    from quern.streaming import watcher

    def row(i, hour, size, doc="a"):
        return (i, doc, "r", "x", size, 1, 0, "h", at(hour) if hour is not None else None, "x", 1)

    batches = [[row(1, 1, 2), row(2, 3, 2), row(9, None, 2)], [row(3, 2, 1), row(8, 1, 5, "b")], [row(4, 5, 2), row(5, 4, 2), row(7, 2, 5, "b")], [row(6, 5, 3), row(10, 9, 5, "b")]]
    os.makedirs(f"{tmp_path}/in")
    root, source = f"{tmp_path}/w", f"{tmp_path}/in"
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SAMPLES).coalesce(1).write.mode("append").parquet(source)
        table = watcher.watch(spark, source, root)
        want = {r["file"]: (r["size_bytes"], r["stable"], r["samples"]) for r in watcher.summaries(spark.createDataFrame(sum(batches[: k + 1], []), SAMPLES)).collect()}
        assert {r["file"]: (r["size_bytes"], r["stable"], r["samples"]) for r in table.read().collect()} == want, k
    assert want["a\nr\nx"] == (3, 1, 7) and want["b\nr\nx"] == (5, 3, 3)
    version = table.version()
    assert watcher.watch(spark, source, root).version() == version
    watcher.prune(table, spark.createDataFrame([("b\nr\nx",)], "file string"))
    assert [r["file"] for r in table.read().collect()] == ["b\nr\nx"]
    assert watcher.pause(1.0) == 10.0 and watcher.pause(10.0) == 40.0


def test_refreshed_queue(spark):
    from quern.streaming import watcher

    q = spark.createDataFrame([("a", "done", 5), ("b", "done", None), ("c", "leased", 7), ("d", "done", 100_003)], "document_key string, status string, priority int")
    got = {r["document_key"]: (r["status"], r["priority"]) for r in watcher.refreshed(q, spark.createDataFrame([("a",), ("a",), ("b",), ("d",), ("z",)], "document_key string")).collect()}
    assert got == {"a": ("pending", 100_005), "b": ("pending", 100_000), "c": ("leased", 7), "d": ("pending", 100_003)}


def test_sample_bound_holds_at_any_size(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from quern.runtime import hashed_sample

    df = spark.range(20_000).selectExpr("id k", "id v")
    assert 800 < len(hashed_sample(df, 1000, "k")) < 1200
    twice = df.unionByName(df)
    assert len({r["k"] for r in hashed_sample(twice, 1000, "k")}) == len(hashed_sample(twice, 1000, "k"))
    assert len(hashed_sample(spark.range(5000).selectExpr("7 k", "7 v"), 100, "k")) == 1
    with monkeypatch.context() as m:  # a table so large that a share of a millionth would be none
        m.setattr(DataFrame, "count", lambda self: 10**13)
        assert hashed_sample(spark.range(200_000).selectExpr("id k"), 10**9, "k")
