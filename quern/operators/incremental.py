"""Processing only new or changed records.

The logs of samples and of queue events are versioned tables. ``refresh_pending`` diffs the manifests of their
present versions against the versions that the output's last commit names: added files, removed files and deletion
vectors yield the records that came or went, these name the documents to look at again, and the new output rows
and the processed versions are one commit. Within a document, ``pending_files`` compares the content that its last
successful run processed with the present one; ``manifest_delta`` does the same for any two sets of entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.runtime import cut, salted_join
from quern.sources.versioned import VersionedTable


def manifest_delta(old: DataFrame, new: DataFrame, keys: list[str], token: str) -> DataFrame:
    """Rows of change between two manifests: keys, old_token, new_token, change.

    ``change`` is added, removed or changed; entries with the same token are left out. Keys and tokens
    compare null-safely, entries repeated with one token count once, and of several tokens for one key
    the greatest stands. Both empty: no rows. Other columns are ignored, whatever their names.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.max(token).alias(name), F.lit(True).alias(f"in_{name}"))

    a, b = side(old, "old_token"), side(new, "new_token")
    left, right = a.alias("a"), b.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.k{i}").eqNullSafe(F.col(f"b.k{i}")) for i in range(len(keys))])
    change: Column = (
        F.when(F.col("in_old_token").isNull(), "added").when(F.col("in_new_token").isNull(), "removed").when(~F.col("old_token").eqNullSafe(F.col("new_token")), "changed")
    )
    there = F.col("in_new_token").isNotNull()
    return (
        left.join(right, on, "full")
        .select(*[F.when(there, F.col(f"b.k{i}")).otherwise(F.col(f"a.k{i}")).alias(k) for i, k in enumerate(keys)], "old_token", "new_token", change.alias("change"))
        .where(F.col("change").isNotNull())
    )


def last_success(work: DataFrame) -> DataFrame:
    """document_key and leased_at of the latest run that ended as done; leased_at is null if its lease is not logged.

    Repeated events and spellings of the status fold into one; of events at one time the higher run wins.
    """
    event = work.select("document_key", "run_id", F.lower(F.trim("status")).alias("status"), "updated_at")
    runs = event.where(F.col("status").isin("done", "leased")).groupBy("document_key", "run_id").agg(
        F.max(F.when(F.col("status") == "done", F.coalesce("updated_at", F.lit(0).cast("timestamp")))).alias("done_at"),
        F.max(F.when(F.col("status") == "leased", F.col("updated_at"))).alias("leased_at"),
    )
    return runs.where(F.col("done_at").isNotNull()).groupBy("document_key").agg(F.max_by("leased_at", F.struct("done_at", "run_id")).alias("leased_at"))


def file_states(samples: DataFrame, work: DataFrame) -> DataFrame:
    """One row per watched file: present and processed content, and whether the file is at rest.

    A sample without a hash stands for the content of the sample before, so the content at a time is the
    last hash up to it: an aggregate that combines before the shuffle, however many samples one file has.
    """
    s = samples.select("document_key", "root_name", "relative_path", "sample_id", "sampled_at", "stable_checks", "content_hash")
    at = F.struct("sampled_at", "sample_id")
    seen = F.col("leased_at").isNotNull() & (F.col("sampled_at") <= F.col("leased_at"))
    known = F.col("content_hash").isNotNull()
    return (
        salted_join(s, last_success(work), "document_key", "sample_id")
        .groupBy("document_key", "root_name", "relative_path")
        .agg(
            F.max_by("stable_checks", at).alias("stable_checks"),
            F.max_by(F.when(known, F.col("content_hash")), F.when(known, at)).alias("present_hash"),
            F.max_by(F.when(seen & known, F.col("content_hash")), F.when(seen & known, at)).alias("processed_hash"),
            F.max(seen).alias("was_seen"),
        )
    )


def pending_files(samples: DataFrame, work: DataFrame) -> DataFrame:
    """Files that the next run must process, with the kind of change.

    A file counts if its newest sample is at rest (stable_checks of 2 or more; null is not) and its content
    is not that which the last successful run of its document saw. A file that no successful run saw is
    added; one with other content is changed. Empty inputs give no rows.
    """
    keys = ["document_key", "root_name", "relative_path"]
    states = file_states(samples, work).where(F.col("stable_checks") >= 2)
    none = F.lit("-")  # a content that was seen but never hashed is a token of its own
    entries = states.select(
        *keys,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("old").alias("side"), F.coalesce("processed_hash", none).alias("token"), F.col("was_seen").alias("present")),
                    F.struct(F.lit("new").alias("side"), F.coalesce("present_hash", none).alias("token"), F.lit(True).alias("present")),
                ),
                lambda e: e["present"],
            )
        ).alias("e"),
    ).select(*keys, "e.side", "e.token")
    return manifest_delta(entries.where("side = 'old'"), entries.where("side = 'new'"), keys, "token").select(*keys, "change")


def refresh_pending(samples: VersionedTable, work: VersionedTable, sink: VersionedTable) -> int:
    """Bring the table of pending files in ``sink`` up to the present versions of the two logs; returns its version.

    Only documents with a record that came or went since the versions that ``sink`` last committed are decided
    again, from all their records; the rows of all others stay where they are. A run that dies leaves ``sink`` and
    the versions it names as they were. Nothing new: no commit.
    """
    base = sink.version()
    done = sink.manifest(base)["progress"]
    logs = {"samples": samples, "work": work}
    now = {n: t.version() for n, t in logs.items()}
    if base and all(done.get(n, 0) == v for n, v in now.items()):
        return base
    delta = {n: t.changes(done.get(n, 0), now[n]) for n, t in logs.items()}
    if not base:  # all records are new
        return sink.commit(pending_files(*(delta[n].drop("_change") for n in logs)), now, base)
    named = [d.select("document_key") for d in delta.values() if d is not None]
    if not named:
        return sink.commit(None, now, base)
    touched = cut(reduce(DataFrame.unionByName, named).distinct())

    def of_touched(df: DataFrame) -> DataFrame:
        a, b = df.alias("a"), touched.alias("b")
        return a.join(b, F.col("a.document_key").eqNullSafe(F.col("b.document_key")), "left_semi")

    fresh = pending_files(*(of_touched(t.read(now[n])) for n, t in logs.items()))
    return sink.commit(fresh, now, base, hide=of_touched(sink.rows(base)))
