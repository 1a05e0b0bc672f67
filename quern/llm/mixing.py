"""Mixing sources to target shares of the tokens.

Every document gets a hash-random key. Its top bits name a bucket within the source; prefix sums over the
bucket totals (sources x ``BUCKETS`` rows, whatever the corpus) find the one bucket of each source in which
the budget ends, and only there prefix sums run over single documents. A source with a third of all rows is
spread over all its buckets.

Defined results: spellings of a source fold (case, blanks, underscore); documents without a listed source
or without a doc_id are left out; repeated rows of one doc_id count as often as they stand; null or empty texts have 0 tokens and ride along free; a listed source without documents is
reported with zeros; an empty target gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import broadcast_if_small, cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUCKETS_LOG2 = 12
SEED = 20
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        # Fixed value: the public pre-tokenization pattern of this vocabulary.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def source_key(name: Column) -> Column:
    """One spelling per source."""
    return F.regexp_replace(F.lower(F.trim(name)), "[_\\s]+", "-")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens of each document, whole texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(encode(t)) if t else 0 for t in b["text"]]})

    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), source_key(F.col("source")).alias("source"), "text").mapInPandas(count, "doc_id long, source string, tokens long")


def _targets(mix: DataFrame) -> DataFrame:
    return mix.where("source is not null").groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats")
    )


def mixture(documents: DataFrame, mix: DataFrame, total_tokens: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).

    ``chosen`` has doc_id, source, tokens, copies for every document used; copies never exceed the source's
    max_repeats. ``report`` has one row per listed source; its ``largest_total`` is the largest size at which every
    source still reaches its share. ``total_tokens`` is the size to aim at, by default
    all tokens of the listed sources. A source takes its budget, target_share of that size, exactly but for
    less than one document; one that cannot reach it with max_repeats epochs gives all it has.
    """
    targets = broadcast_if_small(_targets(mix))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    counts = token_counts(documents, tokenizer).join(targets.select("source"), "source", "left_semi")
    docs = cut(counts.withColumn("key", key).withColumn("bucket", F.shiftrightunsigned("key", 64 - BUCKETS_LOG2).cast("int")))

    buckets = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("held"), F.count("*").alias("documents"))
    by_source = Window.partitionBy("source").orderBy("bucket")
    buckets = cut(buckets.withColumn("until", F.sum("held").over(by_source)))
    have = buckets.groupBy("source").agg(F.sum("held").alias("available"), F.sum("documents").alias("documents"))
    plan = targets.join(have, "source", "left").fillna({"available": 0, "documents": 0})
    if total_tokens is None:
        total_tokens = plan.agg(F.sum("available")).first()[0] or 0
    plan = (
        plan.withColumn("budget", F.round(F.col("target_share") * F.lit(int(total_tokens))).cast("long"))
        .withColumn("epochs", F.when(F.col("available") > 0, F.least(F.expr("budget div available"), F.col("max_repeats").cast("long"))).otherwise(0))
        .withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0))
    )
    # The first bucket whose prefix sum exceeds the rest holds the cut.
    edge = buckets.join(plan.select("source", "rest"), "source").where(F.col("until") > F.col("rest")).groupBy("source").agg(F.min_by("bucket", "bucket").alias("edge"), F.min_by(F.col("until") - F.col("held"), "bucket").alias("before"))
    plan = cut(plan.join(edge, "source", "left"))
    ends = broadcast_if_small(plan.select("source", "epochs", "rest", "edge", "before"))
    placed = docs.join(ends, "source")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id")
    at_edge = placed.where(F.col("bucket") == F.col("edge")).withColumn("sum", F.col("before") + F.sum("tokens").over(within)).withColumn("extra", (F.col("sum") <= F.col("rest")).cast("long"))
    clear = placed.where(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).withColumn("extra", (F.coalesce(F.col("bucket") < F.col("edge"), F.lit(True)) & (F.col("rest") > 0)).cast("long"))
    columns = ["doc_id", "source", "tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("copies")]
    chosen = clear.select(*columns).unionByName(at_edge.select(*columns)).where("copies > 0")

    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("repeats"), F.count("*").alias("used_documents"))
    report = plan.join(used, "source", "left").fillna({"tokens": 0, "repeats": 0, "used_documents": 0})
    whole = Window.partitionBy()  # one row per listed source
    reach = F.when(F.col("target_share") > 0, F.floor(F.col("available") * F.col("max_repeats") / F.col("target_share")))
    return chosen, report.select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(whole), F.lit(0)), F.lit(0.0)).alias("actual_share"), "tokens", "repeats",
        "max_repeats", F.col("budget").alias("target_tokens"), F.col("available").alias("available_tokens"), "documents", "used_documents",
        F.min(reach).over(whole).alias("largest_total"),
    )
