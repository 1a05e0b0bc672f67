"""Verbatim overlap of generated statements with their own sources: shared word runs, bands, longest run.

Runs are found by joining 8-word windows of the two sides within one generated path, then following the
diagonals on which they line up; a run of w windows is w + 7 words. Below 8 words the length is not needed:
the band is cleared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

# Seed length and the bands of shared words.
SEED, WARN, FAIL = 8, 8, 12


def _windows(df: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    n = F.size(tokens) - SEED + 1
    grams = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(SEED)), " ")))
    return df.select(*keys, F.posexplode(grams).alias("at", "gram"))


def longest_runs(cards: DataFrame, inputs: DataFrame) -> DataFrame:
    """card_id, input_id, run: the longest run of 8 words or more shared with one segment of an input of the same path."""
    c = cards.where("generated_path is not null and fact is not null").select("card_id", "generated_path", T.ascii_tokens(F.col("fact")).alias("tokens"))
    s = inputs.where("generated_path is not null").select("input_id", "generated_path", F.posexplode("source_segments").alias("segment", "t")).where("t is not null").select("input_id", "generated_path", "segment", T.ascii_tokens(F.col("t")).alias("tokens"))
    left = _windows(c, ["card_id", "generated_path"], "tokens")
    right = _windows(s, ["input_id", "generated_path", "segment"], "tokens").withColumnRenamed("at", "b")
    met = left.join(right, ["generated_path", "gram"]).select("card_id", "input_id", "segment", "at", (F.col("at") - F.col("b")).alias("diagonal"))
    island = F.col("at") - F.row_number().over(Window.partitionBy("card_id", "input_id", "segment", "diagonal").orderBy("at"))
    runs = met.withColumn("island", island).groupBy("card_id", "input_id", "segment", "diagonal", "island").agg((F.count("*") + SEED - 1).alias("run"))
    return runs.groupBy("card_id", "input_id").agg(F.max("run").cast("int").alias("run"))


def bands(cards: DataFrame, inputs: DataFrame) -> DataFrame:
    """card_id, run, band for every card: failed above 12 shared words, warned from 8, else cleared."""
    best = longest_runs(cards, inputs).groupBy("card_id").agg(F.max("run").alias("run"))
    band = F.when(F.col("run") > FAIL, "failed").when(F.col("run") >= WARN, "warned").otherwise("cleared")
    return cards.select("card_id").distinct().join(best, "card_id", "left").select("card_id", F.coalesce("run", F.lit(0)).alias("run"), band.alias("band"))
