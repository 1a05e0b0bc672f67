"""Long exact spans that stand in more than one record.

Windows repeated at one length alone are extended to the next, until none is left. The first level are windows of
``ANCHOR`` words, of which every run of ``LEAST`` words selects the one with the least hash: two records that share
such a run select the same window of it, so nothing is lost although two of three windows are never looked at.
Anchors that stand in one record only are dropped; around the others windows of ``LEAST`` words are hashed, and those
that stand in two records are joined with the survivors that follow them to windows twice as long, and so on.

Only (hash, record) pairs of anchors and the windows around surviving anchors are shuffled, all as numbers; texts are
read twice instead. Every level is one aggregation by hash, which combines before the shuffle, and a join against its
result; hashes that recur very often (stock notices) are few by counting and meet a bounded broadcast table instead of
the shuffle. Pairs are made between classes of texts with the same shared windows and then told for their members.

Records are facts (one per card) and generated paths (all segments of all checks of the path); spans never
run over the end of a segment. Defined results: null or empty texts have no words and a share of 0; texts
under ``LEAST`` words share nothing; a null card_id, input_id gives no pair; a card or check without an own
key (a null generated_path) counts as a record of its own; repeated rows are one record and do not share
with themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.words import chunks, hashes, window_hashes, words
from quern.runtime import cut

LEAST = 13
#: Words of the windows of the first level.
ANCHOR = 8
#: A hash with this share of all windows or more is hot; at most 1 / share are.
HOT_SHARE = 1e-4
#: Bits of the filter of surviving anchors; a full one lets more windows through to the next level, never fewer.
FILTER_BITS = 26

WINDOWS = "t long, fact boolean, id long, r long, pos int, h long"


def texts(cards: DataFrame, inputs: DataFrame) -> DataFrame:
    """t, fact, id, r, record, text of all facts and single segments; t and r are hashes of text and record."""
    f = cards.where("card_id is not null").select(
        F.concat(F.lit("f:"), F.col("card_id").cast("string")).alias("text_id"), F.lit(True).alias("fact"), F.col("card_id").cast("long").alias("id"),
        F.concat(F.lit("f:"), F.col("card_id").cast("string")).alias("record"), F.col("fact").cast("string").alias("text"),
    )
    g = inputs.where("input_id is not null").select(
        F.col("input_id").cast("long").alias("id"), F.concat(F.lit("g:"), F.coalesce("generated_path", F.concat(F.lit("#"), F.col("input_id").cast("string")))).alias("record"), F.posexplode("source_segments").alias("segment", "text")
    )
    g = g.select(F.concat_ws(":", F.lit("g"), "id", "segment").alias("text_id"), F.lit(False).alias("fact"), "id", "record", "text")
    return f.unionByName(g).select(F.xxhash64("text_id").alias("t"), "fact", "id", F.xxhash64("record").alias("r"), "record", "text")


def _chunk(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a chunk of texts in a row, the end of each, and the text of each word."""
    tokens = [words(t) for t in held]
    ends = np.cumsum([len(t) for t in tokens])
    return hashes([w for t in tokens for w in t]), ends, np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])


def _anchors(flat: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors that the runs of ``LEAST`` words of single texts select."""
    w = window_hashes(flat, ANCHOR)
    n = len(flat) - LEAST + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, at = w[:n].copy(), np.arange(n)
    for k in range(1, LEAST - ANCHOR + 1):
        lower = w[k : n + k] < best
        best[lower] = w[k : n + k][lower]
        at[lower] = np.flatnonzero(lower) + k
    inside = np.arange(n) + LEAST <= ends[owner[:n]]
    chosen = np.zeros(len(w), bool)
    chosen[at[inside]] = True
    places = np.flatnonzero(chosen)
    return places, w[places]


def _select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        held, r = b["text"].tolist(), b["r"].to_numpy()
        for lo, hi in chunks(held):
            flat, ends, owner = _chunk(held[lo:hi])
            places, h = _anchors(flat, ends, owner)
            yield pd.DataFrame({"h": h.view(np.int64), "r": r[lo:hi][owner[places]]})


def _around(kept, counted: bool):
    """Windows of ``LEAST`` words around surviving anchors; if ``counted`` the number of words of every text too, at place -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = b["text"].tolist()
            for lo, hi in chunks(held):
                flat, ends, owner = _chunk(held[lo:hi])
                places, h = _anchors(flat, ends, owner)
                bit = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                places = places[(kept.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                n = max(len(flat) - LEAST + 1, 0)
                marked = np.zeros(n, bool)
                for k in range(LEAST - ANCHOR + 1):
                    at = places - k
                    marked[at[(at >= 0) & (at < n)]] = True
                at = np.flatnonzero(marked)
                at = at[at + LEAST <= ends[owner[at]]]
                rows = b.iloc[lo:hi]
                doc, starts = owner[at], ends - np.diff(np.r_[0, ends])
                out = pd.DataFrame({"t": rows["t"].to_numpy()[doc], "fact": rows["fact"].to_numpy()[doc], "id": rows["id"].to_numpy()[doc], "r": rows["r"].to_numpy()[doc], "pos": (at - starts[doc]).astype(np.int32), "h": window_hashes(flat, LEAST)[at].view(np.int64)})
                yield out
                if counted:
                    yield rows[["t", "fact", "id", "r"]].assign(pos=np.int32(-1), h=np.diff(np.r_[0, ends]))

    return run


def _bits(keys: DataFrame) -> np.ndarray:
    """Bit set of the leading bits of the hashes: 2 ** FILTER_BITS bits on the driver, whatever their number."""
    place = F.shiftrightunsigned("h", 64 - FILTER_BITS) + 1
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    maps = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    for row in maps.toLocalIterator():
        out[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(row["m"], np.uint8)
    return out


def windows(all_texts: DataFrame, counted: bool = False) -> DataFrame:
    """``WINDOWS``: the windows of ``LEAST`` words around anchors that stand in more than one record."""
    found = all_texts.select("text", "r").mapInPandas(_select, "h long, r long")
    again = found.groupBy("h").agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b").select("h")
    kept = all_texts.sparkSession.sparkContext.broadcast(_bits(again))
    return cut(all_texts.select("t", "fact", "id", "r", "text").mapInPandas(_around(kept, counted), WINDOWS))


def repeated(rows: DataFrame) -> DataFrame:
    """The rows of ``WINDOWS`` whose hash stands in more than one record, with ``both`` where facts and paths hold it."""
    counted = rows.groupBy("h").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count("*").alias("n"), (F.min("fact") != F.max("fact")).alias("both"))
    again = cut(counted.where("a <> b").select("h", "n", "both"))
    least = max(1000, int(rows.count() * HOT_SHARE))
    hot = F.broadcast(again.where(F.col("n") >= least).select("h", F.col("both").alias("hot_both")))
    marked = rows.join(hot, "h", "left")
    columns = ["t", "fact", "id", "r", "pos", "h", "both"]
    warm = marked.where("hot_both is not null").withColumn("both", F.col("hot_both")).select(*columns)
    cold = marked.where("hot_both is null").join(again.where(F.col("n") < least).select("h", "both"), "h").select(*columns)
    return warm.unionByName(cold)


def levels(rows: DataFrame) -> list[tuple[int, DataFrame]]:
    """(length, surviving windows) of every level from ``LEAST`` on, shortest first."""
    length, out = LEAST, []
    while True:
        alive = cut(repeated(rows))
        if alive.isEmpty():
            return out
        out.append((length, alive))
        after = alive.select("t", (F.col("pos") - length).alias("pos"), F.col("h").alias("h2")).distinct()
        rows = cut(alive.drop("both").join(after, ["t", "pos"]).withColumn("h", F.xxhash64("h", "h2")).drop("h2"))
        length *= 2


def pairs(cards: DataFrame, inputs: DataFrame) -> DataFrame:
    """card_id, input_id, shared_words: a lower bound of the longest run that the fact shares with one segment, in steps of the levels."""
    found = None
    for length, alive in levels(windows(texts(cards, inputs))):
        # A class are the texts with the same shared windows: a notice that a third of them hold makes few.
        one = alive.where("both").groupBy("fact", "id", "t").agg(F.array_sort(F.collect_set("h")).alias("hs"))
        members = cut(one.select("fact", "id", F.xxhash64("hs").alias("c"), "hs"))
        classes = members.groupBy("fact", "c").agg(F.first("hs").alias("hs")).select("fact", "c", F.explode("hs").alias("h"))
        met = classes.where("fact").select(F.col("c").alias("cf"), "h").join(classes.where("not fact").select(F.col("c").alias("cg"), "h"), "h").select("cf", "cg").distinct()
        left = members.where("fact").select(F.col("id").alias("card_id"), F.col("c").alias("cf")).distinct()
        right = members.where("not fact").select(F.col("id").alias("input_id"), F.col("c").alias("cg")).distinct()
        here = met.join(left, "cf").join(right, "cg").select("card_id", "input_id", F.lit(length).alias("shared_words"))
        found = here if found is None else found.unionByName(here)
    if found is None:
        return cards.sparkSession.createDataFrame([], "card_id long, input_id long, shared_words int")
    return found.groupBy("card_id", "input_id").agg(F.max("shared_words").alias("shared_words"))


def shares(cards: DataFrame, inputs: DataFrame) -> DataFrame:
    """record_kind, record, words, shared_words, share, longest: for each fact and generated path, the words that stand in a span of another record too.

    ``longest`` is a lower bound of the longest shared span, in steps of the levels.
    """
    every = texts(cards, inputs)
    rows = windows(every, counted=True)
    known = levels(rows.where("pos >= 0"))
    all_words = rows.where("pos < 0").groupBy("r", "t").agg(F.max("h").alias("words")).groupBy("r").agg(F.sum("words").alias("words"))
    all_words = all_words.join(every.select("r", "record").distinct(), "r")
    if known:
        by_text = Window.partitionBy("t").orderBy("pos")
        step = F.least(F.lit(LEAST), F.coalesce(F.lead("pos").over(by_text) - F.col("pos"), F.lit(LEAST)))
        covered = known[0][1].select("t", "r", "pos").distinct().withColumn("step", step).groupBy("r").agg(F.sum("step").alias("shared_words"))
        longest = None
        for length, alive in known:
            here = alive.select("r").distinct().withColumn("longest", F.lit(length))
            longest = here if longest is None else longest.unionByName(here)
        covered = covered.join(longest.groupBy("r").agg(F.max("longest").alias("longest")), "r")
        out = all_words.join(covered, "r", "left").fillna({"shared_words": 0, "longest": 0})
    else:
        out = all_words.withColumn("shared_words", F.lit(0).cast("long")).withColumn("longest", F.lit(0))
    kind = F.when(F.col("record").startswith("f:"), "fact").otherwise("generated_path")
    return out.select(kind.alias("record_kind"), F.expr("substring(record, 3)").alias("record"), "words", "shared_words", F.when(F.col("words") > 0, F.col("shared_words") / F.col("words")).otherwise(0.0).alias("share"), "longest")
