"""Evaluation passages inside training text, found by spaced seeds.

A seed reads 13 words through a fixed mask that ignores some positions. The ignored positions of the masks
together cover all 13, so a window in which any one word was substituted still meets some mask. Hashes of
the evaluation side (bounded, size-checked) are looked up while the corpus streams past, or joined by hash
where they exceed the bound; each hit names a diagonal, along which the words themselves are compared.

Defined results: null or empty texts and passages match nothing; passages under 13 words cannot leak;
repeated rows of a document or item give one row; a passage that stands in two items leaks for both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import chunks, hashes, window_hashes, words
from quern.runtime import cut

SPAN = 13
#: Bits of the filter that corpus seeds pass before they are shuffled.
FILTER_BITS = 27
# The positions that each mask reads.
MASKS = (
    (0, 1, 2, 3, 6, 7, 10, 11, 12),
    (3, 4, 5, 7, 8, 9, 11, 12),
    (0, 1, 2, 4, 5, 6, 8, 9, 10),
)
#: Evaluation windows that may be held in every worker; beyond it hits come from a shuffle join by hash.
HELD_WINDOWS = 2_000_000
OVERLAP = "doc_id long, item_id long, run int, matched int, substituted int"


class Seeds:
    """The evaluation side as sorted arrays."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.words = [words(p) for _, p in items]
        self.hashes = [hashes(w) for w in self.words]
        self.tables = []
        for mask in MASKS:
            h = [window_hashes(x, SPAN, mask) for x in self.hashes]
            item = np.concatenate([np.full(len(x), k, dtype=np.int32) for k, x in enumerate(h)] or [np.zeros(0, np.int32)])
            at = np.concatenate([np.arange(len(x), dtype=np.int32) for x in h] or [np.zeros(0, np.int32)])
            value = np.concatenate(h or [np.zeros(0, np.uint64)])
            order = np.argsort(value, kind="stable")
            table = np.zeros(1 << 20, dtype=bool)
            table[(value >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((value[order], item[order], at[order], table))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``h``, item numbers and positions in the passages."""
        out = []
        for mask, (value, item, at, table) in zip(MASKS, self.tables, strict=True):
            w = window_hashes(h, SPAN, mask)
            near = np.flatnonzero(table[(w >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(value, w[near], "left"), np.searchsorted(value, w[near], "right")
            n = hi - lo
            k = np.repeat(np.arange(len(near)), n)
            where = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + lo[k]
            out.append((near[k], item[where], at[where]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def overlap(doc: list[str], passage: list[str], shift: int) -> tuple[int, int, int]:
    """Longest exact run, and matched and substituted words of the best stretch, where doc[i + shift] meets passage[i]."""
    start = max(0, -shift)
    same = [doc[i + shift] == passage[i] for i in range(start, min(len(passage), len(doc) - shift))]
    run = best = score = top = matched = wrong = 0
    stretch = (0, 0)
    for ok in same:
        run = run + 1 if ok else 0
        best = max(best, run)
        if score <= 0:
            score = matched = wrong = 0
        score += 1 if ok else -3
        matched += ok
        wrong += not ok
        if score > top:
            top, stretch = score, (matched, wrong)
    return best, *stretch


def _best(doc: list[str], seeds: Seeds, pairs: set[tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
    out: dict[int, tuple[int, int, int]] = {}
    for item, shift in pairs:
        found = overlap(doc, seeds.words[item], shift)
        if found > out.get(item, (0, 0, 0)):
            out[item] = found
    return out


def _scan(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds: Seeds = held.value
        for b in batches:
            texts, ids, out = b["text"].tolist(), b["doc_id"].tolist(), []
            for lo, hi in chunks(texts):
                docs = [words(t) for t in texts[lo:hi]]
                ends = np.cumsum([len(d) for d in docs])
                h = hashes([w for d in docs for w in d])
                at, item, pos = seeds.hits(h)
                doc = np.searchsorted(ends, at, "right")
                inside = at + SPAN <= ends[doc] if len(at) else np.zeros(0, bool)
                found: dict[int, set[tuple[int, int]]] = {}
                for d, i, a, p in zip(doc[inside].tolist(), item[inside].tolist(), at[inside].tolist(), pos[inside].tolist(), strict=True):
                    found.setdefault(d, set()).add((i, a - int(ends[d] - len(docs[d])) - p))
                for d, pairs in found.items():
                    out += [(ids[lo + d], seeds.ids[i], *v) for i, v in _best(docs[d], seeds, pairs).items()]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "run", "matched", "substituted"])

    return run


def _windows(name: str, held=None):
    """Seeds of the texts of a chunk; with a filter only those that may be a seed of the other side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b[name].to_numpy(), b["text"].tolist()
            for lo, hi in chunks(texts):
                docs = [words(t) for t in texts[lo:hi]]
                sizes = np.array([len(d) for d in docs])
                ends = np.cumsum(sizes)
                flat = hashes([w for d in docs for w in d])
                for m, mask in enumerate(MASKS):
                    w = window_hashes(flat, SPAN, mask)
                    at = np.arange(len(w))
                    doc = np.searchsorted(ends, at, "right")
                    keep = at + SPAN <= ends[doc] if len(at) else np.zeros(0, bool)
                    if held is not None:
                        place = (w[keep] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                        keep[keep] = (held.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    at, doc = at[keep], doc[keep]
                    yield pd.DataFrame({name: ids[lo:hi][doc], "mask": m, "h": w[keep].view(np.int64), "at": (at - (ends - sizes)[doc]).astype(np.int32)})

    return run


def _filter(seeds: DataFrame) -> np.ndarray:
    """Bit set of the leading bits of every seed's hash: 2 ** FILTER_BITS bits on the driver, whatever the number of seeds."""
    place = F.shiftrightunsigned("h", 64 - FILTER_BITS) + 1
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    maps = seeds.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    for r in maps.toLocalIterator():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for d, i, text, passage, shifts in zip(b["doc_id"], b["item_id"], b["text"], b["passage"], b["shifts"], strict=True):
            doc, item = words(text), words(passage)
            out.append((d, i, *max(overlap(doc, item, int(s)) for s in shifts)))
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "run", "matched", "substituted"])


def overlaps(documents: DataFrame, items: DataFrame, held_windows: int = HELD_WINDOWS) -> DataFrame:
    """doc_id, item_id, run, matched, substituted for every document and item that share a seed."""
    spark = documents.sparkSession
    corpus = documents.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    tests = items.select(F.col("item_id").cast("long"), F.col("passage").alias("text")).where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    letters = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    if letters <= 2 * held_windows:  # a word and what parts it from the next are two characters at least
        held = spark.sparkContext.broadcast(Seeds([(r[0], r[1]) for r in tests.orderBy("item_id").collect()]))
        rows = corpus.mapInPandas(_scan(held), OVERLAP)
    else:
        right = cut(tests.mapInPandas(_windows("item_id"), "item_id long, mask int, h long, at int").withColumnRenamed("at", "pos"))
        left = corpus.mapInPandas(_windows("doc_id", spark.sparkContext.broadcast(_filter(right))), "doc_id long, mask int, h long, at int")
        pairs = left.join(right, ["mask", "h"]).groupBy("doc_id", "item_id").agg(F.collect_set(F.col("at") - F.col("pos")).alias("shifts"))
        both = pairs.join(corpus, "doc_id").join(tests.withColumnRenamed("text", "passage"), "item_id")
        rows = both.select("doc_id", "item_id", "text", "passage", "shifts").mapInPandas(_compare, OVERLAP)
    best = F.max(F.struct("run", "matched", "substituted"))
    return rows.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.run", "b.matched", "b.substituted").where("matched > 0")


def leaks(documents: DataFrame, items: DataFrame, run: int = SPAN) -> DataFrame:
    """doc_id, item_id where the text holds at least ``run`` consecutive words of the passage."""
    return overlaps(documents, items).where(F.col("run") >= run).select("doc_id", "item_id")
