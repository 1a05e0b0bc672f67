"""Word segmentation of text that lost its blanks, command repair accuracy, matching of facts with ground truth."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import cut, most_frequent, salted_join

LONGEST = 32
#: Words of the vocabulary that are broadcast, most often met first; bounds what every task holds. The rest is joined.
VOCABULARY = 100_000
#: Bits of the filter that spares the join most runs that are no word: 2 ** BITS at most. It never turns a word away.
BITS = 28
#: Lengths at which the filter also has the beginnings of words, so that most runs are followed no further.
BEGUN = (4, 6, 8, 11)
#: Letters that are as frequent as each other, for an estimate of how often a word is met by chance.
SPREAD = 16
_RUNS = r"[^\W\d_]+|\d+"
#: Runs that are cut side by side, and the letters of each that are looked at in one step; bound what a task holds.
ABREAST = 256
STRIDE = 256
#: Letters that are cut before their words are given out.
LETTERS = 1 << 21

class _Words:
    """Words with their logs as a trie in one hash table: the state after a letter is the place of the edge that led to it."""

    def __init__(self, words: list[str], logs: list[float]):
        lengths = np.array([len(w) for w in words], np.int64)
        codes, starts = _codes("".join(words)), np.cumsum(lengths) - lengths
        self.bits = max(10, (2 * int(lengths.sum())).bit_length())
        self.edges, self.logs = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, np.nan)
        states, all_logs = np.full(len(words), 1 << self.bits, np.uint64), np.array(logs, float)
        for n in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero(lengths >= n)
            keys, of = np.unique(states[on] << np.uint64(21) | codes[starts[on] + n - 1], return_inverse=True)
            places, left = self._place(keys), np.arange(len(keys))
            while len(left):
                at = places[left]
                free = self.edges[at] == 0
                self.edges[at[free]] = keys[left[free]]
                left = left[self.edges[at] != keys[left]]
                places[left] = (places[left] + 1) & ((1 << self.bits) - 1)
            states[on] = places[of]
            ends = lengths[on] == n
            self.logs[places[of[ends]]] = all_logs[on[ends]]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def matches(self, codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the places ``at`` from which a word of that length is read, and its log. LONGEST zeros follow the codes."""
        states = np.full(len(at), 1 << self.bits, np.uint64)
        for n in range(1, LONGEST + 1):
            keys = states << np.uint64(21) | codes[at + (n - 1)]
            places = self._place(keys)
            seen = self.edges[places]
            hit = seen == keys
            on = np.flatnonzero(~hit & (seen != 0))
            while len(on):
                places[on] = (places[on] + 1) & ((1 << self.bits) - 1)
                seen = self.edges[places[on]]
                hit[on] = seen == keys[on]
                on = on[~hit[on] & (seen != 0)]
            at, places = at[hit], places[hit]
            if not len(at):
                return
            logs = self.logs[places]
            word = ~np.isnan(logs)
            yield n, at[word], logs[word]
            states = places.astype(np.uint64)


def _abreast(runs: list[str], words: _Words, unknown: float, rare: list[dict[str, float]]) -> Iterator[bytes]:
    """For each of at most ABREAST runs, longest first: the length of the last word of every prefix."""
    lengths = np.array([len(r) for r in runs], np.int64)
    codes, starts = np.concatenate([_codes("".join(runs)), np.zeros(1, np.uint64)]), np.cumsum(lengths) - lengths
    foreign = np.array([unknown - 2.3 * n for n in range(LONGEST, 0, -1)])
    extra = [(i, at, len(w), log) for i, (r, own) in enumerate(zip(runs, rare, strict=True)) for w, log in own.items() for at in _found(r, w)]
    e_run, e_at, e_n = (np.array([x[k] for x in extra], np.int64) for k in range(3))
    e_log, e_end = np.array([x[3] for x in extra], float), e_at + e_n - 1
    longest = int(lengths[0]) if len(lengths) else 0
    last = np.zeros((len(runs), longest), np.uint8)
    best = np.full((len(runs), LONGEST + STRIDE), -np.inf)
    best[:, LONGEST - 1] = 0.0
    rows = np.arange(len(runs))
    for b in range(0, longest, STRIDE):
        on = int((lengths > b).sum())
        width = min(STRIDE, longest - b)
        # The letters from which a word may end in this stride, before and after them zeros that are in no word.
        places = np.arange(b - LONGEST + 1, b + width + LONGEST)
        inside = (places >= 0) & (places < np.minimum(lengths[:on], b + width)[:, None])
        here = np.where(inside, codes[np.where(inside, starts[:on, None] + places, len(codes) - 1)], np.uint64(0))
        logs = np.empty((width, on, LONGEST))
        logs[:] = foreign
        flat = logs.reshape(-1)
        for n, at, found in words.matches(here.reshape(-1), np.flatnonzero(here.reshape(-1))):
            run, end = at // len(places), at % len(places) + n - LONGEST
            in_ = end >= 0
            flat[(end[in_] * on + run[in_]) * LONGEST + LONGEST - n] = found[in_]
        if len(extra):
            x = (e_end >= b) & (e_end < b + width)
            logs[e_end[x] - b, e_run[x], LONGEST - e_n[x]] = e_log[x]
        active = len(runs) - np.searchsorted(lengths[::-1], np.arange(b, b + width), side="right")
        for i, k in enumerate(active.tolist()):
            s = best[:k, i : i + LONGEST] + logs[i, :k]
            top = s.argmax(axis=1)
            last[:k, b + i] = LONGEST - top
            best[:k, i + LONGEST] = s[rows[:k], top]
        best[:, :LONGEST] = best[:, width : width + LONGEST].copy()
    for i, n in enumerate(lengths.tolist()):
        yield last[i, :n].tobytes()


def _found(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def _cuts(runs: list[str], words: _Words, unknown: float, rare: list[dict[str, float]] | None = None) -> list[list[str]]:
    """The most likely words of each run of letters: a Viterbi pass over cuts of at most LONGEST characters.

    Of equally likely cuts the one with the longest last word is taken. ``rare`` has by run the words that ``words`` has not.
    """
    rare = rare or [{}] * len(runs)
    out: list[list[str]] = [[]] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
    for b in range(0, len(order), ABREAST):
        some = order[b : b + ABREAST]
        for i, last in zip(some, _abreast([runs[i] for i in some], words, unknown, [rare[i] for i in some]), strict=True):
            text, end, found = runs[i], len(runs[i]), []
            while end:
                n = last[end - 1]
                found.append(text[end - n : end])
                end -= n
            out[i] = found[::-1]
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _places(h: np.ndarray, bits: int, begun: bool = False) -> list[np.ndarray]:
    """The filter places of runs with these hashes: three of a whole word, or two of a word's beginning."""
    mixed = (h ^ (h >> np.uint64(31)) ^ np.uint64(0x5851F42D4C957F2D if begun else 0)) * np.uint64(0xBF58476D1CE4E5B9)
    factors = (0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)[: 2 if begun else 3]
    return [((mixed ^ (mixed >> np.uint64(29))) * np.uint64(f)) >> np.uint64(64 - bits) for f in factors]


def _hashes(codes: np.ndarray, at: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n characters from ``at``, of those of the runs that are one shorter."""
    return h * np.uint64(0x9E3779B97F4A7C15) + codes[at + (n - 1)]


def _filter(words: DataFrame, bits: int) -> np.ndarray:
    """Bit set of the places of every word and its beginnings; 2 ** bits bits reach the driver, whatever the number of words."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lengths = b["word"].str.len().to_numpy(np.int64)
            codes, at = _codes("".join(b["word"])), np.cumsum(lengths) - lengths
            h, out = np.zeros(len(at), np.uint64), []
            for n in range(1, LONGEST + 1):
                on = lengths >= n
                at, h, lengths = at[on], h[on], lengths[on]
                h = _hashes(codes, at, h, n)
                out += _places(h[lengths == n], bits) + (_places(np.unique(h[lengths > n]), bits, True) if n in BEGUN else [])
            yield pd.DataFrame({"place": np.concatenate(out).astype(np.int64) + 1})

    place = F.col("place")
    out = np.zeros(1 << (bits - 3), np.uint8)
    maps = words.select("word").mapInPandas(places, "place long").groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    for r in maps.toLocalIterator():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def _met(texts: list[str], held: np.ndarray, bits: int, lengths: set[int]) -> Iterator[tuple[int, str]]:
    """Index of a text and a run of one of the ``lengths`` in it that passes the filter."""
    joined = " ".join(texts)
    codes = np.concatenate([_codes(joined), np.zeros(LONGEST, np.uint64)])
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = np.flatnonzero(codes > 32)
    h = np.zeros(len(at), np.uint64)

    def passed(h: np.ndarray, begun: bool) -> np.ndarray:
        on = np.arange(len(h))
        for p in _places(h, bits, begun):
            p = p[on]
            on = on[(held[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return on

    for n in range(1, max(lengths) + 1):
        within = codes[at + (n - 1)] > 32
        at, h = at[within], h[within]
        h = _hashes(codes, at, h, n)
        if n in lengths:
            found = at[passed(h, False)]
            of = np.searchsorted(starts, found, side="right") - 1
            yield from {(i, joined[x : x + n]) for i, x in zip(of.tolist(), found.tolist(), strict=True)}
        if n in BEGUN:
            on = passed(h, True)
            at, h = at[on], h[on]


def _portions(texts: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """Where a portion of about LETTERS letters begins, and the runs of its texts."""
    import re

    began, parts, letters = 0, [], 0
    for i, t in enumerate(texts, 1):
        parts.append(re.findall(_RUNS, (t or "").lower()))
        letters += sum(map(len, parts[-1]))
        if letters >= LETTERS or i == len(texts):
            yield began, parts
            began, parts, letters = i, [], 0


def _with_rare(rows: DataFrame, rare: DataFrame) -> DataFrame:
    """k, t, rare: the words of ``rare`` (word, n) that occur anywhere in the text, with their counts.

    Texts are matched by hash: one that shares the hash of another has the other's words too, which changes nothing.
    """
    sizes = {r["length"]: r["count"] for r in rare.groupBy(F.length("word").alias("length")).count().collect()}
    bits, lengths = min(max((1024 * sum(sizes.values())).bit_length(), 18), BITS), set(sizes)
    held = rows.sparkSession.sparkContext.broadcast(_filter(rare, bits))

    def occur(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for began, parts in _portions(list(b["t"])):
                met = list(_met([" ".join(p) for p in parts], held.value, bits, lengths))
                if met:
                    yield pd.DataFrame({"h": b["h"].to_numpy()[[began + i for i, _ in met]], "word": [w for _, w in met]})

    rows = rows.withColumn("h", F.xxhash64("t"))
    met = cut(rows.select("h", "t").mapInPandas(occur, "h long, word string").distinct())
    known = salted_join(met, rare, "word", "h").where(F.col("n").isNotNull()).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("rare"))
    return salted_join(rows, known, "h", "k").select("k", "t", "rare")


def segmented(texts: DataFrame, counts: DataFrame, key: str, text: str) -> DataFrame:
    """key, words: runs of letters cut into likely words; ``counts`` has word and n, one row a word. Null and empty texts give none.

    Every word of ``counts`` counts: those that texts hold most often, as words or within others, are broadcast, the
    others joined to the texts that hold them. ``key`` is handed through whatever its type.
    """
    known = cut(counts.where(F.col("word").rlike(r"^\p{L}+$") & (F.col("n") > 0)).select("word", "n"))
    total, letters = known.agg(F.sum("n"), F.sum(F.col("n") * F.length("word"))).first()
    total = total or 1
    # A short word, however rare, is met within and across other words all over: as if of SPREAD letters each was as frequent.
    known = known.where(F.length("word") <= LONGEST).withColumn("runs", F.col("n") + F.lit(float(letters or 0)) / F.pow(F.lit(SPREAD), F.length("word")))
    top = most_frequent(known, "runs", VOCABULARY)
    held = texts.sparkSession.sparkContext.broadcast(_Words([r["word"] for r in top], [math.log(r["n"] / total) for r in top]))
    rest = known.where(F.col("runs") < min(r["runs"] for r in top)) if top else known
    rest = rest.select("word", "n")
    rows = texts.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = _with_rare(rows, rest) if len(rest.take(1)) else rows.withColumn("rare", F.lit(None).cast("map<string,bigint>"))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rare = [{w: math.log(n / total) for w, n in r} if r else {} for r in b.column("rare").to_pylist()]
            for began, parts in _portions(b.column("t").to_pylist()):
                found = iter(_cuts([r for p in parts for r in p], held.value, -math.log(total), [rare[began + i] for i, p in enumerate(parts) for _ in p]))
                words = pa.array([[w for _ in p for w in next(found)] for p in parts], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([b.column("k").slice(began, len(parts)), words], ["k", "words"])

    return rows.mapInArrow(run, f"k {kind}, words array<string>").withColumnRenamed("k", key)


def accuracy(rows: DataFrame, got: str, wanted: str) -> DataFrame:
    """One row: lines, exact, and the shares of lines and of places at which the words agree."""
    places = F.greatest(F.size(got), F.size(wanted))
    same = F.size(F.filter(F.arrays_zip(F.col(got).alias("g"), F.col(wanted).alias("w")), lambda z: z["g"] == z["w"]))
    return rows.agg(F.count("*").alias("lines"), F.sum((F.col(got) == F.col(wanted)).cast("int")).alias("exact"), (F.sum(same) / F.sum(places)).alias("place_accuracy"))


def greedy_matches(found: DataFrame, truth: DataFrame) -> DataFrame:
    """region, truth_id, found_id: one-to-one matches of facts of one category that share min(2, n) words or more.

    Candidates come from a join on (region, category, word); the greedy choice, most shared words first, then
    lowest ids, is sequential within a region and runs there.
    """
    from quern.functions.text import words

    def exploded(df: DataFrame, name: str) -> DataFrame:
        w = F.array_distinct(words(F.col("value")))
        return df.select("region", "category", F.col("id").alias(name), F.size(w).alias(f"{name}_n"), F.explode(w).alias("w"))

    shared = exploded(truth, "truth_id").join(exploded(found, "found_id"), ["region", "category", "w"]).groupBy("region", "truth_id", "found_id").agg(F.count("*").alias("shared"), F.first("truth_id_n").alias("n"))
    pairs = shared.where(F.col("shared") >= F.least(F.lit(2), F.col("n")))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, out = set(), set(), []
        for r in rows.sort_values(["shared", "truth_id", "found_id"], ascending=[False, True, True]).itertuples():
            if r.truth_id not in a and r.found_id not in b:
                a.add(r.truth_id)
                b.add(r.found_id)
                out.append((r.region, r.truth_id, r.found_id))
        return pd.DataFrame(out, columns=["region", "truth_id", "found_id"])

    return pairs.groupBy("region").applyInPandas(choose, "region string, truth_id long, found_id long")


def recall_precision(matches: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """region, recall, precision; null where a side is empty."""
    t = truth.groupBy("region").agg(F.count("*").alias("t"))
    g = found.groupBy("region").agg(F.count("*").alias("g"))
    m = matches.groupBy("region").agg(F.count("*").alias("m"))
    j = t.join(g, "region", "full").join(m, "region", "left").fillna({"m": 0})
    return j.select("region", (F.col("m") / F.nullif("t", F.lit(0))).alias("recall"), (F.col("m") / F.nullif("g", F.lit(0))).alias("precision"))
