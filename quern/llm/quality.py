"""Text statistics of documents, and their text type from noisy thresholds.

A first pass counts in how many documents each word stands; the most frequent ones are the common words. A
second computes the statistics of every document. Thresholds on them are labelling functions that vote for a
type or abstain; how far each can be trusted is learned by expectation-maximization on their agreements. The
EM needs only the counts of distinct vote patterns, which the corpus is grouped to, so its cost does not
grow with the corpus.

Defined results: null or blank texts have zero statistics, no votes and the type ``empty``; a null doc_id is
kept as it is by ``statistics`` and gives no row in ``not_prose``; repeated rows give one row there.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import words
from quern.runtime import cut, most_frequent

#: Number of the corpus's words, by documents they stand in, that are common; bounds what every task holds.
COMMON_WORDS = 3000
TYPES = ("prose", "list", "table", "junk", "residue")
EM_ROUNDS = 25
WRAP = 80
#: A text with a sign of residue for so many words is taken for residue by one of the functions.
WORDS_A_SIGN = 25
#: So many short lines without bullets can be a list; fewer are a title and what follows it.
UNMARKED = 5
#: Words kept per Python worker; the cache is emptied when it is full.
CACHE_WORDS = 400_000
#: Bits of one of the counts that are summed together.
PACK = 40

# First words of command lines, as in the stored structured_ratio.
COMMANDS = frozenset({"set", "show", "delete", "edit", "commit", "request", "clear"})

STATS = (
    "doc_id long, word_count long, mean_word_length double, space_ratio double, symbol_ratio double, repeated_line_ratio double, structured_ratio double, "
    "end_punctuation_share double, common_word_share double, text_chars long, line_count long, votes array<byte>"
)
_ENTRY = re.compile(r"(?:[-*+•·◦▪‣–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxl]{1,5}[.)])\s+(?:\[[ xX]\]\s+)?\S")
_GAP = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
_RULE = re.compile(r"[\s|:+=-]+$")
_SENTENCE = re.compile(r"[a-zß-ÿ]{2,}[,;]? [a-zß-ÿ]{2,}[,;]? [a-zß-ÿ]{2,}")
_HEX = "0123456789abcdef"
_SLOT = re.compile(r"\{\{|\$\{|\[\[|<<\w|%%\w|@@\w|\b__[A-Z]|\{%|#\{|<TBD|\[your |\[INSERT|to be supplied|xxx-|TODO:")
_NOTICE = re.compile(r"(?i)java\s?script|scripts?\b|scripting|browser|cookies|\b[45]\d\d\b|not found|unavailable|forbidden|traceback|try again|home \||request id|server|permission")


def _cells(s: str) -> int:
    """Number of cells that a line has if it is a table row, else 0 or 1."""
    if s.startswith("|") or s.count("|") >= 2:
        return max(2, s.strip("|").count("|") + 1)
    gaps = len(_GAP.findall(s))
    if gaps:
        return gaps + 1
    for sign in (",", ";", "|", ":"):
        n = s.count(sign)
        if n >= 2 and s.count(sign + " ") * 2 < n and len(s) <= 40 * (n + 1):
            return n + 1
    return 1


def line_kinds(lines: list[str]) -> tuple[dict[str, float], Counter]:
    """Weight of each kind of line, a long line counting as the rows it would fill, and cell counts of rows."""
    out = {"entry": 0.0, "short": 0.0, "row": 0.0, "prose": 0.0, "code": 0.0, "heading": 0.0}
    cells: Counter[int] = Counter()
    fence = False
    for s in lines:
        if s[:3] in ("```", "~~~"):
            fence = not fence
            continue
        if fence:
            out["code"] += 1
            continue
        weight = 1 + len(s) // WRAP
        if s[0] == "#" and s[:7].lstrip("#")[:1] == " ":
            out["heading"] += 1
            continue
        if _ENTRY.match(s) and len(s) < 160:
            out["entry"] += 1
            continue
        n = _cells(s) if not _SENTENCE.search(s) or "|" in s or "  " in s or "\t" in s else 1
        if n >= 2:
            out["row"] += 1
            cells[n] += 1
        elif _RULE.match(s):
            out["row"] += 0.0
        elif len(s) <= 45 and s[-1] not in ".!?:;,-" and s.count(" ") <= 6:
            out["short"] += 1
        else:
            out["prose"] += weight
    return out, cells


class _Words(dict):
    """What a word counts for, packed into one number so that a text takes one sum: common, readable, with a digit, two hex digits."""

    def __init__(self, common: frozenset[str]) -> None:
        super().__init__()
        self.common = common

    def __missing__(self, w: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        readable = len(w) <= 18 and (w[0].isdigit() or not w.isascii() and len(w) > 2 or any(c in "aeiouy" for c in w))
        dump = len(w) == 2 and w[0] in _HEX and w[1] in _HEX
        value = self[w] = (w in self.common) | readable << PACK | any(c.isdigit() for c in w) << 2 * PACK | dump << 3 * PACK
        return value

    def counts(self, tokens: list[str]) -> tuple[int, int, int, int]:
        total, mask = sum(map(self.__getitem__, tokens)), (1 << PACK) - 1
        return total & mask, total >> PACK & mask, total >> 2 * PACK & mask, total >> 3 * PACK


def _surely(share: float, n: int) -> float:
    """Lower end of the interval in which a share seen in n words lies: few words say less, whatever their share."""
    return (share + 2 / n - 2 * math.sqrt(share * (1 - share) / n + 1 / n**2)) / (1 + 4 / n) if n else 0.0


def _votes(text: str, lines: list[str], tokens: list[str], stat: dict[str, float], counts: tuple[int, int, int, int]) -> list[int]:
    """One vote per labelling function: a type's number, or -1 where it abstains.

    Several lines are two or more, of lines without any mark ``UNMARKED`` or more; no function asks for a least
    length beyond that, and shares of words are judged by what their number can say.
    """
    kinds, cells = line_kinds(lines)
    whole = sum(kinds.values()) or 1.0
    entry, short, row, prose = (kinds[k] / whole for k in ("entry", "short", "row", "prose"))
    n = len(lines)
    distinct = len(set(lines)) / n
    common, readable, digits = (c / max(len(tokens), 1) for c in counts[:3])
    most = cells.most_common(1)[0][1] / max(sum(cells.values()), 1) if cells else 0.0
    per_line = len(tokens) / n
    dump = counts[3] > 0.5 * len(tokens) and _surely(counts[3] / len(tokens), len(tokens)) > 0.4
    if stat["symbol_ratio"] > 0.5 or dump:  # signs and bytes part no cells
        row = most = 0.0
    vote = [-1] * 16
    if entry + short > 0.5 and distinct > 0.4 and (entry > 0.5 and n >= 2 or n >= UNMARKED):
        vote[0] = 1
    elif entry + short < 0.4:
        vote[0] = 0 if prose > 0.5 else -1
    if entry > 0.5 and n >= 2:
        vote[1] = 1
    if short > 0.6 and n >= UNMARKED and distinct > 0.5 and common > 0.45:
        vote[2] = 1
    if row > 0.5 and n >= 2:
        vote[3] = 2
    elif row < 0.4:
        vote[3] = 0 if prose > 0.5 else -1
    if row > 0.4 and most > 0.6 and n >= 2:
        vote[4] = 2
    if row > 0.4 and digits > 0.3 and common < 0.8:
        vote[5] = 2
    vote[6] = 3 if common < 0.3 and row < 0.5 and _surely(1 - common, len(tokens)) > 0.5 else 0 if common > 0.75 and prose > 0.5 else -1
    vote[7] = 3 if stat["symbol_ratio"] > 0.4 and row < 0.3 or stat["symbol_ratio"] > 0.55 else -1
    vote[8] = 3 if distinct < 0.34 else -1
    vote[9] = 3 if tokens and (stat["mean_word_length"] > 14 or stat["mean_word_length"] < 2.2 or len(text) / max(text.count(" ") + text.count("\n") + 1, 1) > 25) else -1
    vote[10] = 3 if readable < 0.55 and _surely(1 - readable, len(tokens)) > 0.3 else 0 if readable > 0.9 and prose > 0.5 else -1
    vote[11] = 0 if per_line > 7 and prose > 0.6 and common > 0.6 else -1
    ends = sum(text.count(x) for x in (". ", ".\n", "? ", "! ")) + text.endswith((".", "!", "?"))
    vote[12] = 0 if prose > 0.5 and ends * 40 >= len(tokens) and common > 0.5 else -1
    slots = len(_SLOT.findall(text))
    if (slots + len(_NOTICE.findall(text))) * WORDS_A_SIGN >= len(tokens) or slots > 2 and common > 0.4:
        vote[13] = 4
    vote[14] = 3 if stat["repeated_line_ratio"] > 0.5 and row < 0.5 else -1
    vote[15] = 3 if dump or not tokens else -1
    return vote


def _one(doc_id: int | None, text: str | None, known: _Words) -> tuple:
    lines = [s for x in (text or "").splitlines() if (s := x.strip())]
    if not lines:
        return (doc_id, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0, [])
    tokens = words(text)
    alnum = sum(map(len, tokens))
    letters = alnum - sum(text.count(d) for d in "0123456789")
    solid = sum(map(len, text.split()))
    long = [s for s in lines if len(s) >= 8]
    seen = Counter(long)
    counts = known.counts(tokens)
    repeated = sum(n for n in seen.values() if n > 2) / len(long) if long else 0.0
    stat = {"mean_word_length": alnum / len(tokens) if tokens else 0.0, "symbol_ratio": max(solid - alnum, 0) / solid, "repeated_line_ratio": repeated}
    structured = sum(1 for s in lines if s[0] == "|" or s.split(None, 1)[0].lower().strip("`|") in COMMANDS or "  " in s or "\t" in s)
    return (
        doc_id, len(tokens), stat["mean_word_length"], text.count(" ") / letters if letters > 0 else 0.0, stat["symbol_ratio"],
        repeated, structured / len(lines),
        sum(s[-1] in ".!?…" for s in lines) / len(lines), counts[0] / len(tokens) if tokens else 0.0, solid, len(lines), _votes(text, lines, tokens, stat, counts),
    )


def common_words(documents: DataFrame, size: int = COMMON_WORDS) -> frozenset[str]:
    """The words that stand in most documents, at most ``size``, if they stand in 3 of them and in one of a
    thousand. Counts are over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                held.update(set(words(t)))
            held[""] += len(b)
            if len(held) > 1_000_000:
                yield pd.DataFrame(held.items(), columns=["word", "n"])
                held.clear()
        yield pd.DataFrame(held.items(), columns=["word", "n"])

    counted = documents.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "word string, n long")
    counted = cut(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n >= 3"))
    rows = counted.where("word = ''").agg(F.max("n")).first()[0] or 0
    return frozenset(r["word"] for r in most_frequent(counted.where((F.col("word") != "") & (F.col("n") >= rows // 1000)), "n", size))


def statistics(documents: DataFrame) -> DataFrame:
    """Statistics of every document, in the columns of ``STATS``."""
    held = documents.sparkSession.sparkContext.broadcast(common_words(documents))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words(held.value)
        for b in batches:
            out = [_one(None if i != i else i, t, known) for i, t in zip(b["doc_id"], b["text"], strict=True)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATS.split(", ")]).astype({"doc_id": "Int64"})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(measure, STATS)


def learn(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Posterior of each type for each vote pattern, by EM over the labelling functions' vote laws."""
    n, k = patterns.shape
    t = len(TYPES)
    posterior = np.zeros((n, t))
    for row, votes in enumerate(patterns):  # the start: the majority of the votes
        cast = votes[votes >= 0]
        posterior[row] = np.bincount(cast, minlength=t) if len(cast) else np.eye(t)[0]
        special = posterior[row, 1:].argmax() + 1
        if posterior[row, special] >= 2 or (posterior[row, special] and not posterior[row, 0]):
            posterior[row, 0] *= 0.5
    posterior /= posterior.sum(axis=1, keepdims=True)
    onehot = np.stack([(patterns == v) for v in range(-1, t)], axis=2)  # pattern, function, vote
    # A type other than prose needs a function that votes for it; silence alone is no evidence.
    unclaimed = ~np.stack([np.ones(n, bool), *((patterns == v).any(axis=1) for v in range(1, t))], axis=1)
    for _ in range(EM_ROUNDS):
        mass = posterior * counts[:, None]
        prior = (mass.sum(axis=0) + 1) / (counts.sum() + t)
        # How often each function casts each vote in each type; a function leans to vote for its own type.
        law = np.einsum("pt,pfv->tfv", mass, onehot) + 0.02
        for v in range(t):
            law[v, :, v + 1] += 1.0
        law /= law.sum(axis=2, keepdims=True)
        logs = np.log(prior)[None, :] + np.einsum("pfv,tfv->pt", onehot, np.log(law))
        logs[unclaimed] = -np.inf
        posterior = np.exp(logs - logs.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
    return posterior


def text_types(documents: DataFrame) -> DataFrame:
    """The statistics with ``text_class`` and its ``posterior``."""
    stats = cut(statistics(documents))
    # Bounded: four of the 16 functions cast three votes and the others two, so at most 3^4 * 2^12 = 331,776 patterns reach the driver.
    patterns = stats.where(F.size("votes") > 0).groupBy("votes").count().orderBy(F.desc("count")).toPandas()
    if not len(patterns):
        return stats.drop("votes").withColumn("text_class", F.lit("empty")).withColumn("posterior", F.lit(1.0))
    posterior = learn(np.stack(patterns["votes"].to_numpy()).astype(int), patterns["count"].to_numpy(dtype=float))
    table = {bytes(int(v) + 1 for v in votes): (TYPES[int(p.argmax())], float(p.max())) for votes, p in zip(patterns["votes"], posterior, strict=True)}
    held = documents.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("text_class string, posterior double")
    def decide(votes: pd.Series) -> pd.DataFrame:
        found = [held.value.get(bytes(int(x) + 1 for x in v), ("empty", 1.0)) for v in votes]
        return pd.DataFrame(found, columns=["text_class", "posterior"])

    return stats.withColumn("c", decide("votes")).select(*[c for c in stats.columns if c != "votes"], "c.text_class", "c.posterior")


def not_prose(documents: DataFrame) -> DataFrame:
    """doc_id, text_class of the documents that are a list, a table or junk."""
    return text_types(documents).where(F.col("text_class").isin("list", "table", "junk") & F.col("doc_id").isNotNull()).select("doc_id", "text_class").distinct()
