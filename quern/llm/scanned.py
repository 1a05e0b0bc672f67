"""Noise in text from scanned pages: find it, and repair segments into readable paragraphs.

One Arrow pass takes every segment apart into rows: running words, words cut at a line end, and lines
that look like page furniture. Words are counted by the packets they stand in. Misread words get their
candidates from a join of padded character trigrams (keyed also by length, so one posting list holds only
words that could match), and a boosted ranker fitted on synthetic misreadings decides. Cut words and
furniture lines go through line-pair classifiers of the same kind.

Defined results: a null, empty or blank segment yields no case and is returned as it is; a null packet_id
yields no row in ``noise``; repeated rows of one packet count once in the result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.boosting import Boosted
from quern.runtime import broadcast_if_small, cut, hashed_sample

#: Bound of each labelled sample that a classifier here is fitted on.
FIT_ROWS = 12_000
#: A word is trusted as a correction if it stands in at least this many packets.
TRUSTED_PACKETS = 4

# Marks that can end a cut line.
HYPHENS = "-­‐‑‒–¬⸗・﹣－"
# Words that may stand beside the number in a page-number line.
PAGE_WORDS = {"page", "pages", "pg", "pag", "p", "pp", "of", "seite", "von", "folio", "sheet", "página", "pagina", "de", "sur", "s"}
# Glyph groups that scanners take for one another (read form, true form).
CONFUSED = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("$", "s"), ("8", "b"), ("6", "b"),
    ("9", "g"), ("3", "e"), ("2", "z"), ("4", "a"), ("@", "a"), ("7", "t"), ("à", "a"), ("á", "a"), ("â", "a"), ("ä", "a"), ("é", "e"),
    ("è", "e"), ("ö", "o"), ("ò", "o"), ("ó", "o"), ("ü", "u"), ("í", "i"), ("ì", "i"), ("c", "e"), ("e", "c"), ("q", "g"), ("g", "q"),
    ("b", "h"), ("h", "b"), ("m", "rn"), ("rn", "m"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"),
    ("li", "h"), ("h", "li"), ("l", "i"), ("i", "l"), ("f", "t"), ("t", "f"), ("n", "ri"), ("ri", "n"), ("u", "n"), ("n", "u"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("fi", "h"), ("lc", "k"), ("tt", "it"), ("ni", "m"), ("in", "m"),
    ("o", "c"), ("c", "o"), ("o", "e"), ("e", "o"), ("a", "o"), ("s", "5"), ("v", "y"), ("y", "v"),
]
#: Rows of the index, of some 60 bytes each, that are broadcast; a larger one is joined by a shuffle.
INDEX_ROWS = 400_000
#: An index list (trigram, length) of more words than this is spread over ``SALTS`` tasks.
LONG_LIST = 200
SALTS = 16

ROWS = "packet_id long, document_key string, kind string, a string, b string, n int, f array<double>, ids array<long>"
_WORD = re.compile(r"[^\W_]+")
#: At most six words; more are no page number. Possessive, so that a long line is left after its seventh word.
_FEW = re.compile(r"[\W_]*+(?:[^\W_]++[\W_]*+){1,6}+$")
_ENTRY = re.compile(r"([-*+•]|\d+[.)]|[a-z][.)])\s")
_ROMAN = re.compile(r"(?i)[ivxlc]{1,7}")
_CODE = re.compile(r"[A-Za-z]\d+[A-Za-z]?|\d+[A-Za-z]?\d*|\d.*\d.*")
_END = re.compile(r"[.!?:;][\"')\]]*$")
_CUT = re.compile(rf"([^\W\d_][\w!|$@]*(?:-[^\W\d_]+)*)[{HYPHENS}]$")
_RIGHT = re.compile(r"[\"'(]*([^\W\d_][\w!|$@]*(?:-[\w!|$@]+)*)")
_STRIP = ".,;:()[]{}\"'“”‘’«»?*`"


def page_number(line: str) -> bool:
    """True for a line that is a number with at most page words and decoration around it."""
    words = _WORD.findall(line.lower())
    letters = "".join(w for w in words if w.isalpha() and len(w) == 1)
    if len(letters) > 1 and letters in PAGE_WORDS:
        words = [w for w in words if not (w.isalpha() and len(w) == 1)]
    numbers = [w for w in words if w.isdigit()]
    rest = [w for w in words if not w.isdigit() and w not in PAGE_WORDS]
    if not numbers and len(rest) == 1 and _ROMAN.fullmatch(rest[0]):
        return True
    glued = [w for w in rest if not re.fullmatch(r"(?:page|pg|p|seite)\d{1,5}", w)]
    return not glued and 1 <= len(numbers) + len(rest) <= 3 and len(words) <= 6


def kinds_of(lines: list[str]) -> list[str]:
    """The kind of each line: fence, table, heading, marker, blank, list, number or text."""
    out, fence = [], False
    for x in lines:
        s = x.strip()
        if s[:3] in ("```", "~~~"):
            out.append("fence")
            fence = not fence
        elif fence:
            out.append("fence")
        elif not s:
            out.append("blank")
        elif s.startswith("<!--"):
            out.append("marker")
        elif s.startswith("#"):
            out.append("heading")
        elif _FEW.match(s) and page_number(s):
            out.append("number")
        elif s.startswith("|") or s.count("\t") >= 1 or s.count("|") >= 3:
            out.append("table")
        elif _ENTRY.match(s):
            out.append("list")
        else:
            out.append("text")
    return out


def _wrap(lines: list[str], kinds: list[str]) -> float:
    lengths = sorted(len(x) for x, k in zip(lines, kinds, strict=True) if k == "text")
    return float(max(lengths[(len(lengths) * 9) // 10], 1)) if lengths else 1.0


def furniture(lines: list[str], kinds: list[str], key: str | None, pages: str | None, sample: int) -> dict[int, list[float]]:
    """Features of the lines that may be furniture, by line number; -1 - number for one ordinary line if ``sample`` says so."""
    slug = set(_WORD.findall((key or "").lower()))
    wrap = _wrap(lines, kinds)
    chosen: list[int] = []
    ordinary = -1
    for i, k in enumerate(kinds):
        if k == "number":
            chosen.append(i)
        elif k == "text":
            s = lines[i].strip()
            ends = s[-1] in ".!?:;" or bool(_END.search(s))
            if ends or s[0].islower():
                parts = s.lower().split()
                if len(parts) > 2 and sum(map(slug.__contains__, parts)) >= 0.6 * len(parts):
                    chosen.append(i)
                elif ordinary < 0 or i == sample % len(lines):
                    ordinary = i
                continue
            words = _WORD.findall(s)
            long = [w for w in words if len(w) > 3 and w.isalpha()] or words
            follows = i + 1 < len(lines) and kinds[i + 1] not in ("blank", "heading", "fence")
            n = i + 1
            while n < len(lines) and kinds[n] not in ("text", "list"):
                n += 1
            first = lines[n].split(None, 1)[0] if n < len(lines) else ""
            if words and (
                (len(words) > 1 and sum(w[0].isupper() for w in long) >= 0.6 * len(long))
                or (follows and len(s) + 1 + len(first) < wrap - 6)
                or sum(w.lower() in slug for w in words) >= 0.5 * len(words)
            ):
                chosen.append(i)
            else:  # the harder contrast: it starts like a header
                ordinary = i
    if not chosen and (ordinary < 0 or sample % 2):
        return {}
    seen = Counter(re.sub(r"\d+", "#", x.strip().lower()) for x in lines)
    bounds = [int(n) for n in re.findall(r"\d{1,18}", pages or "")]
    solid = [i for i, k in enumerate(kinds) if k != "blank"]
    place = {i: n for n, i in enumerate(solid)}
    out: dict[int, list[float]] = {}
    for i in [*chosen, *([ordinary] if ordinary >= 0 and sample % 2 == 0 else [])]:
        s = lines[i].strip()
        words = _WORD.findall(s) or ["-"]
        n = place[i]
        before = next((j for j in reversed(solid[max(0, n - 6) : n]) if kinds[j] in ("text", "list")), None)
        after = next((j for j in solid[n + 1 : n + 7] if kinds[j] in ("text", "list")), None)
        flows = before is not None and not _END.search(lines[before].strip())
        lower = after is not None and lines[after].strip()[:1].islower()
        follows = i + 1 < len(lines) and kinds[i + 1] not in ("blank", "heading", "fence")
        precedes = i > 0 and kinds[i - 1] not in ("blank", "heading", "fence")
        long = [w for w in words if len(w) > 3 and w.isalpha()] or words
        ends = bool(_END.search(s))
        first = lines[after].split(None, 1)[0] if after is not None else ""
        early = follows and not ends and len(s) + 1 + len(first) < wrap - 6
        numbers = [int(w) for w in words if w.isdecimal() and len(w) < 19]
        f = [
            sum(w.lower() in slug for w in words) / len(words), len(words), sum(w[0].isupper() for w in long) / len(long), s.upper() == s and any(c.isalpha() for c in s),
            1 - min(len(s) / wrap, 1.0), flows, lower, ends, early, sum(0 <= j < len(lines) and kinds[j] in ("marker", "number") for j in (i - 1, i + 1)),
            "  " in s or "|" in s, seen[re.sub(r"\d+", "#", s.lower())], sum(w.isdigit() for w in words) / len(words),
            bool(bounds) and any(min(bounds) <= v <= max(bounds) for v in numbers), kinds[i] == "number", follows + precedes, s[:1].isupper() or s[:1].isdigit(),
            (before is not None) + (after is not None),
        ]
        out[-1 - i if i == ordinary else i] = [float(v) for v in f]
    return out


class _Tokens(dict):
    """What a token as it stands between blanks says: (plain word forms, compound or None, bare token, ends a sentence)."""

    def __missing__(self, raw: str) -> tuple[tuple[str, ...], str | None, str, bool]:
        token = raw.strip(_STRIP)
        forms: tuple[str, ...] = ()
        compound = None
        if token and "/" not in token and "=" not in token:
            bits = [b for b in _MARKS.split(token) if b]
            if len(bits) > 1 and all(b.isalpha() for b in bits):
                compound = "-".join(bits).lower()
            forms = tuple(
                b for b in bits
                if (n := sum(c.isalpha() for c in b)) >= 2 and n >= 0.5 * len(b) and not _CODE.fullmatch(b) and not (len(bits) == 1 and _MODEL.search(b))
            )
        if len(self) > 300_000:
            self.clear()
        found = self[raw] = (forms, compound, token, len(token) > 1 and raw[-1] in ".!?:")
        return found


_MARKS = re.compile(rf"[{HYPHENS}]")
_MODEL = re.compile(r"[a-z]\d{2,}|[A-Z]\d")
_TOKENS = _Tokens()


def running(lines: list[str], kinds: list[str], skip: set[int]) -> tuple[dict[str, bool], list[tuple[str, str, int, int]], set[str]]:
    """Running words (lower form -> only met as a name inside a sentence), cut words (left, right, lines), compounds."""
    words: dict[str, bool] = {}
    cuts: list[tuple[str, str, int, int]] = []
    compounds: set[str] = set()
    flow = [i for i, k in enumerate(kinds) if k in ("text", "list") and i not in skip]
    plain: set[str] = set()
    half = False
    start = True
    for n, i in enumerate(flow):
        line = lines[i].rstrip()
        parts = line.split()
        joined = False
        if line[-1] in HYPHENS and n + 1 < len(flow):
            left, nxt = _CUT.search(parts[-1]), flow[n + 1]
            if left and not any(kinds[j] in ("heading", "fence", "table") for j in range(i + 1, nxt)):
                right = _RIGHT.match(lines[nxt].strip())
                if right and right.group(1)[0].islower():
                    cuts.append((left.group(1), right.group(1), i, nxt))
                    joined = True
        lo, hi = int(half), len(parts) - int(joined)
        plain.update(parts[lo:hi])
        for m in range(lo, hi):
            raw = parts[m]
            if raw[0].islower():
                continue
            forms = _TOKENS[raw][0]
            if forms and any(c.isupper() for c in raw):
                first = start if m == 0 else _TOKENS[parts[m - 1]][3]
                code = m + 1 < len(parts) and _CODE.fullmatch(_TOKENS[parts[m + 1]][2] or "-") is not None
                for b in forms:
                    if b[0].isupper():
                        name = not first or code or b.isupper()
                        w = b.lower()
                        words[w] = words.get(w, True) and name
        start = _TOKENS[parts[-1]][3]
        half = joined
    for raw in plain:
        forms, compound, _, _ = _TOKENS[raw]
        if compound:
            compounds.add(compound)
        for b in forms:
            if not b[0].isupper():
                words[b.lower()] = False
    return words, cuts, compounds


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["packet_id", "document_key", "kind", "a", "b", "n", "f", "ids"]
    for batch in batches:
        out = []
        holders: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
        bound: Counter[str] = Counter()
        for pid, key, pages, text in zip(batch.packet_id, batch.document_key, batch.page_range, batch.source_segment, strict=True):
            if not text or pid is None or pid != pid:
                continue
            pid = int(pid)
            lines = text.split("\n")
            kinds = kinds_of(lines)
            marks = furniture(lines, kinds, key, pages, pid)
            for i, f in marks.items():
                raw = lines[i if i >= 0 else -1 - i].strip()
                out.append((pid, key, "l" if i >= 0 else "n", re.sub(r"\d+", "#", raw.lower()), raw, i if i >= 0 else -1 - i, f, None))
            words, cuts, compounds = running(lines, kinds, {i for i in marks if i >= 0})
            for w, name in words.items():
                holders[name].setdefault(w, []).append(pid)
            bound.update(compounds)
            out += [(pid, key, "j", a, b, i, None, None) for a, b, i, _ in cuts]
        out += [(None, None, "w", w, None, name, None, ids) for name in (0, 1) for w, ids in holders[name].items()]
        out += [(None, None, "c", w, None, n, None, None) for w, n in bound.items()]
        yield pd.DataFrame(out, columns=columns).astype({"packet_id": "Int64"})


def rows_of(packets: DataFrame) -> DataFrame:
    """Every segment taken apart, in the columns of ``ROWS``.

    Kinds: ``l`` a line that may be furniture, ``n`` an ordinary line for contrast, ``j`` a cut word; of a
    whole batch ``w`` a word (n: 1 as a name only) with the packets it stands in and ``c`` a compound with its count.
    """
    return packets.select(
        F.col("packet_id").cast("long"), F.col("document_key").cast("string"), F.col("page_range").cast("string"), F.col("source_segment").cast("string")
    ).mapInPandas(_parse, ROWS)


# ---- misread words ----------------------------------------------------------------------------------


def _steps() -> dict[str, list[tuple[str, float]]]:
    table: dict[str, list[tuple[str, float]]] = {}
    for read, true in CONFUSED:
        table.setdefault(read, []).append((true, 0.2))
    return table


_STEPS = _steps()


def misreading(read: str, true: str) -> tuple[float, int]:
    """Least cost of reading ``true`` as ``read``, and the number of look-alike groups used."""
    n, m = len(read), len(true)
    best = [[(99.0, 0)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0.0, 0)
    for i in range(n + 1):
        row = best[i]
        for j in range(m + 1):
            cost, used = row[j]
            if cost > 4:
                continue
            if i < n and j < m:
                step = (cost + (0.0 if read[i] == true[j] else 1.0), used)
                if step < best[i + 1][j + 1]:
                    best[i + 1][j + 1] = step
            if i < n and (cost + 1, used) < best[i + 1][j]:
                best[i + 1][j] = (cost + 1, used)
            if j < m and (cost + 1, used) < row[j + 1]:
                row[j + 1] = (cost + 1, used)
            for size in (1, 2, 3):
                for to, price in _STEPS.get(read[i : i + size], ()) if i + size <= n else ():
                    if true.startswith(to, j) and (cost + price, used + 1) < best[i + size][j + len(to)]:
                        best[i + size][j + len(to)] = (cost + price, used + 1)
    return best[n][m]


def trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return list(dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2)))


def pair_features(read: str, read_df: float, true: str, true_df: float) -> list[float]:
    cost, used = misreading(read, true)
    a, b = set(trigrams(read)), set(trigrams(true))
    odd = sum(not ("a" <= c <= "z") for c in read)
    return [cost, float(used), len(a & b) / max(len(a | b), 1), float(odd), float(np.log1p(read_df)), float(np.log1p(true_df)), float(np.log((1 + true_df) / (1 + read_df))), float(len(read)), float(len(true)), cost / max(len(true), 1)]


def candidates(words: DataFrame) -> DataFrame:
    """Pairs (read, true) of counted words by the trigram join; ``words`` has word, packets, spoken.

    The inverted index holds trusted words under (trigram, length); a word probes the lengths it could
    have been misread from. Trigrams that both share are counted, Levenshtein distance closes the filter.
    """
    gram = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("p") - 2), lambda i: F.substring(F.col("p"), i, F.lit(3))))
    padded = words.withColumn("p", F.concat(F.lit("^"), "word", F.lit("$"))).where(F.length("p") >= 5)
    index = padded.where((F.col("packets") >= TRUSTED_PACKETS) & F.col("spoken") & F.col("word").rlike(r"^\p{L}+$")).select(
        F.col("word").alias("true"), F.col("packets").alias("true_df"), F.posexplode(gram).alias("at", "g"), F.length("word").alias("len")
    )
    probe = (
        padded.where(F.col("spoken"))
        .select(F.col("word").alias("read"), F.col("packets").alias("read_df"), F.posexplode(gram).alias("from", "g"), F.length("word").alias("size"))
        .withColumn("len", F.explode(F.sequence(F.col("size") - 2, F.col("size") + 2)))
    )
    index, on = cut(index), ["g", "len"]
    if index.count() <= INDEX_ROWS:
        index = F.broadcast(index)
    else:
        long = broadcast_if_small(cut(index.groupBy(*on).agg(F.count("*").alias("words")).where(F.col("words") > LONG_LIST).select(*on, F.lit(True).alias("long"))))
        copies = F.when(F.col("long"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        index = index.join(long, on, "left").withColumn("salt", F.explode(copies)).drop("long")
        probe = probe.join(long, on, "left").withColumn("salt", F.when(F.col("long"), F.pmod(F.xxhash64("read"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("long")
        on = [*on, "salt"]
    near = (F.col("far") >= 0) & ((F.col("far") <= 1) | ((F.col("far") == 2) & (F.col("size") >= 5)) | (F.col("size") >= 7))
    return (
        probe.join(index, on)
        .where((F.abs(F.col("from") - F.col("at")) <= 2) & (F.col("read") != F.col("true")) & (F.col("true_df") >= F.col("read_df")))
        .withColumn("far", F.levenshtein("read", "true", 3))
        .where(near)  # before the count, so that only near pairs are shuffled
        .groupBy("read", "true")
        .agg(F.count("*").alias("shared"), F.first("read_df").alias("read_df"), F.first("true_df").alias("true_df"), F.first("far").alias("far"))
        .where((F.col("far") < 3) | (F.col("shared") >= 2))
    )


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["f"] = [pair_features(*x) for x in zip(b["read"], b["read_df"], b["true"], b["true_df"], strict=True)]
        yield b[["read", "true", "read_df", "true_df", "f"]]


def _misread(word: str, rng: np.random.Generator) -> str:
    """A word as a scanner may misread it: one or two look-alike swaps."""
    for _ in range(1 + int(rng.random() < 0.25)):
        swaps = [(r, t, i) for r, t in CONFUSED for i in range(len(word)) if word.startswith(t, i)]
        if swaps:
            r, t, i = swaps[int(rng.integers(len(swaps)))]
            word = word[:i] + r + word[i + len(t) :]
    return word


def fit_ranker(pairs: DataFrame, words: DataFrame, seed: int = 7) -> Boosted:
    """Ranker of corrections. Positives: trusted words misread at random, with the packet counts that
    words with a digit or sign inside have; negatives: the same at counts near the word's own, and pairs of
    two established words."""
    trusted = hashed_sample(words.where((F.col("packets") >= TRUSTED_PACKETS) & F.col("spoken") & F.col("word").rlike("^[a-z]{4,}$")), FIT_ROWS // 4, "word")
    odd = hashed_sample(words.where(F.col("spoken") & F.col("word").rlike("^[a-z]+[0-9!|$]+[a-z]+$")), 2000, "word")
    trusted.sort(key=lambda r: r["word"])
    counts = np.sort(np.array([r["packets"] for r in odd] or [1, 1, 2]))
    rng = np.random.default_rng(seed)
    x, y = [], []
    known = {r["word"] for r in trusted}
    for r in trusted:
        for _ in range(2):
            bad = _misread(r["word"], rng)
            if bad != r["word"] and bad not in known:
                x.append(pair_features(bad, float(min(rng.choice(counts), r["packets"])), r["word"], float(r["packets"])))
                y.append(1.0)
                other = trusted[int(rng.integers(len(trusted)))]
                # A look-alike that is nearly as frequent as the word itself is a word of its own.
                often = r["packets"] / float(rng.uniform(1, 12))
                if often >= 6:
                    x.append(pair_features(bad, often, r["word"], float(r["packets"])))
                    y.append(0.0)
                if abs(len(other["word"]) - len(bad)) < 3 and other["word"] != r["word"]:
                    x.append(pair_features(bad, 1.0, other["word"], float(other["packets"])))
                    y.append(0.0)
    settled = pairs.where((F.col("read_df") >= 3 * TRUSTED_PACKETS) & F.col("read").rlike("^[a-z]+$") & (F.col("true_df") < 30 * F.col("read_df")))
    for r in sorted(hashed_sample(settled, FIT_ROWS // 4, "read", "true"), key=lambda r: (r["read"], r["true"])):
        x.append(list(r["f"]))
        y.append(0.0)
    return Boosted(trees=40, depth=3).fit(np.array(x or [[0.0] * 10]), np.array(y or [0.0]))


def corrections(words: DataFrame) -> DataFrame:
    """Misread word forms with the trusted word that ranks first: read, true, score."""
    pairs = cut(candidates(words).select("read", "true", "read_df", "true_df").mapInPandas(_features, "read string, true string, read_df long, true_df long, f array<double>"))
    model = fit_ranker(pairs, words)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["score"] = model.score(np.stack(b["f"].to_numpy()))
                yield b[["read", "true", "true_df", "score"]]

    scored = pairs.mapInPandas(rank, "read string, true string, true_df long, score double").where("score >= 0.5")
    best = cut(scored.groupBy("read").agg(F.max_by("true", F.struct("score", "true_df", "true")).alias("true"), F.max("score").alias("score")))
    # The choice may be a frequent misreading itself; then its own correction stands.
    then = best.select(F.col("read").alias("true"), F.col("true").alias("after"))
    return best.join(then, "true", "left").where(F.coalesce("after", "true") != F.col("read")).select("read", F.coalesce("after", "true").alias("true"), "score")


# ---- the operator ------------------------------------------------------------------------------------


def _fit_furniture(lines: DataFrame, number: bool, seed: int = 11) -> Boosted:
    """Line-pair classifier for header lines or page-number lines, from weak labels of a bounded sample.

    A header label is agreement with the document's own name or recurrence within the document; these
    very features are blanked in half of the positives, so that layout alone has to carry them.
    """
    rows = sorted(hashed_sample(lines.select("packet_id", "n", "kind", "f", "recurs"), FIT_ROWS, "packet_id", "n"), key=lambda r: (r["packet_id"], r["n"]))
    rng = np.random.default_rng(seed)
    x, y = [], []
    for r in rows:
        f = [*r["f"], float(r["recurs"])]
        is_number = f[14] > 0
        if number:
            if r["kind"] == "n" or (is_number and f[7] > 0 and f[5] > 0):
                x.append(f)
                y.append(0.0)
            elif is_number and (f[13] > 0 or f[9] > 0 or f[8] > 0):
                x.append(f)
                y.append(1.0)
            continue
        if is_number:
            continue
        # A line of its own that fills the width, recurs nowhere and shares no word with the document's name is running text.
        if r["kind"] == "n" or (f[0] == 0 and f[11] == 1 and f[18] == 1 and f[4] < 0.15 and f[8] == 0):
            x.append(f)
            y.append(0.0)
        elif f[7] == 0 and (f[0] >= 0.6 or f[11] >= 2 or f[18] >= 2):
            if rng.random() < 0.5:
                f[0], f[11], f[18] = 0.0, 1.0, 1.0
            x.append(f)
            y.append(1.0)
    return Boosted(trees=30, depth=3).fit(np.array(x or [[0.0] * 19]), np.array(y or [0.0]))


def _fit_joiner(counts: DataFrame, seed: int = 5) -> Boosted:
    """Line-pair classifier for cut words: whole words split at random against compounds split at their hyphen."""
    words = sorted(hashed_sample(counts.where("kind = 'w' and packets >= 3").where(F.length("a") >= 5), FIT_ROWS // 4, "a"), key=lambda r: r["a"])
    compounds = sorted(hashed_sample(counts.where("kind = 'c' and packets >= 2"), FIT_ROWS // 4, "a"), key=lambda r: r["a"])
    rng = np.random.default_rng(seed)
    x, y = [], []
    for r in words:
        unseen = rng.random() < 0.3
        x.append([0.0 if unseen else np.log1p(r["packets"]), 0.0, float(len(r["a"]))])
        y.append(1.0)
    for r in compounds:
        for _ in range(max(1, min(20, len(words) // max(len(compounds), 1)))):
            x.append([np.log1p(rng.integers(0, 2)), np.log1p(r["packets"]), float(len(r["a"]) - 1)])
            y.append(0.0)
    return Boosted(trees=20, depth=2).fit(np.array(x or [[0.0] * 3]), np.array(y or [0.0]))


def _scorer(model: Boosted):
    @F.pandas_udf("double")
    def score(f: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(f.to_numpy())) if len(f) else [], dtype="float64")

    return score


def findings(packets: DataFrame) -> DataFrame:
    """Every finding: packet_id, noise_kind, n (line, -1 for a word), a (as read), b (right part or correction)."""
    rows = cut(rows_of(packets))
    here = F.when(F.col("kind") == "w", F.size("ids")).otherwise(F.col("n"))
    counts = cut(rows.where("kind in ('w', 'c')").groupBy("kind", "a").agg(F.sum(here).alias("packets"), F.sum(F.when((F.col("kind") == "w") & (F.col("n") == 0), F.size("ids")).otherwise(0)).alias("plain")))
    words = counts.where("kind = 'w'").select(F.col("a").alias("word"), "packets", (F.col("plain") * 2 > F.col("packets")).alias("spoken"))  # else it is a name for the most part

    lines = rows.where("kind in ('l', 'n')")
    recurs = lines.where("kind = 'l' and document_key is not null").groupBy("document_key", "a").agg(F.count("*").alias("recurs"))
    lines = cut(lines.join(recurs, ["document_key", "a"], "left").fillna({"recurs": 1}))
    full = F.concat("f", F.array(F.col("recurs").cast("double")))
    heads, numbers = _scorer(_fit_furniture(lines, False)), _scorer(_fit_furniture(lines, True))
    is_number = F.element_at("f", 15) > 0
    lines = lines.where("kind = 'l'")
    headers = lines.where(~is_number).where(heads(full) >= 0.5).select("packet_id", F.lit("header").alias("noise_kind"), "n", F.col("b").alias("a"), F.lit(None).cast("string").alias("b"))
    paged = lines.where(is_number).where(numbers(full) >= 0.5).select("packet_id", F.lit("page_number").alias("noise_kind"), "n", F.col("b").alias("a"), F.lit(None).cast("string").alias("b"))

    cuts = rows.where("kind = 'j'").select("packet_id", "n", "a", "b", F.lower(F.concat("a", "b")).alias("whole"), F.lower(F.concat_ws("-", "a", "b")).alias("compound"))
    fix = cut(corrections(words.unionByName(_whole(cuts, words))))

    spoken = counts.where("kind = 'w'").select(F.col("a").alias("whole"), F.col("packets").alias("whole_df"))
    bound = counts.where("kind = 'c'").select(F.col("a").alias("compound"), F.col("packets").alias("compound_df"))
    repaired = fix.select(F.col("read").alias("whole"), F.col("true").alias("whole_true"))
    joins = cuts.join(spoken, "whole", "left").join(bound, "compound", "left").join(repaired, "whole", "left").fillna({"whole_df": 0, "compound_df": 0})
    pair = F.array(F.log1p("whole_df"), F.log1p("compound_df"), F.length("whole").cast("double"))
    whole = joins.where((_scorer(_fit_joiner(counts))(pair) >= 0.5) | F.col("whole_true").isNotNull())
    hyphens = whole.select("packet_id", F.lit("hyphen").alias("noise_kind"), "n", "a", "b")

    # One row per word and batch, with its packets: a word of every packet is no hot key, and only misread words are exploded.
    held = rows.where("kind = 'w' and n = 0").select(F.col("a").alias("read"), "ids").join(fix, "read")
    tokens = held.select(F.explode("ids").alias("packet_id"), "read", "true")
    tokens = tokens.unionByName(whole.where("whole_true is not null").select("packet_id", F.col("whole").alias("read"), F.col("whole_true").alias("true")))
    glyphs = tokens.select("packet_id", F.lit("glyph").alias("noise_kind"), F.lit(-1).alias("n"), F.col("read").alias("a"), F.col("true").alias("b"))
    return headers.unionByName(paged).unionByName(hyphens).unionByName(glyphs)


def _whole(cuts: DataFrame, words: DataFrame) -> DataFrame:
    """Joined halves that no packet has in one piece: they may hold a misread character too."""
    joined = cuts.groupBy(F.col("whole").alias("word")).agg(F.countDistinct("packet_id").alias("packets"))
    return joined.join(words.select("word"), "word", "left_anti").select("word", "packets", F.lit(True).alias("spoken"))


def noise(packets: DataFrame) -> DataFrame:
    """Distinct (packet_id, noise_kind)."""
    return findings(packets).select("packet_id", "noise_kind").distinct()


def _repair(text: str | None, found: list) -> str | None:
    if not text:
        return text
    lines = text.split("\n")
    drop = {f["n"] for f in found if f["noise_kind"] in ("header", "page_number")}
    cuts = {f["n"] for f in found if f["noise_kind"] == "hyphen"}
    swap = {f["a"]: f["b"] for f in found if f["noise_kind"] == "glyph"}
    kinds = kinds_of(lines)
    out: list[str] = []
    open_text = half = False
    for i, x in enumerate(lines):
        if i in drop:
            continue
        s = x.strip()
        if kinds[i] == "marker" and (open_text or half):
            out.append(s)
            continue
        if kinds[i] not in ("text", "list", "number"):
            out.append(x)
            open_text = half = False
            continue
        last = next((j for j in range(len(out) - 1, -1, -1) if not out[j].startswith("<!--")), None)
        if open_text and kinds[i] != "list" and last is not None:
            out[last] = out[last].rstrip(HYPHENS) + s if half else out[last] + (s if re.search(r"\w-$", out[last]) else " " + s)
        else:
            out.append(s)
        open_text, half = True, i in cuts
    if swap:
        def word(m: re.Match) -> str:
            to = swap.get(m.group(0).lower())
            return m.group(0) if to is None else to.capitalize() if m.group(0)[0].isupper() else to

        shape = re.compile(r"[\w!|$@]+")
        shown = kinds_of(out_lines := "\n".join(out).split("\n"))
        out = [shape.sub(word, x) if k in ("text", "list") else x for x, k in zip(out_lines, shown, strict=True)]
    return "\n".join(out)


def repair(packets: DataFrame) -> DataFrame:
    """packet_id and the segment as continuous paragraphs; headings, commands, tables and markers stay."""
    found = findings(packets).groupBy("packet_id").agg(F.collect_list(F.struct("noise_kind", "n", "a", "b")).alias("found"))

    @F.pandas_udf("string")
    def mend(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_repair(t, list(f) if f is not None else []) for t, f in zip(text, found, strict=True)], dtype=object)

    return packets.select("packet_id", "source_segment").join(found, "packet_id", "left").select("packet_id", mend("source_segment", "found").alias("repaired_segment"))
