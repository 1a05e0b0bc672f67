"""Template residue, filler, error pages and script notices that stand in place of content.

Passages (paragraphs, without code and quotations) are scored by a naive Bayes model that is learned from
trusted positive records and unlabelled text only; in the final decision these are scored like all others. One pass over the texts counts hashed word and
word-pair features of all passages and writes the word ids of every record aside; a second, over those, keeps the
passages that the trusted classes could explain at all, and expectation-maximization runs over them as Spark jobs whose results are the bounded count tables
(``FEATURES`` x classes). The class-conditional word laws are Dirichlet-smoothed with the law of the whole
corpus, so a word foreign to a class counts against it however rare it is, and noise words never count for it.

Defined results: null or empty texts are no residue; a null doc_id gives no row; repeated rows give one;
without any trusted record nothing is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import chunks
from quern.runtime import cut, drop_folder, fresh_folder

KINDS = ("placeholder", "filler", "error_page", "script_notice")
HALF = 1 << 17
FEATURES = 2 * HALF
ROUNDS = 4
#: A record with a sign for every so many words is trusted, whatever its length.
SIGN_WORDS = 80
#: Upper ends of the record-length buckets, in words.
LENGTHS = (8, 16, 32, 80, 200)
#: Mass of the corpus law in each class's smoothing, as a multiple of the class's own mass. Slots stand amid
#: ordinary prose, so foreign words hardly speak against a placeholder; they do against the rest.
SMOOTH = np.array([40.0, 0.1, 0.1, 0.1])
#: A feature speaks for a placeholder if the class holds it this many times as often as the corpus.
OVER = 20.0
#: Features counted less often than this say nothing, and posteriors under ``DOUBT`` count for nothing:
#: else a passage would vouch for itself by the words that only it has.
RARE = 5
DOUBT = 0.2
#: Weight at the start of a trusted record's passages that do not carry the sign themselves.
MAYBE = 0.5
#: How much the other passages of a record add to the odds of their class.
COHERE = 50.0
#: A passage with more letters than this per word, in a record that has more too, is no running text unless its
#: record is trusted; a passage of LONG_PASSAGE words or more of which a smaller share than REPEATED is different
#: repeats itself. Neither is an error page or a notice.
DENSE = 15
LONG_PASSAGE = 40
REPEATED = 0.3
#: A passage is kept for the EM if its best class is at most this far behind the background, in nats.
KEEP = -12.0

# Ways to write a slot. Each becomes a word of its own.
SLOTS = {
    "curlies": r"\{\{[^{}\n]+\}\}", "dollar": r"\$\{[^{}\n]+\}", "hash": r"#\{[^{}\n]+\}", "tag": r"\{%[^%\n]+%\}", "erb": r"<%=?[^%\n]+%>",
    "brackets": r"\[\[\s*[a-z][\w .-]+\]\]", "angles": r"<<\s*[a-z][\w .-]{2,}>>", "percents": r"%%[a-z]\w+%%", "ats": r"@@[a-z]\w+@@",
    "unders": r"\b__[a-z][a-z0-9_]{2,}__", "percent": r"%[a-z][a-z_]{2,}%", "tbd": r"[<\[(]\s*(?:tbd|tba|tbc|todo|xxx)\b[^<>\[\]()\n]*[>\])]",
    "your": r"[<\[]\s*(?:your|insert|enter|add|name of|replace)\b[^<>\[\]\n]*[>\]]", "supply": r"\([^()\n]+\bto be (?:supplied|added|confirmed|determined|written|defined)\)",
    "exes": r"\bx{3,}-[\w-]+-x{3,}", "todo": r"\b(?:todo|fixme|tbd)\s*:",
}
# Signs that make a record trusted for a class.
TRUSTED = {
    "filler": r"\blorem ipsum\b|\bdummy text\b|\bfiller (?:text|line)|\b(\w+) \1 \1 \1\b|\basdf\b|\bsample text\b",
    "error_page": r"\b(?:error|status|http)\W{0,3}[45]\d\d\b|\b[45]\d\d\W+(?:not found|forbidden|gone|unauthori[sz]ed|bad|internal|service|gateway|too many)|\bnot found\b|\bservice unavailable\b|\binternal server error\b|\bbad gateway\b|\btoo many requests\b|\bnicht gefunden\b|\bno encontrad[ao]\b|\bnon trouvée\b|\bintrouvable\b|\bsession has expired\b|\baccess denied\b|\btraceback\b",
    "script_notice": r"\b(?:enable|activate|activer|aktivieren|active|habilite|allow|permit|turn on|needs?|requires?|without|run)\b.{0,30}\b(?:java\s?script|scripts?|scripting|active content)\b|\b(?:java\s?script|scripts?|scripting)\b.{0,30}\b(?:required|blocked|disabled|turned off|off)\b|\bchecking (?:that )?your browser\b",
}
_SLOT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SLOTS.items()), re.I)
_TRUST = [(KINDS.index(k), re.compile(v, re.I)) for k, v in TRUSTED.items()]
#: Every sign of a class has one of these in lower case; a filler may also be a word that stands four times in a row,
#: and an error page a status number beside one of the words after the bar.
_CUES = (
    ("lorem ipsum", "dummy text", "filler text", "filler line", "asdf", "sample text"),
    ("not found", "service unavailable", "internal server error", "bad gateway", "too many requests", "nicht gefunden", "no encontrad", "non trouv", "introuvable", "session has expired", "access denied", "traceback"),
    ("script", "active content", "your browser"),
)
_BESIDE = ("error", "status", "http", "forbidden", "gone", "unauthori", "bad", "internal", "service", "gateway")
_STATUS = re.compile(r"(?<!\d)[45]\d\d(?!\d)").search
_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_SHOWN = re.compile(r"`[^`\n]+`|\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»|„[^“\n]+“")
_BREAK = re.compile(r"\n[ \t]*\n\s*|(?<=[.!?])\n|(?<=\n)(?=#)|(?<=^)(#[^\n]*)\n")
_TOKEN = re.compile(r"[^\W_]+|[\ue000\ue001]").findall
#: Every slot has one of these in lower case.
_SIGNS = ("{", "[", "<", "%", "@", "__", "xxx", "todo", "tbd", "tba", "tbc", "fixme", "to be ")
PARAGRAPH, RECORD = -1, -2
_SLOT_WORD = "slotof"


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        if word == "\ue000":
            value = PARAGRAPH
        elif word == "\ue001":
            value = RECORD
        else:
            if word.isdigit():
                word = "status#" if len(word) == 3 and word[0] in "45" else "number#"
            elif any(c.isdigit() for c in word):
                word = "code#"
            value = xxhash.xxh32_intdigest(word) % HALF
        self[word] = value
        return value


_IDS = _Ids()


def _plain(text: str) -> str:
    """The text without what it only shows, slots as words, paragraphs parted by a sign."""
    if "\ue000" in text or "\ue001" in text:
        text = text.replace("\ue000", " ").replace("\ue001", " ")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "`" in text or '"' in text or "“" in text or "«" in text:
        text = _SHOWN.sub(" ", text)
    lower = text.lower()
    if any(s in lower for s in _SIGNS):
        text = _SLOT.sub(lambda m: f" {_SLOT_WORD} {_SLOT_WORD}{m.lastgroup} ", text)
    return _BREAK.sub(lambda m: f"{m.group(1) or ''} \ue000 ", text)


def _records(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Word ids of all passages of the texts, passage starts (plus the end), record and letters of each passage, plain texts."""
    plain = [_plain(t) if t else "" for t in texts]
    tokens = _TOKEN(" \ue001 ".join(plain).lower())
    raw = np.fromiter(map(_IDS.__getitem__, tokens), dtype=np.int64)
    long = np.fromiter(map(len, tokens), dtype=np.int64)
    record = np.cumsum(raw == RECORD)
    passage = np.cumsum(raw < 0)
    words = raw >= 0
    ids, passage, record = raw[words], passage[words], record[words]
    starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(ids) else np.zeros(0, np.int64)
    letters = np.add.reduceat(long[words], starts) if len(ids) else long[words]
    return ids, np.r_[starts, len(ids)], record[starts] if len(ids) else record, letters, plain


def _pairs(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Feature of each word and the one before it; of a passage's first word, with itself alone."""
    before = np.r_[0, ids[:-1]] if len(ids) else ids
    before[starts[:-1]] = HALF - 1
    return HALF + (before * 31 + ids * 7) % HALF


def _trusted(plain: str, n: int, stutters: bool) -> int:
    """Class for which a record of n words is trusted, or -1: the first with a sign for every ``SIGN_WORDS`` words."""
    slots = plain.count(f" {_SLOT_WORD} ")
    if slots >= 2 and slots * 14 >= n:
        return 0
    lower = plain.lower()
    for (kind, pattern), cues in zip(_TRUST, _CUES, strict=True):
        if any(c in lower for c in cues) or kind == 1 and stutters or kind == 2 and _STATUS(lower) and any(c in lower for c in _BESIDE):
            if n <= SIGN_WORDS and pattern.search(plain) or n > SIGN_WORDS and sum(1 for _ in pattern.finditer(plain)) * SIGN_WORDS >= n:
                return kind
    return -1


def _label(kind: int, texts: list[str]) -> list[int]:
    """Labels of the passages of a trusted record: the kind where the sign itself stands, else -2 - kind (it may be)."""
    if kind == 0:
        return [0 if f" {_SLOT_WORD} " in t else -2 for t in texts]
    pattern = next(p for k, p in _TRUST if k == kind)
    return [kind if pattern.search(t) else -2 - kind for t in texts]


def _split(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: first row, ids, pair ids, passage starts, record of passage, words of record, label and letters of passage."""
    for lo, hi in chunks(texts):
        ids, starts, record, letters, plain = _records(texts[lo:hi])
        size = np.bincount(record, weights=np.diff(starts), minlength=hi - lo).astype(np.int64) if len(record) else np.zeros(hi - lo, np.int64)
        label = np.full(len(record), -1)
        first = np.searchsorted(record, np.arange(hi - lo + 1))
        again = np.flatnonzero((ids[3:] == ids[2:-1]) & (ids[3:] == ids[1:-2]) & (ids[3:] == ids[:-3])) if len(ids) > 3 else np.zeros(0, np.int64)
        stutters = np.zeros(hi - lo, bool)
        stutters[record[np.searchsorted(starts, again, side="right") - 1]] = True
        for k in np.flatnonzero(size > 0):
            kind = _trusted(plain[k], int(size[k]), bool(stutters[k]))
            if kind >= 0:
                parts = [p for p in plain[k].split("\ue000") if _TOKEN(p.replace("\ue001", " "))]
                if len(parts) == first[k + 1] - first[k]:
                    label[first[k] : first[k + 1]] = _label(kind, parts)
        yield lo, ids, _pairs(ids, starts), starts, record, size, label, letters


def _parts(values: np.ndarray, kind: type, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    """The values of each range as bytes."""
    raw, each = values.astype(kind).tobytes(), np.dtype(kind).itemsize
    return [raw[a:z] for a, z in zip((lo * each).tolist(), (hi * each).tolist(), strict=True)]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``READ`` of a partition: its records that have a word, then its feature counts (class -1 all passages,
    else trusted ones; features past FEATURES are length buckets)."""
    total = np.zeros(FEATURES + len(LENGTHS) + 1)
    held = np.zeros((len(KINDS), FEATURES + len(LENGTHS) + 1))
    for b in batches:
        doc = b["doc_id"].to_numpy()
        for lo, ids, pairs, starts, record, size, label, letters in _split(b["text"].tolist()):
            if not len(record):
                continue
            total[:HALF] += np.bincount(ids, minlength=HALF)
            total[HALF:FEATURES] += np.bincount(pairs - HALF, minlength=HALF)
            bucket = np.searchsorted(LENGTHS, size[record])
            total[FEATURES:] += np.bincount(bucket, minlength=len(LENGTHS) + 1)
            for p in np.flatnonzero(label != -1):
                row, weight = (held[label[p]], 1.0) if label[p] >= 0 else (held[-2 - label[p]], MAYBE)
                row[np.unique(ids[starts[p] : starts[p + 1]])] += weight
                row[np.unique(pairs[starts[p] : starts[p + 1]])] += weight
                row[FEATURES + bucket[p]] += weight
            own = np.unique(record)
            at, end = np.searchsorted(record, own), np.searchsorted(record, own, side="right")
            found = {"kind": WRITTEN, "key": doc[lo + own], "n": 0.0, "ids": _parts(ids, np.int32, starts[at], starts[end])}
            yield pd.DataFrame(found | {"lengths": _parts(np.diff(starts), np.int32, at, end), "letters": _parts(letters, np.int32, at, end), "labels": _parts(label, np.int8, at, end)})
    for kind, row in [(-1, total), *enumerate(held)]:
        at = np.flatnonzero(row)
        if len(at):
            yield pd.DataFrame({"kind": kind, "key": at, "n": row[at], "ids": None, "lengths": None, "letters": None, "labels": None})


def _written(b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_split`` gave of the records of a batch, per chunk."""
    every = {c: b[c].tolist() for c in ("ids", "lengths", "letters", "labels")}
    for lo, hi in chunks(every["ids"]):
        ids, n, letters = (np.frombuffer(b"".join(every[c][lo:hi]), np.int32).astype(np.int64) for c in ("ids", "lengths", "letters"))
        label = np.frombuffer(b"".join(every["labels"][lo:hi]), np.int8).astype(np.int64)
        starts = np.r_[0, np.cumsum(n)]
        record = np.repeat(np.arange(hi - lo), [len(x) for x in every["labels"][lo:hi]])
        size = np.bincount(record, weights=n, minlength=hi - lo).astype(np.int64)
        yield lo, ids, _pairs(ids, starts), starts, record, size, label, letters


class Model:
    """Log odds of each class against the background, by feature."""

    def __init__(self, total: np.ndarray, held: np.ndarray) -> None:
        back = np.maximum(total - held.sum(axis=0), 0.0) + 0.01
        self.odds = np.zeros((len(KINDS), len(total)))
        passages, rest = held[:, FEATURES:].sum(axis=1), back[FEATURES:].sum()
        self.prior = np.log((passages + 0.01) / rest)
        self.prior[passages < 1] = -np.inf
        for part in (slice(0, HALF), slice(HALF, FEATURES), slice(FEATURES, None)):
            law = (total[part] + 0.01) / (total[part] + 0.01).sum()
            p_back = back[part] / back[part].sum()
            for k in range(len(KINDS)):
                mass = max((SMOOTH[k] if part.stop else 0.01) * held[k, part].sum(), 1.0)
                odds = np.log((held[k, part] + mass * law) / (held[k, part].sum() + mass)) - np.log(p_back)
                if k == 0 and part.stop:  # only what is far more frequent than in prose speaks for a placeholder
                    odds = np.where(held[k, part] < OVER * law * held[k, part].sum(), np.minimum(odds, 0.0), odds)
                if part.stop:
                    odds[total[part] < RARE] = 0.0
                self.odds[k, part] = odds
        self.odds[:, HALF:FEATURES] *= 0.5  # pairs repeat what their words say
        # A passage without a slot: how much rarer that is in a class than outside (slots are the one feature whose absence is told).
        at = _IDS[_SLOT_WORD]
        without = (passages - held[:, at] + 1.0) / (passages + 2.0)
        self.absent = np.log(np.clip(without, 1e-9, 1.0)) - np.log(max((rest - back[at] + 1.0) / (rest + 2.0), 1e-9))
        self.odds = self.odds.astype(np.float32)

    def scores(self, ids: np.ndarray, starts: np.ndarray, pairs: np.ndarray, pair_starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Log odds of every passage, classes by column."""
        out = np.empty((len(starts) - 1, len(KINDS)))
        slot = np.maximum.reduceat(ids == _IDS[_SLOT_WORD], starts[:-1]) if len(starts) > 1 else np.zeros(0, bool)
        for k, odds in enumerate(self.odds):
            out[:, k] = np.add.reduceat(odds[ids], starts[:-1], dtype=np.float64) + np.add.reduceat(odds[pairs], pair_starts[:-1], dtype=np.float64)
            out[:, k] += odds[FEATURES + bucket] + self.prior[k] + np.where(slot, 0.0, self.absent[k])
        return out


def _posterior(odds: np.ndarray) -> np.ndarray:
    if not len(odds):
        return odds
    top = np.maximum(odds.max(axis=1, keepdims=True), 0.0)
    e = np.exp(odds - top)
    return e / (e.sum(axis=1, keepdims=True) + np.exp(-top))


def _table(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bounded: at most (classes + 1) x (FEATURES + length buckets) sums reach the driver."""
    total = np.zeros(FEATURES + len(LENGTHS) + 1)
    held = np.zeros((len(KINDS), len(total)))
    sums = counted.groupBy("kind", "feature").agg(F.sum("n").alias("n")).toPandas()
    for kind in range(-1, len(KINDS)):
        part = sums[sums["kind"] == kind]
        (total if kind < 0 else held[kind])[part["feature"].to_numpy()] = part["n"].to_numpy()
    return total, held


#: Kind of the rows of ``READ`` that are records, with their doc_id as key; all others are counts of features.
WRITTEN = -2
READ = "kind int, key long, n double, ids binary, lengths binary, letters binary, labels binary"
ACTIVE = "doc_id long, bucket int, size long, lengths array<int>, sizes array<int>, pair_sizes array<int>, labels array<int>, ids array<int>, pairs array<int>"


def passages(documents: DataFrame) -> tuple[DataFrame, Model]:
    """Passages of the corpus that may be residue (``ACTIVE``), and the model after the last round."""
    spark = documents.sparkSession
    sc = spark.sparkContext
    corpus = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    folder = fresh_folder(spark, "residue")
    corpus.mapInPandas(_read, READ).write.option("compression", "zstd").parquet(f"{folder}/read")
    read = spark.read.schema(READ).parquet(f"{folder}/read")
    total, held = _table(read.where(F.col("kind") != WRITTEN).select("kind", F.col("key").alias("feature"), "n"))
    model = Model(total, held)

    def keep(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
        now: Model = shared.value
        for b in batches:
            doc = b["doc_id"].to_numpy()
            for lo, ids, pairs, starts, record, size, label, letters in _written(b):
                bucket = np.searchsorted(LENGTHS, size[record])
                odds = now.scores(ids, starts, pairs, starts, bucket)
                # Runs without blanks are no words, and the same lines again and again are no message.
                n = np.diff(starts)
                whole = np.bincount(record, weights=letters, minlength=len(size))
                no_text = (letters > DENSE * n) & (whole > DENSE * size)[record] & (label == -1)
                for p in np.flatnonzero((n >= LONG_PASSAGE) & ~no_text & (label == -1) & (odds[:, 2:].max(axis=1) > KEEP)):
                    no_text[p] = len(np.unique(ids[starts[p] : starts[p + 1]])) < REPEATED * n[p]
                slot = np.maximum.reduceat(ids == _IDS[_SLOT_WORD], starts[:-1])
                kept = np.where(no_text, (odds[:, 0] > 0) & slot | (odds[:, 1] > 0), (odds.max(axis=1) > KEEP) | (size[record] <= SIGN_WORDS))
                rows = []
                for d in np.unique(record[kept]):
                    lo_p, hi_p = np.searchsorted(record, [d, d + 1])
                    at = [p for p in range(lo_p, hi_p) if kept[p]]
                    w = [np.unique(ids[starts[p] : starts[p + 1]]) for p in at]  # a feature speaks once in a passage
                    v = [np.unique(pairs[starts[p] : starts[p + 1]]) for p in at]
                    rows.append((doc[lo + d], bucket[at[0]], size[d], n[at], [len(x) for x in w], [len(x) for x in v], label[at], np.concatenate(w), np.concatenate(v)))
                yield pd.DataFrame(rows, columns=["doc_id", "bucket", "size", "lengths", "sizes", "pair_sizes", "labels", "ids", "pairs"])

    first = sc.broadcast(model)  # FEATURES x classes numbers
    records = read.where(F.col("kind") == WRITTEN).select(F.col("key").alias("doc_id"), "ids", "lengths", "letters", "labels")
    active = cut(records.mapInPandas(lambda it: keep(it, first), ACTIVE))
    drop_folder(spark, folder)
    for _ in range(ROUNDS):
        shared = sc.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(KINDS), FEATURES + len(LENGTHS) + 1))
            for b in batches:
                if not len(b):
                    continue
                ids, starts, pairs, pair_starts, bucket, _ = _flat(b)
                p = _judge(shared.value, b)
                p[p < DOUBT] = 0.0
                for k in range(len(KINDS)):
                    sums[k, :HALF] += np.bincount(ids, np.repeat(p[:, k], np.diff(starts)), HALF)
                    sums[k, HALF:FEATURES] += np.bincount(pairs - HALF, np.repeat(p[:, k], np.diff(pair_starts)), HALF)
                    sums[k, FEATURES:] += np.bincount(bucket, p[:, k], len(LENGTHS) + 1)
            for k in range(len(KINDS)):
                at = np.flatnonzero(sums[k] > 1e-3)
                if len(at):
                    yield pd.DataFrame({"kind": k, "feature": at, "n": sums[k, at]})

        _, held = _table(active.mapInPandas(expect, "kind int, feature long, n double"))
        model = Model(total, held)
    return active, model


def _flat(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Of a batch of ``ACTIVE`` rows: ids, their passage starts, pair ids, theirs, and bucket and record of each passage."""
    per = np.array([len(x) for x in b["sizes"]])
    starts, pair_starts = (np.r_[0, np.cumsum(np.concatenate(b[c].to_numpy()))] for c in ("sizes", "pair_sizes"))
    ids, pairs = (np.concatenate(b[c].to_numpy()).astype(np.int64) for c in ("ids", "pairs"))
    return ids, starts, pairs, pair_starts, np.repeat(b["bucket"].to_numpy(), per), np.repeat(np.arange(len(b)), per)


def _judge(model: Model, b: pd.DataFrame, final: bool = False) -> np.ndarray:
    """Posterior of every passage: the model's odds, then what the record's other passages add to them.

    While the model learns, passages with a sign are known for their class; in the ``final`` decision they are scored as all others.
    """
    *features, record = _flat(b)
    label = np.concatenate(b["labels"].to_numpy())
    sure = (label >= 0) & (not final)
    odds = model.scores(*features)
    trusted = np.full(len(b), -1)
    trusted[record[sure]] = label[sure]
    other = (trusted[record] >= 0)[:, None] & (trusted[record][:, None] != np.arange(len(KINDS)))
    odds[other] = -np.inf  # a record that is trusted for one kind speaks for no other
    # A record that is residue for the most part is of one of these kinds: the one that all its passages together speak for.
    alone = np.zeros((len(b), len(KINDS)))
    np.add.at(alone, record, np.maximum(odds, 0.0))
    lengths = np.concatenate(b["lengths"].to_numpy())
    mostly = np.bincount(record, np.where(odds.max(axis=1) > 0, lengths, 0), len(b)) * 2 >= b["size"].to_numpy()
    lesser = mostly[record][:, None] & (alone[record] < alone[record][:, 1:].max(axis=1, keepdims=True))
    lesser[:, 0] = False
    odds[lesser] = -np.inf
    p = _posterior(odds)
    p[sure] = np.eye(len(KINDS))[label[sure]]
    for _ in range(2):
        likely = np.where(p >= 0.5, p, 0.0)
        whole = np.zeros((len(b), len(KINDS)))
        np.add.at(whole, record, likely)
        p = _posterior(odds + np.log1p(COHERE * np.maximum(whole[record] - likely, 0.0)))
        p[sure] = np.eye(len(KINDS))[label[sure]]
    return p


def residue(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, residue_kind, score: a record is residue of a kind if any of its passages is."""
    active, model = passages(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = _judge(shared.value, b, final=True)
                row, kind = np.nonzero(p >= least)
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[_flat(b)[5][row]], "residue_kind": np.array(KINDS)[kind], "score": p[row, kind]})

    found = active.mapInPandas(decide, "doc_id long, residue_kind string, score double")
    return found.groupBy("doc_id", "residue_kind").agg(F.max("score").alias("score"))


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that hold no residue."""
    return documents.join(residue(documents).select("doc_id").distinct(), "doc_id", "left_anti")
