"""Prose rules. Pattern rules are column expressions; sentence rules work on sentences split by an Arrow UDF.

The word lists are this project's own choice and are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

# Patterns that need no look-around, so that any SQL engine can run them.
PATTERNS = {
    "contraction": r"\b(?:can't|won't|don't|doesn't|isn't|aren't|it's|that's|you're|we're|they're|i'm|couldn't|shouldn't|wouldn't|hasn't|haven't|didn't|wasn't|weren't|let's|there's)\b",
    "latin": r"\b(?:e\.g\.|i\.e\.|etc\.|viz\.|cf\.|et al\.)",
    "phrasal": r"\b(?:set up|carry out|find out|look up|make up|point out|turn on|turn off|log on|figure out|back up|holds up)\b",
    "gender": r"\b(?:he|she|him|her|his|hers|himself|herself)\b",
    "semicolon": r";",
}
# Section, weight (3 error, 2 warning, 1 information) and unit of each rule. Sections weigh alike.
RULES = {
    "length": ("sentences", 3.0, "sentences"), "contraction": ("sentences", 2.0, "words"), "passive": ("verbs", 2.0, "sentences"), "tense": ("verbs", 2.0, "sentences"),
    "cluster": ("nouns", 2.0, "sentences"), "paragraph": ("descriptive", 2.0, "paragraphs"), "warning": ("safety", 2.0, "sentences"), "semicolon": ("punctuation", 2.0, "sentences"),
    "latin": ("practices", 2.0, "words"), "phrasal": ("practices", 1.0, "words"), "gender": ("practices", 1.0, "words"),
}
# Openings of a safety sentence and what names its consequence.
SAFETY = r"^(?:warning|caution|danger)\b"
CONSEQUENCE = r"\b(?:can|could|may|will|cause[sd]?|result|damage|injur|death|loss|fail)"
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "fig.", "no.", "approx.", "min.", "max.", "dr.", "mr.", "ms.", "cf.", "viz.")
# Most words of a sentence by mode, sentences of a paragraph, nouns in a row.
PROCEDURAL, DESCRIPTIVE, PARAGRAPH, CLUSTER = 20, 25, 6, 3
IMPERATIVE = ("set", "use", "open", "close", "start", "stop", "check", "connect", "remove", "install", "reset", "repair", "read", "press", "turn", "wait", "replace", "select", "bypass", "edit", "move", "save")
BE = ("is", "are", "was", "were", "be", "been", "being")
HAVE = ("has", "have", "had")
FUNCTION_WORDS = ("the", "a", "an", "of", "to", "in", "on", "at", "by", "for", "with", "and", "or", "but", "if", "when", "because", "so", "that", "this", "these", "those", "not", "does", "do", "can", "may", "must", "is", "are", "was", "were", "be", "it", "its", "as", "before", "after", "until", "while", "each", "every", "one", "other", "from", "than", "then", "you", "we", "they")


def pattern_count(text: Column, rule: str) -> Column:
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(PATTERNS[rule]))


def pattern_counts(documents: DataFrame) -> DataFrame:
    """doc_id and one count per pattern rule."""
    return documents.select("doc_id", *[pattern_count(F.col("text"), r).cast("long").alias(r) for r in PATTERNS])


def _split(text: str | None) -> list[dict]:
    out: list[dict] = []
    for k, paragraph in enumerate(re.split(r"\n\s*\n", text or "")):
        body = re.sub(r"```.*?```", " ", paragraph, flags=re.S)
        body = re.sub(r"\s+", " ", re.sub(r"^#+ .*$", " ", body, flags=re.M)).strip()
        start = 0
        for m in re.finditer(r"[.!?]+[\"')\]]*(?=\s|$)", body):
            piece = body[start : m.end()].strip()
            if piece.lower().endswith(ABBREVIATIONS) and m.end() < len(body):
                continue
            if piece:
                out.append({"paragraph": k, "sentence": piece})
            start = m.end()
        if body[start:].strip():
            out.append({"paragraph": k, "sentence": body[start:].strip()})
    return out


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, paragraph, no, sentence. Fenced code and headings are left out, abbreviations do not end a sentence."""
    @F.pandas_udf("array<struct<paragraph:int,sentence:string>>")
    def split(column: pd.Series) -> pd.Series:
        return column.map(_split)

    return documents.select(key, F.posexplode(split(text)).alias("no", "s")).select(key, F.col("s.paragraph").alias("paragraph"), "no", F.col("s.sentence").alias("sentence"))


def word_count(sentence: Column) -> Column:
    """Words, a quoted span and a number with its unit counting as one."""
    s = F.regexp_replace(sentence, r"\"[^\"]*\"", "Q")
    s = F.regexp_replace(s, r"(\d+(?:\.\d+)?) (percent|seconds?|minutes?|hours?|degrees|meters?|watts|mm|cm|kg|ms|gb|mb|kb)\b", "$1$2")
    return F.size(F.regexp_extract_all(s, F.lit(r"([^\s]*[\p{L}\p{N}][^\s]*)"), 1))


def sentence_rules(rows: DataFrame) -> DataFrame:
    """Sentences with words, mode and the flags length, passive, tense, cluster."""
    tokens = T.words(F.col("sentence"))
    mode = F.when(F.try_element_at(tokens, F.lit(1)).isin(*IMPERATIVE), "procedural").otherwise("descriptive")
    limit = F.when(F.col("mode") == "procedural", PROCEDURAL).otherwise(DESCRIPTIVE)
    be, have = F.array(*map(F.lit, BE)), F.array(*map(F.lit, HAVE))
    ahead = lambda t, i, hit: F.exists(F.slice(t, i + 2, F.lit(3)), hit)
    passive = F.exists(F.transform(F.col("t"), lambda w, i: F.array_contains(be, w) & ahead(F.col("t"), i, lambda x: x.rlike("(ed|en)$"))), lambda b: b)
    tense = F.exists(F.transform(F.col("t"), lambda w, i: (F.array_contains(have, w) & ahead(F.col("t"), i, lambda x: x.rlike("(ed|en)$"))) | (F.array_contains(be, w) & F.exists(F.slice(F.col("t"), i + 2, F.lit(1)), lambda x: x.rlike("ing$")))), lambda b: b)
    # Runs of words that are no function words and no verbs by their ending, as islands in one fold.
    noun = lambda w: ~F.array_contains(F.array(*map(F.lit, FUNCTION_WORDS)), w) & ~w.rlike(r"(ed|ing|es|ly|s)$|\d")
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    step = lambda a, w: F.struct(F.when(noun(w), a["run"] + 1).otherwise(0).alias("run"), F.greatest(a["best"], F.when(noun(w), a["run"] + 1).otherwise(0)).alias("best"))
    cluster = F.aggregate(F.col("t"), start, step, lambda a: a["best"]) > CLUSTER
    out = rows.withColumn("t", tokens).withColumn("mode", F.coalesce(mode, F.lit("descriptive"))).withColumn("words", word_count(F.col("sentence")))
    return out.select(*rows.columns, "mode", "words", (F.col("words") > limit).alias("length"), passive.alias("passive"), tense.alias("tense"), cluster.alias("cluster"))


def _profile(text: str | None) -> tuple[int, ...]:
    """Sentences, words, paragraphs, then violations of each rule, of one text."""
    rows = _split(text)
    counts = dict.fromkeys(RULES, 0)
    per: dict[int, int] = {}
    words = 0
    for row in rows:
        s = row["sentence"]
        low = s.lower()
        tokens = _TOKENS(low)
        n = len(_SPANS(_UNITED.sub(r"\1\2", _QUOTED.sub("Q", s))))
        words += n
        per[row["paragraph"]] = per.get(row["paragraph"], 0) + 1
        counts["length"] += n > (PROCEDURAL if tokens and tokens[0] in _IMPERATIVE else DESCRIPTIVE)
        passive = tense = False
        run = best = 0
        for i, w in enumerate(tokens):
            if w in _BE:
                passive = passive or any(x.endswith(("ed", "en")) for x in tokens[i + 1 : i + 4])
                tense = tense or tokens[i + 1 : i + 2] != [] and tokens[i + 1].endswith("ing")
            elif w in _HAVE:
                tense = tense or any(x.endswith(("ed", "en")) for x in tokens[i + 1 : i + 4])
            run = 0 if w in _FUNCTION or _NO_NOUN(w) else run + 1
            best = max(best, run)
        counts["passive"] += passive
        counts["tense"] += tense
        counts["cluster"] += best > CLUSTER
        counts["semicolon"] += ";" in s
        counts["warning"] += bool(_SAFETY(low)) and not _CONSEQUENCE(low)
    counts["paragraph"] = sum(n > PARAGRAPH for n in per.values())
    low = (text or "").lower()
    for rule in ("contraction", "latin", "phrasal", "gender"):
        counts[rule] = sum(1 for _ in _PATTERNS[rule].finditer(low))
    return (len(rows), words, len(per), *counts.values())


_TOKENS = re.compile(r"[^\W_]+").findall
_QUOTED = re.compile(r'"[^"]*"')
_UNITED = re.compile(r"(\d+(?:\.\d+)?) (percent|seconds?|minutes?|hours?|degrees|meters?|watts|mm|cm|kg|ms|gb|mb|kb)\b")
_SPANS = re.compile(r"\S*[^\W_]\S*").findall
_NO_NOUN = re.compile(r"(?:ed|ing|es|ly|s)$|\d").search
_SAFETY, _CONSEQUENCE = re.compile(SAFETY).search, re.compile(CONSEQUENCE).search
_PATTERNS = {k: re.compile(v) for k, v in PATTERNS.items()}
_IMPERATIVE, _BE, _HAVE, _FUNCTION = map(frozenset, (IMPERATIVE, BE, HAVE, FUNCTION_WORDS))


def profiles(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentences, words, paragraphs and the violations of every rule: one pass over the texts, one row each, no shuffle."""
    kind = dict(documents.dtypes)[key]
    columns = ["sentences", "words", "paragraphs", *RULES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([_profile(t) for t in b["t"]], columns=columns)
            found.insert(0, key, b["k"].to_numpy())
            yield found

    rows = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{c} long" for c in columns))


def section_penalty(section: str, rules: dict[str, tuple[str, float, str]] = RULES) -> Column:
    """Weighted mean over all rules of a section of min(1, violations / units of the rule)."""
    own = {r: (w, unit) for r, (s, w, unit) in rules.items() if s == section}
    density = [F.lit(w) * F.least(F.lit(1.0), F.col(r) / F.greatest(F.lit(1), F.col(unit))) for r, (w, unit) in own.items()]
    return sum(density[1:], density[0]) / sum(w for w, _ in own.values())


def scores(documents: DataFrame, rules: dict[str, tuple[str, float, str]] = RULES, section_weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, sentences, violations, score and a score per section: 100 less the mean penalty of the sections, halves to even.

    A rule of weight 0 is left out; sections weigh 1 unless told otherwise. Texts without a sentence have none of its rows.
    """
    rules = {r: v for r, v in rules.items() if v[1]}
    sections = list(dict.fromkeys(s for s, _, _ in rules.values()))
    weight = {s: (section_weights or {}).get(s, 1.0) for s in sections}
    rows = profiles(documents).where("sentences > 0").withColumns({f"_{s}": section_penalty(s, rules) for s in sections})
    mean = sum((F.col(f"_{s}") * weight[s] for s in sections), F.lit(0.0)) / (sum(weight.values()) or 1.0)
    total = sum((F.col(r) for r in rules), F.lit(0))
    grade = lambda x: F.bround(100 * (1 - x)).cast("int")
    return rows.select("doc_id", "sentences", total.alias("violations"), grade(mean).alias("score"), *[grade(F.col(f"_{s}")).alias(f"{s}_score") for s in sections])


def below(documents: DataFrame, least: int) -> DataFrame:
    """Documents under a least score, worst first."""
    return scores(documents).where(F.col("score") < least).select("doc_id", "score").orderBy("score", "doc_id")
