"""Further rules and repairs on Markdown texts: warnings, dictionary, links, fences, more fact types, package checks."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import structure

#: Largest segment that a package may hold, in bytes.
LIMIT_BYTES = 12_288
LINK = r"\[[^\]\n]*\]\(([^)\s]+)\)"


def warnings_without_consequence(sentences: DataFrame) -> DataFrame:
    """Sentences that open with Warning, Caution or Danger and name no consequence."""
    low = F.lower("sentence")
    return sentences.where(low.rlike(r"^(?:warning|caution|danger)\b") & ~low.rlike(r"\b(?:can|could|may|will|cause[sd]?|result|damage|injur|death|loss|fail)"))


def unapproved_words(sentences: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, no, word, alternatives: words of which every dictionary entry (word, approved, alternatives) is unapproved.

    Without entries nothing is found. The dictionary is a bounded table; Catalyst broadcasts it below its threshold.
    """
    bad = dictionary.groupBy(F.lower("word").alias("word")).agg(F.max(F.col("approved").cast("int")).alias("ok"), F.min("alternatives").alias("alternatives")).where("ok = 0").drop("ok")
    return sentences.select(key, "no", F.explode(F.array_distinct(T.words(F.col("sentence")))).alias("word")).join(bad, "word").select(key, "no", "word", "alternatives")


def links(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, target, file, anchor of every relative Markdown link outside fences; web and mail addresses are left out."""
    rows = structure.annotated(texts, key, text).where(~F.col("fenced")).select(key, F.explode(F.regexp_extract_all("line", F.lit(LINK), 1)).alias("target"))
    rows = rows.where(~F.col("target").rlike(r"^[a-zA-Z][\w+.-]*:"))
    return rows.select(key, "target", F.regexp_extract("target", r"^([^#]*)", 1).alias("file"), F.regexp_extract("target", r"#(.*)$", 1).alias("anchor"))


def broken_links(found: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """key, target, reason: the linked text or the anchor in it does not exist. ``anchors`` has key and anchor; a missing file comes first."""
    have = anchors.select(F.col(key).cast("string").alias("file")).distinct().withColumn("there", F.lit(True))
    target = F.when(F.col("file") == "", F.col(key).cast("string")).otherwise(F.col("file"))
    j = found.withColumn("file", target).join(have, "file", "left")
    spots = anchors.select(F.col(key).cast("string").alias("file"), "anchor").distinct().withColumn("spot", F.lit(True))
    j = j.join(spots, ["file", "anchor"], "left")
    reason = F.when(F.col("there").isNull(), "no file").when((F.col("anchor") != "") & F.col("spot").isNull(), "no anchor")
    return j.select(key, "target", reason.alias("reason")).where("reason is not null")


def fence_leaks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line: prose inside command fences: a capital, five words or more and a full stop."""
    rows = structure.annotated(texts, key, text)
    return rows.where(F.col("fenced") & F.col("line").rlike(r"^[A-Z][a-z]+(?: \S+){4,}[.]$")).select(key, "line_no", "line")


def unfenced_commands(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line, fence: lines outside fences that read as commands, and whether the run of them is worth a fence (two or more)."""
    rows = structure.annotated(texts, key, text).where(~F.col("fenced"))
    is_command = F.regexp_extract("line", r"^(\w+)", 1).isin(*T.COMMANDS) & ~F.col("line").rlike(r"[.,;:]|\b(?:the|a|an|of|to|if)\b")
    rows = rows.withColumn("hit", is_command)
    run = F.col("line_no") - F.row_number().over(Window.partitionBy(key, "hit").orderBy("line_no"))
    rows = rows.withColumn("run", run).where("hit")
    return rows.withColumn("fence", F.count("*").over(Window.partitionBy(key, "run")) > 1).select(key, "line_no", "line", "fence")


def typed_facts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, kind, fact: configuration (name = value, name: value), definition (X is a ...), prerequisite (before you ...), platform release."""
    rows = structure.annotated(texts, key, text).where(~F.col("is_heading"))
    line = T.stripped(F.col("line"))
    kind = (
        F.when(~F.col("fenced") & line.rlike(r"^[A-Z][\w -]{2,40} (?:is|are) (?:a|an|the) \w+"), "definition")
        .when(~F.col("fenced") & line.rlike(r"(?i)\bbefore you \w+"), "prerequisite")
        .when(line.rlike(r"^[\w.-]{2,40}\s*(?:=|:)\s*\S+$"), "configuration")
        .when(~F.col("fenced") & line.rlike(r"(?i)\b(?:release|version) \d+(?:\.\d+)+"), "platform_release")
        .when(F.col("fenced") & line.rlike(r"^\S.*\s{2,}\S"), "output_field")
    )
    return rows.select(key, "line_no", kind.alias("kind"), line.alias("fact")).where("kind is not null")


def drop_cover_art(texts: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """key and the text without a leading run of ``least`` or more heading lines that have nothing between them."""
    run = F.length(F.regexp_extract(text, r"^((?:#[^\n]*\n\s*)+)", 1))
    n = F.size(F.filter(F.split(F.substring(F.col(text), F.lit(1), run), "\n"), lambda x: x.startswith("#")))
    body = F.regexp_replace(text, r"^(?:#[^\n]*\n\s*)+", "")
    return texts.select(key, F.when(n >= least, body).otherwise(F.col(text)).alias(text))


def package_findings(packets: DataFrame, cards: DataFrame, inputs: DataFrame) -> DataFrame:
    """check, subject: every violation of the rules for a package.

    size: segments above LIMIT_BYTES; citation: cards without one; mark: cards whose mark is none of the three;
    duplicate: cards whose fact stands on a lower card; orphan: cards of a path without input; zero: paths without cards.
    """
    mark = F.upper(F.regexp_replace(F.coalesce("mark", F.lit("")), "[^A-Za-z]", ""))
    text = lambda c: F.col(c).cast("string").alias("subject")
    first = cards.where("fact is not null").select("card_id", T.signal(F.col("fact")).alias("k"))
    low = first.groupBy("k").agg(F.min("card_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    paths, with_cards = inputs.where("generated_path is not null").select("generated_path").distinct(), cards.where("generated_path is not null").select("card_id", "generated_path")
    parts = [
        packets.where(F.octet_length("source_segment") > LIMIT_BYTES).select(F.lit("size").alias("check"), text("packet_id")),
        cards.where(F.coalesce(F.trim("citation_key"), F.lit("")) == "").select(F.lit("citation").alias("check"), text("card_id")),
        cards.where(~mark.isin("MUST", "SHOULD", "INFO")).select(F.lit("mark").alias("check"), text("card_id")),
        first.join(low, "k").where("card_id > low").select(F.lit("duplicate").alias("check"), text("card_id")),
        with_cards.join(paths, "generated_path", "left_anti").select(F.lit("orphan").alias("check"), text("card_id")),
        paths.join(with_cards, "generated_path", "left_anti").select(F.lit("zero").alias("check"), text("generated_path")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def python_prose(modules: DataFrame) -> DataFrame:
    """path, line, kind, text of the docstrings, comments and log messages of Python modules, for the prose rules."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, source in zip(b["path"], b["source"], strict=True):
                try:
                    tree = ast.parse(source or "")
                    tokens = list(tokenize.generate_tokens(io.StringIO(source or "").readline))
                except (SyntaxError, ValueError, tokenize.TokenError):
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(n):
                        out.append((path, n.body[0].lineno, "docstring", ast.get_docstring(n)))
                    elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("debug", "info", "warning", "error", "exception", "critical") and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str):
                        out.append((path, n.lineno, "log", n.args[0].value))
                out += [(path, t.start[0], "comment", re.sub(r"^#+\s*", "", t.string)) for t in tokens if t.type == tokenize.COMMENT]
            yield pd.DataFrame(out, columns=["path", "line", "kind", "text"])

    return modules.select("path", "source").mapInPandas(run, "path string, line int, kind string, text string")
