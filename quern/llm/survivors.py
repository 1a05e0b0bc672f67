"""One surviving record per group of duplicate records, field by field.

The newest look at each file is taken first. Its fields are unpivoted to long rows (group, field, value), so
that one grouped aggregation decides every field of every group at once, combining before the shuffle:
however many files a group has, no task gathers them. Two policies share the plan:

* ``votes``: per normalised value, trust of the root times recency decay is summed; max_by picks the value.
* ``ranked``: max_by picks the row that comes first in a fixed order of trust (root, front matter, length,
  age, arrival). A sum of votes cannot say a strict order, so this policy compares the parts of the order
  in turn instead of adding them.

Defined results: a null group key forms no group; stand-ins for "no value" count as none; a field without
any usable value has no row in ``chosen`` and is null in ``survivors``; ties end at the lowest part_id;
null roots rank last, other nulls as 0 or oldest; repeated rows change nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.runtime import cut, salted_join

FIELDS = ("text", "title", "pages", "source_pdf")
HALF_LIFE_DAYS = 90.0

# What stands in for "no value", letters only.
STAND_INS = (
    "", "na", "nan", "nil", "none", "null", "unknown", "unnamed", "untitled", "tbd", "tba", "todo", "notitle", "noname", "novalue", "missing",
    "undefined", "notavailable", "notapplicable", "notset", "empty", "blank", "placeholder", "tobedetermined", "tobedefined",
)


def folded(name: Column) -> Column:
    """One spelling per root: case, blanks around and underscores fold."""
    return F.regexp_replace(F.lower(F.trim(name)), "[_\\s]+", "-")


def has_value(text: Column) -> Column:
    """True if a text is not null, blank or a stand-in."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
    stem = F.regexp_replace(bare, r"\p{N}+$", "")
    return F.coalesce((bare != "") & ((stem == "") | ~stem.isin(*STAND_INS)), F.lit(False))


def newest(parts: DataFrame, roots: DataFrame) -> DataFrame:
    """The newest row of every (document_key, part_key), with its rank and which fields it can give."""
    own = ["part_id", "root_name", "scanned_at", "has_front_matter", "text_chars", "title", "pages", "source_pdf", "body"]
    light = parts.where("document_key is not null").select(
        "document_key", "part_key",
        F.struct("scanned_at", "part_id").alias("at"),
        F.struct(
            "part_id", folded(F.col("root_name")).alias("root"), "scanned_at", F.coalesce("has_front_matter", F.lit(0)).alias("front"), F.coalesce("text_chars", F.lit(0)).alias("chars"),
            F.when(has_value(F.col("title")), F.trim("title")).alias("title"), F.when(F.col("pages") > 0, F.col("pages")).alias("pages"),
            F.when(has_value(F.col("source_pdf")), F.trim("source_pdf")).alias("source_pdf"),
            # Of the body only whether it has a word and what its words are: texts stay out of the shuffle.
            F.when(F.col("body").rlike(r"[\p{L}\p{N}]"), F.xxhash64(F.regexp_replace(F.lower("body"), r"[^\p{L}\p{N}]+", " "))).alias("text"),
        ).alias("row"),
    )
    rank = roots.groupBy(folded(F.col("root_name")).alias("root")).agg(F.max("root_rank").alias("root_rank"))
    return light.groupBy("document_key", "part_key").agg(F.max_by("row", "at").alias("row")).select("document_key", "part_key", "row.*").join(rank, "root", "left").select(
        "*", F.struct(F.coalesce("root_rank", F.lit(-(2**31))).alias("r"), "front", "chars", "scanned_at", (-F.col("part_id")).alias("p")).alias("rank")
    )


def unpivoted(rows: DataFrame) -> DataFrame:
    """document_key, part_id, rank, field_name, value: one row per file and field; value null where it has none."""
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in FIELDS])
    return rows.select("document_key", "part_id", "rank", "root_rank", "scanned_at", F.explode(fields).alias("f")).select("document_key", "part_id", "rank", "root_rank", "scanned_at", "f.*")


def chosen(parts: DataFrame, roots: DataFrame, policy: str = "ranked", least_files: int = 2) -> DataFrame:
    """document_key, field_name, part_id of the file that each field is taken from, in groups of ``least_files`` files or more."""
    long = unpivoted(newest(parts, roots))
    usable = F.col("value").isNotNull()
    if policy == "ranked":
        one = long.groupBy("document_key", "field_name").agg(F.count("*").alias("files"), F.max_by("part_id", F.when(usable, F.col("rank"))).alias("part_id"))
    elif policy == "votes":
        now = long.agg(F.max("scanned_at")).first()[0]
        age = F.coalesce((F.lit(now).cast("timestamp").cast("double") - F.col("scanned_at").cast("double")) / 86400.0, F.lit(3650.0))
        vote = (F.coalesce(F.greatest("root_rank", F.lit(0)), F.lit(0)) + 1.0) * F.exp(-age * F.lit(0.6931471805599453 / HALF_LIFE_DAYS))
        value = F.when(usable, F.regexp_replace(F.lower("value"), r"[^\p{L}\p{N}]+", " "))
        votes = long.groupBy("document_key", "field_name", value.alias("norm")).agg(
            F.count("*").alias("n"), F.sum(vote).alias("votes"), F.max_by("part_id", "rank").alias("part_id"), F.max("rank").alias("rank")
        )
        best = F.when(F.col("norm").isNotNull(), F.struct("votes", "rank"))
        one = votes.groupBy("document_key", "field_name").agg(F.sum("n").alias("files"), F.max_by("part_id", best).alias("part_id"))
    else:
        raise ValueError(policy)
    return one.where((F.col("files") >= least_files) & F.col("part_id").isNotNull()).select("document_key", "field_name", "part_id")


def survivors(parts: DataFrame, roots: DataFrame, policy: str = "votes") -> DataFrame:
    """One row per document_key with the value of each field and the part it came from; texts whole."""
    picked = chosen(parts, roots, policy, least_files=1)
    # The choice is pivoted before any value is fetched, so bodies are shuffled once and only beside the part they belong to.
    wide = picked.groupBy("document_key").pivot("field_name", list(FIELDS)).agg(F.first("part_id"))
    wide = cut(wide.select("document_key", *[F.col(f).alias(f"{f}_from") for f in FIELDS]))
    light = parts.where("document_key is not null").groupBy("part_id").agg(F.max(F.struct(F.trim("title").alias("title"), "pages", F.trim("source_pdf").alias("source_pdf"))).alias("v"))
    held = picked.where("field_name <> 'text'").join(light, "part_id")
    values = held.groupBy("document_key").agg(*[F.max(F.when(F.col("field_name") == f, F.col(f"v.{f}"))).alias(f) for f in FIELDS[1:]])
    texts = parts.where("document_key is not null and body is not null").groupBy("part_id").agg(F.first("body").alias("text")).withColumnRenamed("part_id", "text_from")
    return wide.join(texts, "text_from", "left").join(values, "document_key", "left").select("document_key", *FIELDS, *[f"{f}_from" for f in FIELDS])


def marks(parts: DataFrame, roots: DataFrame) -> DataFrame:
    """Fresh part_id, document_key, is_winner and duplicate_of (part_key of the winner) for the newest row of every file.

    The winner of a group is the file its text is taken from, or its first file where none has a text.
    """
    rows = newest(parts, roots)
    best = F.struct(F.col("text").isNotNull().alias("t"), "rank")
    winner = rows.groupBy("document_key").agg(F.max_by("part_key", best).alias("winner_key"), F.max_by("part_id", best).alias("winner"))
    joined = salted_join(rows.select("document_key", "part_key", "part_id"), winner, "document_key", "part_id")
    wins = F.col("part_id") == F.col("winner")
    return joined.select("part_id", "document_key", wins.cast("int").alias("is_winner"), F.when(~wins, F.col("winner_key")).alias("duplicate_of"))
