"""Source quality: ratios, their distribution, a calibrated threshold and the gate.

Statistics of one document are computed inside its row. Nothing global is gathered in one task: percentiles and
the largest gap are found over a fixed number of value ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.runtime import cut
from quern.sources.versioned import VersionedTable

# Limits of the gate.
MIN_TEXT_CHARS = 400
MIN_LETTERS = 80
REPEATED_LIMIT = 0.45
STRUCTURED_LIMIT = 0.70
FIXED_THRESHOLD = 0.08
BUCKETS = 10_000
#: Parts that a range of values is split into in one round.
SPLITS = 1024


def ratios(documents: DataFrame) -> DataFrame:
    """doc_id, letters, spaces, text_chars and the space, repeated-line and structured ratios of every document."""
    base = documents.select(
        "doc_id", T.letters(F.coalesce("text", F.lit(""))).alias("letters"), T.spaces(F.coalesce("text", F.lit(""))).alias("spaces"),
        T.solid_chars(F.coalesce("text", F.lit(""))).alias("text_chars"), T.lines(F.col("text")).alias("lines"),
    )
    # A line stands more than twice if it has two equal neighbours in the sorted lines: counted inside the row, nothing is shuffled.
    base = base.withColumn("long", F.array_sort(F.filter("lines", lambda x: F.length(x) >= 8)))
    s = F.col("long")
    thrice = F.filter(s, lambda x, i: (F.get(s, i + 2) == x) | (F.get(s, i - 2) == x) | ((F.get(s, i - 1) == x) & (F.get(s, i + 1) == x)))
    repeated = F.when(F.size("long") > 0, F.size(thrice) / F.size("long")).otherwise(0.0)
    structured = F.when(F.size("lines") > 0, F.size(F.filter("lines", T.is_structured)) / F.size("lines")).otherwise(0.0)
    return base.select(
        "doc_id", "letters", "spaces", "text_chars", F.when(F.col("letters") > 0, F.col("spaces") / F.col("letters")).otherwise(0.0).alias("space_ratio"),
        repeated.alias("repeated_line_ratio"), structured.alias("structured_ratio"),
    )


def calibrated_threshold(values: DataFrame, name: str) -> float:
    """Middle of the widest gap between adjacent values of which the lower is in [0.01, 0.14], within [0.035, 0.09].

    Of gaps of one width the one at the greater values wins; without a gap the pair (0.06, 0.10) stands. Only
    distinct values up to 0.14 and the first above are looked at.
    """
    v = values.select(F.col(name).cast("double").alias("v")).where("v >= 0.01 and not isnan(v)")
    above = v.where("v > 0.14").agg(F.min("v").alias("v")).where("v is not null")
    v = cut(v.where("v <= 0.14").distinct().unionByName(above).withColumn("b", F.floor(F.least("v", F.lit(0.15)) * BUCKETS)))
    edges = v.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # Between buckets: a window over at most 0.14 * BUCKETS rows. No gap inside a bucket is wider than a bucket.
    between = edges.select(F.col("hi").alias("lower"), F.lead("lo").over(Window.orderBy("b")).alias("upper"))
    inside = v.select(F.col("v").alias("lower"), F.lead("v").over(Window.partitionBy("b").orderBy("v")).alias("upper"))

    def widest(gaps: DataFrame):
        gaps = gaps.where("upper is not null and lower <= 0.14 and upper > lower")
        return gaps.select(F.max(F.struct((F.col("upper") - F.col("lower")).alias("gap"), "lower", "upper")).alias("g")).first()["g"]

    best = widest(between)
    if best is None or best["gap"] <= 2 / BUCKETS:
        best = widest(between.unionByName(inside))
    lower, upper = (best["lower"], best["upper"]) if best else (0.06, 0.10)
    return min(0.09, max(0.035, (lower + upper) / 2))


def percentiles(values: DataFrame, name: str, points: tuple[int, ...] = (0, 5, 25, 50, 75, 95, 100)) -> DataFrame:
    """point, value: nearest rank, round(p / 100 * (n - 1)) with halves to even, without interpolation. NaN is no value.

    Values are counted first. Then the range that holds a rank is split into SPLITS parts, round by round, until
    it is one value: each round is one pass over the counted values, and the bounds of a part are those of the
    values in it, so that an outlier costs one round and no task ever sorts what falls together.
    """
    spark = values.sparkSession
    v = cut(values.select(F.col(name).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count("*").alias("n")))
    whole = v.agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if whole["n"] is None:
        return spark.createDataFrame([], "point int, value double")
    found: dict[int, float] = {}
    open_: dict[int, tuple[float, float, int]] = {p: (whole["lo"], whole["hi"], round(p / 100 * (whole["n"] - 1))) for p in points}
    while True:
        for p, (lo, hi, _) in list(open_.items()):
            if lo == hi:
                found[p] = lo
                del open_[p]
        if not open_:
            return spark.createDataFrame([(p, found[p]) for p in points], "point int, value double")
        part = F.lit(None).cast("struct<lo:double,k:int>")
        for lo, hi in {(lo, hi) for lo, hi, _ in open_.values()}:  # ranges are equal or apart
            width = hi / 2 - lo / 2  # 0 for neighbours of the least size: then only the greatest is parted from the rest
            k = F.least(F.floor((F.col("v") / 2 - lo / 2) / width * SPLITS), F.lit(SPLITS - 1)).cast("int") if width else F.lit(0)
            part = F.when(F.col("v").between(lo, hi), F.struct(F.lit(lo).alias("lo"), F.when(F.col("v") == hi, SPLITS).otherwise(k).alias("k"))).otherwise(part)
        rows = v.withColumn("part", part).where("part is not null").groupBy("part").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # at most points x SPLITS rows
        rows.sort(key=lambda r: (r["part"]["lo"], r["part"]["k"]))
        for p, (lo, _, rank) in list(open_.items()):
            for r in rows:
                if r["part"]["lo"] == lo:
                    if rank < r["n"]:
                        open_[p] = (r["lo"], r["hi"], rank)
                        break
                    rank -= r["n"]


def status(threshold: Column) -> Column:
    """fail, review or pass, tested in this order."""
    low = F.col("space_ratio") < threshold
    return (
        F.when((F.col("text_chars") < MIN_TEXT_CHARS) | (F.col("letters") < MIN_LETTERS), "fail")
        .when(F.col("repeated_line_ratio") >= REPEATED_LIMIT, "fail")
        .when(low & (F.col("structured_ratio") < STRUCTURED_LIMIT), "fail")
        .when(low, "review")
        .otherwise("pass")
    )


# Reasons of the gate, in the order in which they are tested.
EMPTY = "almost no extractable text"
REPEATS = "text is mostly repeated headers or footers"
STRIPPED = "space-to-letter ratio indicates stripped spaces"
LOW = "low space ratio in mostly structured text"
PASSED = "source text passed quality checks"


def reason(threshold: Column) -> Column:
    """Why ``status`` is what it is."""
    low = F.col("space_ratio") < threshold
    return (
        F.when((F.col("text_chars") < MIN_TEXT_CHARS) | (F.col("letters") < MIN_LETTERS), EMPTY)
        .when(F.col("repeated_line_ratio") >= REPEATED_LIMIT, REPEATS)
        .when(low & (F.col("structured_ratio") < STRUCTURED_LIMIT), STRIPPED)
        .when(low, LOW)
        .otherwise(PASSED)
    )


def gate(documents: DataFrame, threshold: float | None = FIXED_THRESHOLD) -> DataFrame:
    """doc_id, status, score, blocked, reason for every document; ``threshold`` None calibrates it from the corpus first."""
    r = ratios(documents)
    if threshold is None:
        r = cut(r)
        threshold = calibrated_threshold(r, "space_ratio")
    cut_off = F.lit(float(threshold))
    st = status(cut_off)
    penalty = F.when(F.col("space_ratio") < cut_off, 45).otherwise(0) + F.when(F.col("text_chars") < MIN_TEXT_CHARS, 35).otherwise(0) + (F.col("repeated_line_ratio") * 50).cast("int")
    score = F.when(st == "pass", 100).otherwise(F.greatest(F.lit(0), 100 - penalty))
    return r.select("doc_id", st.alias("status"), score.cast("int").alias("score"), (st != "pass").alias("blocked"), reason(cut_off).alias("reason"))


def quarantine(documents: DataFrame, table: VersionedTable, threshold: float | None = FIXED_THRESHOLD) -> int:
    """Keep every document that did not pass (review is blocked as well as fail), as a full refresh of ``table``."""
    return table.commit(gate(documents, threshold).where("blocked"), replace=True)


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n over the whole corpus: ``vocabulary`` without its documents, which is what sorts every text."""
    return documents.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(documents: DataFrame, least: int = 1) -> DataFrame:
    """word, n, documents over the whole corpus. Each row tells its own first of a word, so words are counted before the shuffle."""
    sorted_words = documents.select(F.array_sort(T.words(F.col("text"))).alias("w"))
    rows = sorted_words.select(F.posexplode("w").alias("i", "word"), "w").select("word", F.when((F.col("i") > 0) & (F.get("w", F.col("i") - 1) == F.col("word")), 0).otherwise(1).alias("first"))
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.sum("first").alias("documents")).where(F.col("n") >= least)
