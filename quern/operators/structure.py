"""Lines of texts and what they belong to: pages, fences, sections, blocks, packed segments.

Windows here are partitioned by one text, whose lines stand in one row before; nothing larger is gathered.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

# Sizes of packed segments in bytes.
SOFT, HARD, TINY = 12_288, 20_480, 2_048


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line for every line of every text; null texts have none."""
    return texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def annotated(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``lines`` with page (last marker before or on the line), fenced and section (number of the heading above, 0 before)."""
    rows = lines(texts, key, text)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.regexp_extract("line", r"<!-- page (\d{1,6}) -->", 1)
    fence = F.col("line").startswith("```")
    opened = F.sum(fence.cast("int")).over(w)
    rows = rows.withColumn("page", F.last(F.when(mark != "", mark.cast("int")), ignorenulls=True).over(w)).withColumn("fenced", fence | (opened % 2 == 1))
    heading = ~F.col("fenced") & F.col("line").rlike(r"^#{1,6} \S")
    return rows.withColumn("is_heading", heading).withColumn("section", F.sum(heading.cast("int")).over(w))


def sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, title, anchor, lines, chars; repeated anchors of one text are numbered."""
    rows = annotated(texts, key, text)
    out = rows.groupBy(key, "section").agg(
        F.min(F.when(F.col("is_heading"), F.regexp_replace("line", r"^#{1,6} +", ""))).alias("title"), F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars")
    )
    slug = T.heading_slug(F.coalesce("title", F.lit("")))
    n = F.row_number().over(Window.partitionBy(key, slug).orderBy("section")) - 1
    return out.select(key, "section", "title", F.when(n > 0, F.concat_ws("-", slug, n.cast("string"))).otherwise(slug).alias("anchor"), "lines", "chars")


def packed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, piece, bytes, blocks: blocks between blank lines packed in order to SOFT bytes, small rests joined up to HARD.

    The packing is a sequential fold over the blocks of one text, hence an Arrow UDF per text.
    """

    @F.pandas_udf("array<struct<piece:int,bytes:int,blocks:int>>")
    def pack(column: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            out: list[list[int]] = []
            for block in (t or "").split("\n\n"):
                n = len(block.encode())
                if not block.strip():
                    continue
                if out and (out[-1][0] + n + 2 <= SOFT or (min(out[-1][0], n) < TINY and out[-1][0] + n + 2 <= HARD)):
                    out[-1][0] += n + 2
                    out[-1][1] += 1
                else:
                    out.append([n, 1])
            return [{"piece": i + 1, "bytes": b, "blocks": k} for i, (b, k) in enumerate(out)]

        return column.map(one)

    return texts.select(key, F.explode(pack(text)).alias("p")).select(key, "p.*")
