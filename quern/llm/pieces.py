"""Splitting oversized segments at natural boundaries, all greedy cuts at once.

A segment is a chain of units with boundaries of a level: blank line, line break, space, none. Finer
boundaries exist only inside units that are too long for the coarser level. Every boundary is joined to its
farthest legal successor by a range window over blocks of the segment no longer than two pieces, so one
huge segment is many small windows. The successor tables are then squared: from the table that jumps one
cut and the set of cuts reached, each round doubles both, and a segment of n pieces needs log2(n) rounds.

Defined results: segments up to the limit, null, empty and blank ones are one piece or none (``found`` leaves
them out); a null packet_id gives no row; repeated rows of one packet count once; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import cut

LIMIT = 3000
OVERLAP = 200
LEVELS = ("blank_line", "line_break", "space", "none")

#: Unit: [start, end) of text, the start of the next unit and the level of the boundary between; level -1 ends the segment.
UNITS = "packet_id long, start int, end int, next int, level int, size int"
_MARK = re.compile(r"<!--\s*page\s+(\d{1,6})\s*-->")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_LINE = re.compile(r"[^\S\n]*\n[^\S\n]*")
_SPACE = re.compile(r"\s+")
_PARTS = (_BLANK, _LINE, _SPACE)


def units(text: str, unit: int) -> list[tuple[int, int, int, int]]:
    """(start, end, next, level) of the units of a text, none longer than ``unit``."""
    first = len(text) - len(text.lstrip())
    last = len(text.rstrip())
    if first >= last:
        return []
    out: list[tuple[int, int, int, int]] = []

    def split(lo: int, hi: int, level: int, after: int, after_level: int) -> None:
        # [lo, hi) is one stretch of the level above; ``after`` and ``after_level`` say what follows it.
        if hi - lo <= unit:
            out.append((lo, hi, after, after_level))
            return
        if level == len(_PARTS):
            for at in range(lo, hi, unit):
                end = min(at + unit, hi)
                out.append((at, end, end if end < hi else after, 3 if end < hi else after_level))
            return
        at = lo
        for m in _PARTS[level].finditer(text, lo, hi):
            if m.start() > at:
                split(at, m.start(), level + 1, m.end(), level)
            at = max(at, m.end())
        if at < hi:
            split(at, hi, level + 1, after, after_level)

    split(first, last, 0, last, -1)
    return out


def _explode(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pid, text in zip(b["packet_id"].tolist(), b["source_segment"].tolist(), strict=True):
                if text and len(text) > limit:
                    out += [(pid, *u, len(text)) for u in units(text, limit - overlap)]
            yield pd.DataFrame(out, columns=["packet_id", "start", "end", "next", "level", "size"])

    return run


def boundaries(packets: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The units (``UNITS``) of every segment above the limit."""
    rows = packets.where("packet_id is not null and source_segment is not null").select(F.col("packet_id").cast("long").alias("packet_id"), F.col("source_segment").cast("string").alias("source_segment"))
    return rows.dropDuplicates(["packet_id"]).mapInPandas(_explode(limit, overlap), UNITS)


def successors(unit_rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """packet_id, at (start of a piece), end, next (start of the piece after), level of the cut.

    Of the ends within reach the coarsest level wins, then the farthest. The end of the segment is coarsest.
    Every start looks back from the end of its reach for the last end of each level: one running pass over
    boundaries in order. A reach lies within its block and the one before, so each end stands in two blocks.
    """
    reach = limit - overlap
    block = F.floor(F.col("pos") / reach).cast("int")
    ends = unit_rows.select("packet_id", F.col("end").alias("pos"), F.lit(0).alias("asks"), F.lit(None).cast("int").alias("at"), "level", F.struct("end", "next").alias("cut"))
    asks = unit_rows.select("packet_id", (F.col("start") + reach).alias("pos"), F.lit(1).alias("asks"), F.col("start").alias("at"), F.lit(None).cast("int").alias("level"), F.lit(None).cast(ends.schema["cut"].dataType).alias("cut"))
    rows = ends.withColumn("block", F.explode(F.array(block, block + 1))).unionByName(asks.withColumn("block", block))
    so_far = Window.partitionBy("packet_id", "block").orderBy("pos", "asks").rowsBetween(Window.unboundedPreceding, 0)
    levels = range(-1, len(LEVELS))
    for k in levels:
        rows = rows.withColumn(f"last{k + 1}", F.last(F.when(F.col("level") == k, F.col("cut")), ignorenulls=True).over(so_far))
    best = F.coalesce(*[F.when(F.col(f"last{k + 1}.end") > F.col("at"), F.struct(F.lit(k).alias("level"), f"last{k + 1}.end", f"last{k + 1}.next")) for k in levels])
    return rows.where("asks = 1").select("packet_id", "at", best.alias("b")).select("packet_id", "at", "b.end", "b.next", "b.level")


def cuts(packets: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every segment above the limit: packet_id, at, end, level (-1: the segment ends)."""
    rows = cut(boundaries(packets, limit, overlap))
    step = cut(successors(rows, limit, overlap))
    jump = step.where("level >= 0").select("packet_id", "at", F.col("next").alias("to"))
    reached = rows.groupBy("packet_id").agg(F.min("start").alias("at"))
    longest = rows.agg(F.max("size")).first()[0] or 0
    # A piece and the one after it together exceed the reach, unless a coarser boundary cut the first short;
    # so the rounds run until no jump is left rather than for a number derived from the length.
    while longest:
        far = cut(reached.join(jump, ["packet_id", "at"]).select("packet_id", F.col("to").alias("at")))
        reached = cut(reached.unionByName(far))
        hop = jump.select("packet_id", F.col("at").alias("to"), F.col("to").alias("then"))
        jump = cut(jump.join(hop, ["packet_id", "to"]).select("packet_id", "at", F.col("then").alias("to")))
        if jump.isEmpty():
            break
    return step.join(reached, ["packet_id", "at"], "left_semi").select("packet_id", "at", "end", "level")


def found(packets: DataFrame) -> DataFrame:
    """packet_id and the finest level that the cuts of its segment had to use, for segments above the limit."""
    level = F.greatest(F.max("level"), F.lit(0))
    name = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1)
    return cuts(packets).groupBy("packet_id").agg(name.alias("coarsest_cut"))


def _numbers(page_range: str | None) -> tuple[int | None, int | None]:
    """Lowest and highest page of any notation: 7, 7-9, 9-7, p. 7, 7–9, 7 to 9, [7..9]."""
    n = [int(x) for x in re.findall(r"\d{1,6}", page_range or "")][:2]
    return (min(n), max(n)) if n else (None, None)


class _Marks:
    """Page markers of one text, found once."""

    def __init__(self, text: str) -> None:
        found = [(m.start(), int(m.group(1))) for m in _MARK.finditer(text)]
        self.places, self.pages = [p for p, _ in found], [n for _, n in found]

    def between(self, at: int, end: int, low: int | None, pages: int | None) -> str | None:
        """Pages that [at, end) of the text stands on: the marker before it or the range's first page, to the last marker in it."""
        i, j = bisect_left(self.places, at), bisect_left(self.places, end)
        start = self.pages[i - 1] if i else low if low is not None else self.pages[0] - 1 if self.pages else None
        if i < j and self.places[i] == at:
            start = self.pages[i]
        stop = self.pages[j - 1] if i < j else start
        if start is None:
            return None
        start, stop = max(start, 1), max(stop or start, 1)
        if pages and pages > 0:
            start, stop = min(start, pages), min(stop, pages)
        return str(start) if start >= stop else f"{start}-{stop}"


def pieces(packets: DataFrame, documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """packet_id, piece_no, start, end, page_range, piece_text; every piece but the first begins ``overlap`` characters early.

    Segments up to the limit are one piece. Joining the texts without their overlaps, with the blanks between
    end and the next start, gives the segment again.
    """
    top = documents.where("document_key is not null and pages > 0").groupBy("document_key").agg(F.max("pages").alias("pages"))
    spans = cuts(packets, limit, overlap).groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("spans"))
    base = packets.where("packet_id is not null and source_segment is not null").select(F.col("packet_id").cast("long").alias("packet_id"), "document_key", "page_range", "source_segment").dropDuplicates(["packet_id"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pid, text, pr, pages, held in zip(b["packet_id"], b["source_segment"], b["page_range"], b["pages"], b["spans"], strict=True):
                low, _ = _numbers(pr)
                top_page = None if pages is None or pages != pages else int(pages)
                whole = [(x["at"], x["end"]) for x in held] if held is not None else [(0, len(text))] if text.strip() else []
                marks = _Marks(text)
                for k, (at, end) in enumerate(whole):
                    early = max(at - overlap, 0) if k else at
                    out.append((pid, k + 1, early, end, marks.between(at, end, low, top_page), text[early:end]))
            yield pd.DataFrame(out, columns=["packet_id", "piece_no", "start", "end", "page_range", "piece_text"])

    ready = base.join(spans, "packet_id", "left").join(top, "document_key", "left").select("packet_id", "source_segment", "page_range", "pages", "spans")
    return ready.mapInPandas(write, "packet_id long, piece_no int, start int, end int, page_range string, piece_text string")
