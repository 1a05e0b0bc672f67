"""Splitting at natural boundaries."""

from __future__ import annotations

import random

from quern.llm import pieces

PACKETS = "packet_id long, document_key string, page_range string, source_segment string, at int, block int"
DOCS = "document_key string, pages int"


def chain(text, limit, overlap):
    """The greedy cuts of one text, one after another."""
    u = pieces.units(text, limit - overlap)
    at, out = u[0][0], []
    while True:
        best = min(((level, -end, nxt) for _, end, nxt, level in u if 0 < end - at <= limit - overlap))
        out.append((at, -best[1], best[0]))
        if best[0] < 0:
            return out
        at = best[2]


def random_text(rng):
    out = []
    for _ in range(rng.randint(5, 40)):
        out.append("x" * rng.randint(1, 90))
        out.append(rng.choice(["\n\n", "\n", " ", " ", "\n \n", ""]))
    return "".join(out)


def test_cuts_equal_the_sequential_chain(spark):
    rng = random.Random(3)
    texts = {i: random_text(rng) for i in range(60)}
    df = spark.createDataFrame([(i, "d", "1-9", t, 0, 0) for i, t in texts.items()], PACKETS)
    got: dict[int, list] = {}
    for r in pieces.cuts(df, 120, 20).collect():
        got.setdefault(r["packet_id"], []).append((r["at"], r["end"], r["level"]))
    for i, t in texts.items():
        if len(t) > 120:
            assert sorted(got[i]) == chain(t, 120, 20)


def test_pieces_round_trip(spark):
    rng = random.Random(5)
    texts = {i: random_text(rng).strip() or "x" for i in range(30)}
    df = spark.createDataFrame([(i, "d", "3-5", t, 0, 0) for i, t in texts.items()], PACKETS)
    rows: dict[int, list] = {}
    for r in pieces.pieces(df, spark.createDataFrame([("d", 4)], DOCS), 120, 20).collect():
        rows.setdefault(r["packet_id"], []).append(r)
    for i, t in texts.items():
        own, back, last = sorted(rows[i], key=lambda r: r["piece_no"]), "", 0
        for r in own:
            assert len(r["piece_text"]) <= 120 and t[r["start"] : r["end"]] == r["piece_text"]
            back += t[last : r["end"]]
            last = r["end"]
        assert back == t


def test_page_ranges(spark):
    text = "<!-- page 7 -->\n" + "a " * 900 + "\n\n<!-- page 8 -->\n\n" + "b " * 900
    df = spark.createDataFrame([(1, "d", "9-7", text, 0, 0)], PACKETS)
    own = sorted(pieces.pieces(df, spark.createDataFrame([("d", 20)], DOCS)).collect(), key=lambda r: r["piece_no"])
    assert [r["page_range"] for r in own] == ["7-8", "8"] or [r["page_range"] for r in own] == ["7", "8"]


def test_levels(spark):
    rows = [(1, "ab\n\n" * 1000), (2, "ab\n" * 1500), (3, "ab " * 1500), (4, "x" * 9000), (5, "short"), (6, None), (7, ""), (8, " " * 5000), (9, "ab\n\n" + "x" * 4000 + "\n\ncd"), (1, "ab\n\n" * 1000), (None, "y" * 4000)]
    df = spark.createDataFrame([(i, None, None, t, 0, 0) for i, t in rows], PACKETS)
    assert {tuple(r) for r in pieces.found(df).collect()} == {(1, "blank_line"), (2, "line_break"), (3, "space"), (4, "none"), (9, "none")}
    assert pieces.found(df.limit(0)).count() == 0
    assert pieces.pieces(df, spark.createDataFrame([], DOCS)).where("packet_id = 8").count() == 0
