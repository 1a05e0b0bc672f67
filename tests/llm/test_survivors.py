"""Survivors of duplicate groups."""

from __future__ import annotations

import datetime as dt

from quern.llm import survivors

PARTS = "part_id long, part_key string, document_key string, root_name string, scanned_at timestamp, has_front_matter int, text_chars long, title string, pages int, source_pdf string, body string, rank int, value string"
DAY = dt.datetime(2026, 1, 1)


def part(i, key, doc, root="low", day=0, front=0, chars=10, title=None, pages=None, pdf=None, body=None):
    return (i, key, doc, root, DAY + dt.timedelta(days=day), front, chars, title, pages, pdf, body, 1, "clash")


def frames(spark, rows):
    return spark.createDataFrame(rows, PARTS), spark.createDataFrame([("low", 0), ("high", 3)], "root_name string, root_rank int")


def chosen(spark, rows, **more):
    return {(r["document_key"], r["field_name"]): r["part_id"] for r in survivors.chosen(*frames(spark, rows), **more).collect()}


def test_ranked_order(spark):
    rows = [
        part(1, "low:a", "d", body="text one", title="Right", pages=3),
        part(2, "high:b", "d", root=" HIGH", title="N/A", pages=0, body="  ", pdf="x.pdf"),
        part(3, "low:c", "d", front=1, title="untitled-2", body="two", pages=-1),
        part(4, "low:c", "d", day=5, front=None, chars=None, body="newer look"),
    ]
    assert chosen(spark, rows) == {("d", "text"): 1, ("d", "title"): 1, ("d", "pages"): 1, ("d", "source_pdf"): 2}


def test_ties_end_at_the_lowest_id(spark):
    rows = [part(i, f"low:{i}", "d", body="same") for i in (7, 5, 6)]
    assert chosen(spark, rows) == {("d", "text"): 5}


def test_single_files_and_null_keys_form_no_group(spark):
    rows = [part(1, "low:a", "d", body="x"), part(1, "low:a", "d", body="x"), part(2, "low:b", None, body="x"), part(3, "low:c", None, body="x")]
    assert chosen(spark, rows) == {}


def test_votes_prefer_trust_and_agreement(spark):
    rows = [part(1, "low:a", "d", title="Old name"), part(2, "low:b", "d", title="New Name"), part(3, "low:c", "d", title="new  name")]
    assert chosen(spark, rows, policy="votes")[("d", "title")] in (2, 3)
    rows.append(part(4, "high:d", "d", root="high", title="Old name"))
    assert chosen(spark, rows, policy="votes")[("d", "title")] == 4


def test_survivors_and_marks(spark):
    rows = [part(1, "low:a", "d", body="t " * 50_000, pages=4), part(2, "low:b", "d", title="T"), part(3, "low:c", "e", body="alone")]
    parts, roots = frames(spark, rows)
    wide = {r["document_key"]: r for r in survivors.survivors(parts, roots).collect()}
    assert len(wide["d"]["text"]) == 100_000 and wide["d"]["title"] == "T" and wide["d"]["pages"] == 4 and wide["d"]["source_pdf"] is None
    marks = {r["part_id"]: (r["is_winner"], r["duplicate_of"]) for r in survivors.marks(parts, roots).collect()}
    assert marks == {1: (1, None), 2: (0, "low:a"), 3: (1, None)}


def test_empty(spark):
    parts, roots = frames(spark, [])
    assert survivors.chosen(parts, roots).count() == 0 and survivors.chosen(parts, roots, "votes").count() == 0
    assert survivors.survivors(parts, roots).count() == 0 and survivors.marks(parts, roots).count() == 0
