"""Text statistics and types."""

from __future__ import annotations

import random

from quern.llm import quality

SCHEMA = "doc_id long, text string, votes string, word string"
PROSE = "When the first valve closes the other pump starts, and the operator must read every gauge before the next step. "


def corpus():
    rng = random.Random(1)
    nouns = "valve pump gauge filter motor sensor panel cable switch relay".split()
    rows = {}
    for i in range(60):
        rows[i] = ("prose", "\n\n".join(PROSE * rng.randint(2, 4) for _ in range(3)))
    for i in range(60, 80):
        rows[i] = ("list", "\n".join(f"- the {rng.choice(nouns)} of the {rng.choice(nouns)}" for _ in range(20)))
    for i in range(80, 100):
        rows[i] = ("table", "\n".join("\t".join(rng.choice(nouns) if rng.random() < 0.5 else str(rng.randint(1, 999)) for _ in range(4)) for _ in range(20)))
    for i in range(100, 110):
        rows[i] = ("junk", " ".join("".join(rng.choice("bcdfghklmnpqrst") for _ in range(rng.randint(2, 9))) for _ in range(150)))
    for i in range(110, 120):
        rows[i] = ("junk", "\n".join(["Internal use only for staff", "Rev C of the manual"] * 15))
    return rows


def test_types(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "v", "w") for i, (_, t) in rows.items()], SCHEMA)
    found = {r["doc_id"]: r["text_class"] for r in quality.text_types(df).collect()}
    wrong = {i: (found[i], kind) for i, (kind, _) in rows.items() if found[i] != kind}
    assert len(wrong) <= 2, wrong


def test_statistics(spark):
    df = spark.createDataFrame([(1, "one two\nrow  wide\nrow  wide\nrow  wide\nend here.", "v", "w")], SCHEMA)
    r = quality.statistics(df).first()
    assert r["word_count"] == 10 and r["line_count"] == 5
    assert abs(r["repeated_line_ratio"] - 3 / 4) < 1e-9  # "one two" is under eight characters
    assert abs(r["structured_ratio"] - 3 / 5) < 1e-9
    assert abs(r["end_punctuation_share"] - 1 / 5) < 1e-9


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "- a\n" * 30, "v", "w"), (1, None, "v", "w"), (2, "", "v", "w"), (3, " \n\t", "v", "w"), (4, "long " * 100_000, "v", "w"), (4, "long " * 100_000, "v", "w")], SCHEMA)
    types = {r["doc_id"]: r["text_class"] for r in quality.text_types(df).collect()}
    assert types[1] == types[2] == types[3] == "empty"
    assert None not in {r["doc_id"] for r in quality.not_prose(df).collect()}
    assert quality.not_prose(df.limit(0)).count() == 0
    assert quality.text_types(df.limit(0)).count() == 0


def test_short_texts_have_a_type(spark):
    rows = {i: t for i, (_, t) in corpus().items()}
    rows |= {
        200: "- the valve\n- the pump\n- the gauge\n- the filter\n- the motor", 201: "- the valve\n- the pump",
        202: "valve\t12\npump\t7\ngauge\t9", 203: "Internal use only for staff\n" * 3,
        204: PROSE, 205: "1) the valve of the pump\n2) the gauge of the motor\n3) the relay",
    }
    df = spark.createDataFrame([(i, t, "v", "w") for i, t in rows.items()], SCHEMA)
    found = {r["doc_id"]: r["text_class"] for r in quality.text_types(df).collect()}
    assert [found[i] for i in range(200, 206)] == ["list", "list", "table", "junk", "prose", "list"]


def test_every_pattern_of_votes_has_a_posterior(spark):
    df = spark.createDataFrame([(i, t, "v", "w") for i, (_, t) in corpus().items()], SCHEMA)
    assert "empty" not in {r["text_class"] for r in quality.text_types(df).collect()}
