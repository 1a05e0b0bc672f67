"""Leaks of evaluation passages, in both ways of finding hits."""

from __future__ import annotations

import random

import pytest

from quern.llm import leakage

DOCS = "doc_id long, text string, mask int, item string"
ITEMS = "item_id long, passage string, text string"


@pytest.mark.parametrize("held", [leakage.HELD_WINDOWS, 0])
def test_leaks(spark, held):
    rng = random.Random(6)
    v = [f"w{k}" for k in range(500)]
    passages = [[rng.choice(v) for _ in range(40)] for _ in range(6)]
    docs, truth, near = [], set(), set()
    for d in range(60):
        body = [rng.choice(v) for _ in range(80)]
        if d % 3 == 0:
            p, n = rng.randrange(6), rng.choice((12, 13, 20))
            at = rng.randrange(40 - n)
            body[10:10] = passages[p][at : at + n]
            if n >= 13:
                truth.add((d, p))
        elif d % 3 == 1:
            p = rng.randrange(6)
            part = list(passages[p])
            part[5] = part[16] = part[27] = "other"  # runs of 10 at most
            body[20:20] = part
            near.add((d, p))
        docs.append((d, " ".join(body), 1, "x"))
    items = [(i, ", ".join(p).upper(), "t") for i, p in enumerate(passages)]
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    rows = leakage.overlaps(a, b, held).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["run"] >= 13} == truth
    tolerant = {(r["doc_id"], r["item_id"]): (r["matched"], r["substituted"]) for r in rows}
    assert all(tolerant[k] == (37, 3) for k in near)


def test_odd_rows(spark):
    words = " ".join(f"a{k}" for k in range(13))
    docs = [(1, None, 1, ""), (2, "", 1, ""), (None, words, 1, ""), (3, "x " * 100_000 + words, 1, ""), (3, "x " * 100_000 + words, 1, ""), (4, words[:-1], 1, "")]
    items = [(1, words, ""), (2, words, ""), (2, words, ""), (3, None, ""), (None, words, ""), (4, "short one", "")]
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert sorted(tuple(r) for r in leakage.leaks(a, b).collect()) == [(3, 1), (3, 2)]
    assert leakage.leaks(a, b.limit(0)).count() == 0 and leakage.leaks(a.limit(0), b).count() == 0


def test_masks_cover_every_position():
    ignored = set()
    for m in leakage.MASKS:
        ignored |= set(range(leakage.SPAN)) - set(m)
    assert ignored == set(range(leakage.SPAN))
