"""Long exact spans."""

from __future__ import annotations

import random

from quern.llm import spans
from quern.llm.words import words

CARDS = "card_id long, fact string, generated_path string, h long, side string"
INPUTS = "input_id long, generated_path string, source_segments array<string>, pos int"


def frames(spark, cards, inputs):
    return spark.createDataFrame([(i, t, p, 1, "x") for i, t, p in cards], CARDS), spark.createDataFrame([(i, p, s, 1) for i, p, s in inputs], INPUTS)


def run(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = last[j] + 1
                best = max(best, now[j + 1])
        last = now
    return best


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    v = [f"w{k}" for k in range(30)]
    pool = [rng.choice(v) for _ in range(400)]
    cards = []
    for i in range(40):
        at, n = rng.randrange(350), rng.randint(8, 40)
        cards.append((i, " ".join([rng.choice(v) for _ in range(5)] + pool[at : at + n]).upper(), f"p{i % 5}"))
    inputs = [(i, f"p{i % 4}", [" ".join(pool[k : k + 60]) for k in range(i * 30, i * 30 + 90, 60)] + ["", None]) for i in range(8)]
    truth = {}
    for c, t, _ in cards:
        for i, _, segs in inputs:
            n = max(run(words(t), words(s)) for s in segs)
            if n >= 13:
                truth[(c, i)] = n
    got = {(r["card_id"], r["input_id"]): r["shared_words"] for r in spans.pairs(*frames(spark, cards, inputs)).collect()}
    assert got.keys() == truth.keys()
    assert all(n <= truth[k] < 2 * n for k, n in got.items())


def test_shares(spark):
    text = " ".join(f"a{k}" for k in range(20))
    cards = [(1, text + " own words here", "p"), (2, "nothing of it", "p"), (3, None, None), (3, None, None)]
    inputs = [(1, "p", [text]), (2, "p", [text]), (3, None, None), (4, None, ["x " * 20_000])]
    got = {(r["record_kind"], r["record"]): (r["words"], r["shared_words"], r["longest"]) for r in spans.shares(*frames(spark, cards, inputs)).collect()}
    assert got[("fact", "1")] == (23, 20, 13)
    assert got[("fact", "2")] == (3, 0, 0) and got[("fact", "3")] == (0, 0, 0)
    assert got[("generated_path", "p")] == (40, 40, 13)
    assert got[("generated_path", "#4")][1] == 0  # repeats within one record are not shared


def test_empty(spark):
    empty = frames(spark, [], [])
    assert spans.pairs(*empty).count() == 0 and spans.shares(*empty).count() == 0
