"""Mixtures of sources."""

from __future__ import annotations

import random

from quern.llm import mixing

DOCS = "doc_id long, text string, source string, tokens long, bucket int"
MIX = "source string, target_share double, max_repeats int"


def frames(spark):
    rng = random.Random(8)
    docs = [(i, "word " * rng.randint(5, 60), "big" if i < 300 else " Small_One" if i < 330 else "tiny" if i < 333 else None, 1, 1) for i in range(340)]
    docs += [(400, None, "big", 1, 1), (401, "", "big", 1, 1), (None, "lost", "big", 1, 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([("big", 0.5, 1), ("small-one", 0.3, 3), ("tiny", 0.1, 2), ("absent", 0.1, 4)], MIX)


def test_shares_and_budgets(spark):
    docs, mix = frames(spark)
    chosen, report = mixing.mixture(docs, mix, total_tokens=6000)
    rows = {r["source"]: r for r in report.collect()}
    picked = chosen.collect()
    assert abs(rows["big"]["tokens"] - 3000) <= 70 and rows["big"]["tokens"] <= 3000
    assert abs(rows["small-one"]["tokens"] - 1800) <= 70
    assert rows["tiny"]["repeats"] == 2 and rows["tiny"]["tokens"] < 600
    assert rows["absent"]["tokens"] == 0 and rows["absent"]["documents"] == 0
    assert abs(sum(r["actual_share"] for r in rows.values()) - 1) < 1e-9
    for name, r in rows.items():
        own = [x for x in picked if x["source"] == name]
        assert sum(x["tokens"] * x["copies"] for x in own) == r["tokens"]
        assert all(x["copies"] <= r["max_repeats"] for x in own)


def test_same_choice_on_any_partitioning(spark):
    docs, mix = frames(spark)
    a = {tuple(r) for r in mixing.mixture(docs, mix, 5000)[0].collect()}
    b = {tuple(r) for r in mixing.mixture(docs.repartition(7), mix, 5000)[0].collect()}
    assert a == b and a


def test_empty(spark):
    docs, mix = frames(spark)
    assert [r["tokens"] for r in mixing.mixture(docs.limit(0), mix)[1].collect()] == [0, 0, 0, 0]
    assert mixing.mixture(docs, mix.limit(0))[1].count() == 0
