"""Noise of scanned pages: detection on a made corpus with known noise, repair, and odd rows."""

from __future__ import annotations

import random

from quern.llm import scanned

SCHEMA = "packet_id long, document_key string, source_segment string, page_range string, a string, kind string"
WORDS = "the controller window receives every signal before another journal releases random storage while primary channel monitors regular network traffic and common buffer returns modern record across global circuit".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(12)).capitalize() + "."


def wrapped(text, width=50):
    out, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*out, line]


def corpus(n=160):
    rng = random.Random(4)
    rows, truth = [], set()
    for i in range(n):
        lines = wrapped(" ".join(sentence(rng) for _ in range(6)))
        if i % 4 == 0:
            at = next(k for k, x in enumerate(lines[:-1]) if len(x.split()[-1]) > 5 and x[-1].isalpha())
            first, last = lines[at].rsplit(" ", 1)
            lines[at], lines[at + 1] = f"{first} {last[:3]}-", f"{last[3:]} {lines[at + 1]}"
            truth.add((i, "hyphen"))
        if i % 4 == 1:
            true, read = rng.choice([("journal", "joumal"), ("random", "rand0m"), ("storage", "st0rage"), ("window", "wind0w"), ("circuit", "circiiit"), ("signal", "signa1"), ("modern", "modem"), ("buffer", "buffcr")])
            done = " ".join(lines).replace(f" {true} ", f" {read} ", 1)
            if done != " ".join(lines):
                truth.add((i, "glyph"))
                lines = wrapped(done)
        if i % 4 == 2:
            lines.insert(3, f"Tarek F{100 + i} Field Manual")
            truth.add((i, "header"))
        if i % 4 == 3:
            lines.insert(4, f"- {10 + i % 7} -")
            truth.add((i, "page_number"))
        rows.append((i, f"manuals-tarek-f{100 + i}-field-manual", "\n".join(lines), "10-20", "x", "y"))
    return rows, truth


def test_noise_is_found(spark):
    rows, truth = corpus()
    found = {tuple(r) for r in scanned.noise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found & truth) / len(truth) > 0.97
    assert len(found & truth) / len(found) > 0.97


def test_repair_gives_paragraphs(spark):
    rows, _ = corpus(40)
    fixed = {r[0]: r[1] for r in scanned.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(fixed) == 40
    assert "-\n" not in fixed[0] and "\n" not in fixed[0]
    assert "Tarek F102 Field Manual" not in fixed[2]
    assert "- 13 -" not in fixed[3]


def test_what_stays():
    text = "## Head line\n\nThe round-\nrobin rule works.\n\n```\nset window 12\n39\n```\n\n| a | b |\n<!-- page 3 -->\nmore text."
    found = [{"noise_kind": "glyph", "n": -1, "a": "w0rks", "b": "works"}]
    assert scanned._repair(text, found) == "## Head line\n\nThe round-robin rule works.\n\n```\nset window 12\n39\n```\n\n| a | b |\n<!-- page 3 -->\nmore text."


def test_page_number_notations():
    for line in ("39", "[39]", "- 39 -", "Page 39", "Page 3 of 9", "18 | P a g e", "xii", "p. 7", "Seite 4"):
        assert scanned.page_number(line), line
    for line in ("39 watts", "Set 39", "version 3.9R4 x", "fb-3/1/2"):
        assert not scanned.page_number(line), line


def test_odd_rows(spark):
    long = "word " * 40_000 + "x" * 5000
    rows = [(None, "k", "a joumal", "1", "a", "b"), (1, None, None, None, None, None), (2, None, "", "?", "a", "b"), (3, "k", "   \n ", "9-1", "a", "b"), (4, "k", long, "", "a", "b"), (4, "k", long, "", "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert scanned.noise(df).count() == 0
    assert {r[0]: r[1] for r in scanned.repair(df).collect()}[2] == ""
    assert scanned.noise(df.limit(0)).count() == 0


def test_misreading_costs():
    assert scanned.misreading("joumal", "journal")[0] < 0.5
    assert scanned.misreading("deaclline", "deadline")[0] < 0.5
    assert scanned.misreading("paper", "power")[0] >= 1


def test_no_cap_on_words_and_lines():
    from quern.llm.scanned import kinds_of, running

    long = "x".join(["valve"] * 20)
    words, _, _ = running([f"the {long} closes"], ["text"], set())
    assert long in words
    lines = ["- - - - - - - - - - - - - - page 12 of 40 - - - - - - - - - - - - - -", "1234567", "the pump closes 7 valves of the second relay", "xiv"]
    assert kinds_of(lines) == ["number", "number", "text", "number"]


def test_candidates_do_not_depend_on_the_way_of_the_join(spark, monkeypatch):
    from quern.llm import scanned

    rows = [(w, n, True) for w, n in (("closed", 9), ("loaded", 8), ("c1osed", 1), ("loadcd", 1), ("folded", 7), ("fo1ded", 2), ("valve", 5), ("va1ve", 1))]
    words = spark.createDataFrame(rows, "word string, packets long, spoken boolean")
    got = sorted(map(str, scanned.candidates(words).collect()))
    monkeypatch.setattr(scanned, "INDEX_ROWS", 1)
    monkeypatch.setattr(scanned, "LONG_LIST", 1)
    assert got and sorted(map(str, scanned.candidates(words).collect())) == got
