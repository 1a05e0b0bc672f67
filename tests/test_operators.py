"""Core operators on small fixtures."""

from __future__ import annotations

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import codeqa, extract, gates, graph, inventory, overlap, prose, quality, repair, structure
from quern.sources import readers
from quern.streaming import watcher


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_text_functions(spark):
    assert one(spark, " Héllo,  World 2! ", T.slug) == "h-llo-world-2"
    assert one(spark, "Set up: the _Pump_", T.heading_slug) == "set-up-the-_pump_"
    assert one(spark, "fooBarHTTPCode", T.camel_to_snake) == "foo_bar_http_code"
    assert one(spark, "a|b\n c", T.cell) == "a\\|b c"
    assert one(spark, "v 9.10 and 9.9.1", T.version_numbers) == [9, 10]
    assert one(spark, "none", T.version_numbers) is None
    assert one(spark, "Guide Release 2.4.x", T.family_key) == "guide"
    assert one(spark, "a\x00b\tc\x1f", T.control_positions) == [1, 5]
    assert one(spark, "one-two-three", lambda c: T.bounded_slug(c, 9)) == "one-two"
    assert one(spark, "9–7", T.page_bounds) == (7, 9)
    assert one(spark, None, T.words) == [] and one(spark, "12345", T.token_cost) == 2
    assert one(spark, "a b c", lambda c: T.ngrams(T.words(c), 2)) == ["a b", "b c"]


def test_percentiles_are_nearest_rank(spark):
    v = [0.5, 0.1, 0.9, 0.3, 0.7, 0.2, None]
    got = {r["point"]: r["value"] for r in quality.percentiles(spark.createDataFrame([(x,) for x in v], "v double"), "v").collect()}
    s = sorted(x for x in v if x is not None)
    assert got == {p: s[round(p / 100 * (len(s) - 1))] for p in (0, 5, 25, 50, 75, 95, 100)}
    assert quality.percentiles(spark.createDataFrame([], "v double"), "v").count() == 0
    v = [1e300, -1e300, float("nan"), *[0.0] * 50, *[k / 1e6 for k in range(200)], 5e-324]
    got = {r["point"]: r["value"] for r in quality.percentiles(spark.createDataFrame([(x,) for x in v], "v double"), "v").collect()}
    s = sorted(x for x in v if x == x)
    assert got == {p: s[round(p / 100 * (len(s) - 1))] for p in (0, 5, 25, 50, 75, 95, 100)}


def test_calibration(spark):
    df = lambda v: spark.createDataFrame([(x,) for x in v], "v double")
    assert abs(quality.calibrated_threshold(df([0.02, 0.03, 0.11, 0.12, 0.19]), "v") - 0.07) < 1e-9
    assert quality.calibrated_threshold(df([]), "v") == 0.08
    assert quality.calibrated_threshold(df([0.02, 0.021, 0.3]), "v") == 0.09
    assert quality.calibrated_threshold(df([0.015625, 0.03125, 0.046875]), "v") == 0.0390625  # equal gaps: the greater values


def test_gate(spark):
    rows = [(1, "word " * 200), (2, "x"), (3, "same line here\n" * 100), (4, "wordwordword" * 60), (5, None), (6, "set " + "a" * 500 + "\n" + "show " + "b" * 300)]
    got = {r["doc_id"]: (r["status"], r["score"]) for r in quality.gate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("pass", 100) and got[2][0] == "fail" and got[3][0] == "fail" and got[4] == ("fail", 55) and got[5][0] == "fail" and got[6][0] == "review"


def test_groups_and_versions(spark):
    parts = spark.createDataFrame(
        [(1, "r", "d/a-1.md", "T", 3, 5), (2, "R ", "d/a-2.md", None, 9, 5), (3, "r", "d/b.md", "", None, 1), (4, "r", "d/c-1.md", "C", 1, 1)],
        "part_id long, root_name string, relative_path string, title string, pages int, text_chars long",
    )
    got = {r["group_key"]: (r["method"], r["parts"], r["pages"], r["title"]) for r in inventory.part_groups(parts).collect()}
    assert got == {"a": ("split_set", 2, 9, "T"), "b": ("filename", 1, None, None), "c-1": ("filename", 1, 1, "C")}
    docs = spark.createDataFrame([("k1", "Guide 2.9", 5, 10), ("k2", "Guide Release 2.10", 4, 10), ("k3", "Other 1.0", 1, 1), ("k4", "Guide 2.10", 4, 10)], "document_key string, title string, pages int, text_chars long")
    fam = {r["document_key"]: r["is_current"] for r in inventory.version_families(docs).collect()}
    assert fam == {"k1": False, "k2": True, "k4": False}
    assert inventory.edition_families(docs).first()["members"] == 3


def test_sets_and_registers(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("z", 2), (None, 3)], "k string, v int")
    diff = gates.set_diff(a, b, ["k", "v"])
    assert {(r["k"], r["change"]) for r in diff.collect()} == {("x", "unchanged"), ("y", "removed"), ("z", "new"), (None, "unchanged")}
    assert gates.ratchet(diff).first()["exit_code"] == 1 and gates.ratchet(gates.set_diff(a, a, ["k"])).first()["exit_code"] == 0
    assert gates.ratchet(gates.set_diff(a.limit(0), a.limit(0), ["k"])).first()["exit_code"] == 2
    assert {(r["k"], r["drift"]) for r in gates.compare(a.where("k is not null"), spark.createDataFrame([("x", 2), ("w", 1)], "k string, v int"), "k", ["v"]).collect()} == {("x", "v"), ("y", "only_left"), ("w", "only_right")}


def test_references(spark):
    files = spark.createDataFrame([("a/b/c.md",), ("x/c.md",), ("d.md",)], "path string")
    cited = spark.createDataFrame([("b/c.md",), ("c.md",), ("d.md",), ("/c.md",), ("q.md",)], "citation string")
    got = {r["citation"]: r["status"] for r in gates.resolve_suffix(cited, files).collect()}
    assert got == {"b/c.md": "suffix", "c.md": "ambiguous", "d.md": "exact", "/c.md": "missing", "q.md": "missing"}
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    near = {r["stale"]: r["nearest"] for r in gates.nearest_names(names("parse_lin", "zzz", "parse_line"), names("parse_line", "parse_word")).collect()}
    assert near == {"parse_lin": "parse_line", "zzz": None}
    numbers = {r["name"]: r["number"] for r in gates.free_numbers(spark.createDataFrame([("b", 501)], "name string, number int"), names("a", "b", "c"), 500, 502).collect()}
    assert numbers == {"a": 500, "b": 501, "c": 502}
    with pytest.raises(ValueError):
        gates.free_numbers(spark.createDataFrame([("b", 501)], "name string, number int"), names("a", "b", "c", "d"), 500, 502)
    rng = random.Random(3)
    known, lost = ({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(40)} for _ in range(2))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    near = {r["stale"]: r["nearest"] for r in gates.nearest_names(names(*lost), names(*known)).collect()}
    best = {x: min((edits(x, y), y) for y in known) for x in lost - known}
    assert near == {x: y if d <= len(x) // 2 else None for x, (d, y) in best.items()}


def test_structure(spark):
    text = "# One\na\n<!-- page 4 -->\n```\n# not\n```\n# One\nb\n# One"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, t string")
    rows = structure.annotated(df, "k", "t").where("k = 1").orderBy("line_no").collect()
    assert [r["section"] for r in rows] == [1, 1, 1, 1, 1, 1, 2, 2, 3] and [r["page"] for r in rows][:3] == [None, None, 4]
    assert [r["anchor"] for r in structure.sections(df, "k", "t").where("k = 1").orderBy("section").collect()] == ["one", "one-1", "one-2"]
    big = "\n\n".join(["x" * 5000] * 6 + ["y" * 100])
    packed = structure.packed(spark.createDataFrame([(1, big)], "k long, t string"), "k", "t").collect()
    assert sum(r["blocks"] for r in packed) == 7 and all(r["bytes"] <= structure.HARD for r in packed)


def test_overlap(spark):
    words = [f"a{i}" for i in range(30)]
    cards = spark.createDataFrame([(1, "p", " ".join(words[:13])), (2, "p", " ".join(words[:12])), (3, "p", " ".join(words[:7])), (4, "q", " ".join(words)), (5, None, None)], "card_id long, generated_path string, fact string")
    inputs = spark.createDataFrame([(1, "p", ["x " + " ".join(words), None, ""]), (2, None, None)], "input_id long, generated_path string, source_segments array<string>")
    assert {r["card_id"]: (r["run"], r["band"]) for r in overlap.bands(cards, inputs).collect()} == {1: (13, "failed"), 2: (12, "warned"), 3: (0, "cleared"), 4: (0, "cleared"), 5: (0, "cleared")}


def test_prose(spark):
    text = "Set the valve, e.g. the big one, to 5 mm. The gauge was opened by the crew; it can't close!\n\n```\nset x.\n```\n# Title. Here"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    s = prose.sentences(df).orderBy("no").collect()
    assert [r["sentence"] for r in s] == ["Set the valve, e.g. the big one, to 5 mm.", "The gauge was opened by the crew; it can't close!"]
    r = {x["no"]: x for x in prose.sentence_rules(prose.sentences(df)).collect()}
    assert r[0]["mode"] == "procedural" and not r[0]["passive"] and r[1]["passive"]
    c = prose.pattern_counts(df).where("doc_id = 1").first()
    assert (c["contraction"], c["latin"], c["semicolon"]) == (1, 1, 1)
    # verbs: passive in one of two sentences; punctuation: one of two; contraction, latin: per word (18 of them); five sections are clean
    r = prose.scores(df).where("doc_id = 1").first()
    words = prose.profiles(df).where("doc_id = 1").first()["words"]
    penalty = (2 * (1 / words) / 5 + 0.25 + 0.5 + 2 * (1 / words) / 4) / 7
    assert r["score"] == round(100 * (1 - penalty)) and r["punctuation_score"] == 50 and r["verbs_score"] == 75 and r["nouns_score"] == 100
    long = prose.profiles(df).join(prose.sentence_rules(prose.sentences(df)).groupBy("doc_id").agg(*[F.sum(F.col(c).cast("int")).alias(f"{c}2") for c in ("length", "passive", "tense", "cluster")], F.sum("words").alias("words2")), "doc_id").first()
    assert all(long[c] == long[f"{c}2"] for c in ("length", "passive", "tense", "cluster", "words"))
    assert prose.sentence_rules(spark.createDataFrame([(1, 0, 0, "word " * 26)], "doc_id long, paragraph int, no int, sentence string")).first()["length"]


def test_extract(spark):
    text = "Wait 30 seconds. You must close it.\n```\nset x 1\nnote\n```\n| A | B |\n| - | - |\n| 1 | 2 |\n\n| C |\n| 9 |"
    df = spark.createDataFrame([(1, text), (2, None)], "k long, t string")
    assert [tuple(r) for r in extract.numeric_facts(df, "k", "t").collect()] == [(1, 30, "seconds")]
    assert [r["command"] for r in extract.commands(df, "k", "t").collect()] == ["set x 1"]
    assert [r["mark"] for r in extract.constraints(df, "k", "t").collect()] == ["MUST"]
    assert sorted((r["header"], r["value"]) for r in extract.table_cells(df, "k", "t").collect()) == [("A", "1"), ("B", "2"), ("C", "9")]
    docs = spark.createDataFrame([("a", "Upgrade Path of X", ""), ("b", "nothing", "monitoring"), ("c", None, None)], "document_key string, title string, category string")
    rules = spark.createDataFrame(extract.DOMAINS, "domain string, keyword string, priority int")
    got = {r["document_key"]: (r["domain"], r["confidence"]) for r in extract.classify(docs, rules, "document_key", [F.col("title"), F.col("category")]).collect()}
    assert got == {"a": ("upgrade", 1.0), "b": ("operations", 0.8), "c": ("general", 0.2)}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = {(r["start"], r["node"]): r["depth"] for r in graph.reachable(e, spark.createDataFrame([("a",)], "node string"), 5).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2}
    m = spark.createDataFrame([("m", "import os\ndef f():\n    from a.b import c\nfrom . import z"), ("bad", "def (")], "module string, source string")
    assert sorted(tuple(r) for r in graph.import_edges(m).collect()) == [("m", "a.b"), ("m", "os")]


def test_code_rules(spark):
    from quern.plans import flow_plans

    rows = {(r["path"], r["rule"]) for r in flow_plans._all_findings(spark).collect()}
    assert {("tests/test_a.py", x) for x in ("taut_literal_true", "weak_zero_assertions", "taut_variable_self_compare", "weak_pytest_raises_exception")} <= rows
    assert ("tests/test_a.py", "weak_is_not_none") not in rows  # suppressed on its line
    assert {("pkg/b.py", x) for x in ("STRUCT-PARAMS", "STRUCT-NESTING", "CONV-INPUT", "CONV-LOG-FSTRING", "CONV-NAME", "CONV-PATH", "ARCH-ALIAS")} <= rows
    assert {("pkg/a.py", "ARCH-STUB"), ("pkg/a.py", "ARCH-NAMING"), ("pkg/a.py", "ARCH-DELEGATE")} <= rows
    m = lambda s: spark.createDataFrame([("a", s)], "path string, source string")
    rules = lambda s: sorted(r["rule"] for r in codeqa.style_findings(m(s)).collect())
    assert rules("x = (1,  # note\n     2)\ny = 3  # note\n") == [] and rules("# head\nx = 1\ny = 2  # note\nz = 3  # note\n") == ["CONV-COMMENTS"]
    assert "CONV-MARKER" in rules("x = 1  # ... existing code ...\n") and rules("'doc'\n") == []
    names = {r["subject"]: r["severity"] for r in codeqa.style_findings(m("def compat_read(a): return 1 + a\ndef compatible(a): return 1 + a\ndef readHelper(a): return 1 + a\ndef my_pass_through(a): return 1 + a\nclass Proxy: x = 1\n")).where("rule = 'ARCH-NAMING'").collect()}
    assert names == {"compat_read": "medium", "readHelper": "low", "my_pass_through": "medium"}
    rows = [("a", "ARCH-STUB", "medium")] * 9 + [("a", "CONV-NAME", "low"), ("a", "ARCH-ALIAS", "high"), ("b", "STRUCT-LENGTH", "medium")]
    assert {tuple(r) for r in codeqa.scores(spark.createDataFrame(rows, "path string, rule string, severity string")).collect()} == {("a", 79, "C+"), ("b", 97, "A+")}
    assert codeqa.comment_coverage(m("x = 1  # a\ny = 2\nz = 3\n")).first()["percent"] == 33.3
    assert codeqa.same_code(m("def f():\n    'doc'\n    return 1"), m("# new\ndef f():\n    return 1")).first()["only_prose"]
    assert not codeqa.same_code(m("x = 1"), m("x = 2")).first()["only_prose"]


def test_repair(spark):
    counts = spark.createDataFrame([("the", 50), ("pump", 20), ("closes", 10)], "word string, n long")
    df = spark.createDataFrame([(1, "thepumpcloses"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["words"] for r in repair.segmented(df, counts, "doc_id", "text").collect()}
    assert got == {1: ["the", "pump", "closes"], 2: [], 3: []}
    schema = "region string, category string, id long, value string"
    truth = spark.createDataFrame([("r", "c", 1, "alpha beta"), ("r", "c", 2, "alpha beta gamma"), ("r", "d", 3, "solo")], schema)
    found = spark.createDataFrame([("r", "c", 10, "alpha beta gamma"), ("r", "c", 11, "beta alpha"), ("r", "c", 12, "solo")], schema)
    m = repair.greedy_matches(found, truth)
    assert {(r["truth_id"], r["found_id"]) for r in m.collect()} == {(2, 10), (1, 11)}
    assert tuple(repair.recall_precision(m, found, truth).first()) == ("r", 2 / 3, 2 / 3)


def test_segments_know_every_word(spark, monkeypatch):
    counts = spark.createDataFrame([("the", 50), ("pump", 20), ("closes", 10), ("gaugette", 1), ("él", 1), ("zu", 1), ("never", 1)], "word string, n long")
    rows = [(1, "thegaugettecloses"), (2, None), (None, "pumpélthezu"), (3, ""), (4, "ThePump 12 closes"), (4, "thegaugettecloses"), (5, "thepump")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut_in = lambda: sorted((str(r["doc_id"]), r["words"]) for r in repair.segmented(df, counts, "doc_id", "text").collect())
    whole = cut_in()
    for held in (3, 2, 0):
        monkeypatch.setattr(repair, "VOCABULARY", held)
        assert cut_in() == whole
    assert ("1", ["the", "gaugette", "closes"]) in whole and ("None", ["pump", "él", "the", "zu"]) in whole and len(whole) == 7


def _plain_cut(text, logs, unknown):
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        best.append(max(((best[at][0] + logs.get(text[at:end], unknown - 2.3 * (end - at)), at) for at in range(max(0, end - 32), end)), key=lambda x: (x[0], -x[1])))
    out, end = [], len(text)
    while end:
        out.append(text[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def test_runs_are_cut_abreast(monkeypatch):
    rng = random.Random(7)
    words = {"".join(rng.choices("abcdeéß𝔞", k=rng.randint(1, 7))) for _ in range(400)} | {"a" * 32, "cab" * 10}
    logs = {w: math.log(rng.choice((1, 1, 2, 5, 80)) / 40_000) for w in sorted(words)}
    runs = ["", "a", "a" * 700, "7" * 70, "𝔞" * 33, "xyz"] + ["".join(rng.choices(sorted(words) + ["x", "zz"], k=rng.randint(1, 120))) for _ in range(60)]
    unknown = -math.log(40_000)
    held, own = {w: x for i, (w, x) in enumerate(logs.items()) if i % 3}, {w: x for i, (w, x) in enumerate(logs.items()) if i % 3 == 0}
    began = time.process_time()
    wanted = [_plain_cut(r, logs, unknown) for r in runs]
    plain = time.process_time() - began
    for abreast, stride in ((256, 256), (7, 33), (1, 5)):
        monkeypatch.setattr(repair, "ABREAST", abreast)
        monkeypatch.setattr(repair, "STRIDE", stride)
        assert repair._cuts(runs, repair._Words(list(logs), list(logs.values())), unknown) == wanted
        assert repair._cuts(runs, repair._Words(list(held), list(held.values())), unknown, [own] * len(runs)) == wanted
    assert repair._cuts(runs, repair._Words([], []), unknown, [logs] * len(runs)) == wanted
    monkeypatch.undo()
    began = time.process_time()
    assert repair._cuts(runs * 8, repair._Words(list(logs), list(logs.values())), unknown) == wanted * 8
    assert time.process_time() - began < 8 * plain / 3


def test_segment_accuracy_has_a_line_for_every_text(spark, tmp_path, monkeypatch):
    from quern.plans.flow_plans import segment_accuracy

    rows = [(1, "The pump closes."), (1, "the valve opens"), (None, "the pump"), (2, None), (3, " 12 "), (4, "the valve")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for held in (100_000, 2, 0):
        monkeypatch.setattr(repair, "VOCABULARY", held)
        assert tuple(segment_accuracy(spark, str(tmp_path)).first()) == (4, 1.0)


def test_readers(spark, tmp_path):
    (tmp_path / "a" / "sub").mkdir(parents=True)
    (tmp_path / "a" / "sub" / "x.md").write_text("---\nTitle: One\ntitle: 'Two'\npages: 3\n---\nbody <!-- page 7 -->")
    (tmp_path / "a" / "_skip.md").write_text("no")
    got = readers.markdown(spark, {"r": str(tmp_path / "a"), "none": str(tmp_path / "absent")})
    r = got.select("relative_path", "size_bytes", readers.front_matter(F.col("text")).alias("m"), readers.body(F.col("text")).alias("b"), readers.page_markers(F.col("text")).alias("p")).collect()
    assert len(r) == 1 and r[0]["relative_path"] == "sub/x.md" and r[0]["m"] == {"title": "Two", "pages": "3"} and r[0]["b"].startswith("body") and r[0]["p"] == [7]
    (tmp_path / "c.csv").write_text("﻿file, title\na,T\n", encoding="utf-8")
    assert readers.catalog(spark, str(tmp_path / "c.csv")).columns == ["file", "title"]
    (tmp_path / "j1.json").write_text('[{"k": "a", "v": 1}, {"k": "b", "v": 1}]')
    (tmp_path / "j2.json").write_text('[{"k": "a", "v": 2}]')
    assert {tuple(x) for x in readers.json_files(spark, str(tmp_path / "j*.json"), "k string, v int", "k").collect()} == {("a", 2), ("b", 1)}
    api = json.dumps({"paths": {"/x/{id}": {"get": {"tags": ["t"], "parameters": [{"name": "id", "required": True}]}, "post": {}}}})
    e = readers.api_endpoints(spark.createDataFrame([(api,)], "text string")).first()
    assert e["operation_id"] == "getXId" and e["tags"] == ["t"]
    df = spark.createDataFrame([(2, "b|"), (1, None)], "k int, v string")
    assert readers.canonical_json(df, ["k"]) == readers.canonical_json(df.repartition(3), ["k"])
    assert "b\\|" in readers.markdown_report("R", df, ["k"])


def test_watcher(spark, tmp_path):
    import datetime as dt

    schema = "sample_id long, document_key string, root_name string, relative_path string, size_bytes long, modified_ns long, sampled_at timestamp"
    row = lambda i, path, size: (i, "d", "r", path, size, 1, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i))
    first = [row(1, "a", 1), row(2, "a", 1), row(3, "b", 1), row(4, "b", 2)]
    second = [row(5, "a", 1), row(6, "b", 3), row(7, "b", 3), row(8, "c", 1)]
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(source)
    watcher.watch(spark, source, root)
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(source)
    states = watcher.watch(spark, source, root).read()
    got = {r["file"].split("\n")[2]: (r["stable"], r["samples"]) for r in states.collect()}
    assert got == {"a": (3, 3), "b": (2, 4), "c": (1, 1)}
    assert watcher.at_rest(states).count() == 2
    whole = {r["file"].split("\n")[2]: (r["stable"], r["samples"]) for r in watcher.summaries(spark.createDataFrame(first + second, schema)).collect()}
    assert whole == got
    assert watcher.summaries(spark.createDataFrame([], schema)).count() == 0


def test_text_rules(spark):
    from quern.operators import textrules

    s = spark.createDataFrame([(1, 0, "Warning: hot part."), (1, 1, "Caution: steam can burn."), (1, 2, "Utilize it.")], "doc_id long, no int, sentence string")
    assert [r["no"] for r in textrules.warnings_without_consequence(s).collect()] == [0]
    d = spark.createDataFrame([("utilize", False, "use"), ("hot", False, "x"), ("hot", True, None)], "word string, approved boolean, alternatives string")
    assert [(r["no"], r["word"], r["alternatives"]) for r in textrules.unapproved_words(s, d).collect()] == [(2, "utilize", "use")]
    t = spark.createDataFrame([("a", "# One\n[x](b#two) [y](c) [z](#one) [w](https://e.org) [v](#no)\n```\n[q](none)\n```"), ("b", "# Two")], "k string, t string")
    broken = textrules.broken_links(textrules.links(t, "k", "t"), structure.sections(t, "k", "t").select("k", "anchor"), "k")
    assert {(r["target"], r["reason"]) for r in broken.collect()} == {("c", "no file"), ("#no", "no anchor")}
    f = spark.createDataFrame([(1, "```\nset a 1\nThis line is plain prose here.\n```\nset b 2\nset c 3\n\nset the valve.\nmode = fast\nA pump is a machine")], "k long, t string")
    assert [r["line_no"] for r in textrules.fence_leaks(f, "k", "t").collect()] == [3]
    assert [(r["line"], r["fence"]) for r in textrules.unfenced_commands(f, "k", "t").orderBy("line_no").collect()] == [("set b 2", True), ("set c 3", True)]
    assert {r["kind"] for r in textrules.typed_facts(f, "k", "t").collect()} == {"configuration", "definition"}
    art = spark.createDataFrame([(1, "# a\n# b\n# c\n# d\n# e\nbody"), (2, "# a\nbody"), (3, None)], "k long, t string")
    assert [r["t"] for r in textrules.drop_cover_art(art, "k", "t").orderBy("k").collect()] == ["body", "# a\nbody", None]
    m = spark.createDataFrame([("p", "'''Doc.'''\nimport logging\n# note\nlogging.info('said')\n")], "path string, source string")
    assert {(r["kind"], r["text"]) for r in textrules.python_prose(m).collect()} == {("docstring", "Doc."), ("comment", "note"), ("log", "said")}
