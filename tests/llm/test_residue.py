"""Residue of templates, error pages and the like."""

from __future__ import annotations

import random

from quern.llm import residue, words

DOCS = "doc_id long, text string, label int, ids string"


def corpus():
    rng = random.Random(9)
    v = "valve pump gauge filter motor sensor panel cable switch relay closes opens reads starts the a of when before after every first next with".split()
    prose = lambda: " ".join(" ".join(rng.choice(v) for _ in range(12)).capitalize() + "." for _ in range(6))
    rows, truth = [], {}
    for i in range(200):
        rows.append((i, "\n\n".join(prose() for _ in range(3))))
    errors = ["404 Not Found", "Error 403: Forbidden", "503 Service Unavailable", "HTTP 500"]
    tails = ["The upstream worker did not answer in time.", "Contact the site owner if the problem stays."]
    for i in range(200, 220):
        rows.append((i, rng.choice(errors) + "\n\n" + rng.choice(tails)))
        truth[i] = "error_page"
    rows.append((220, "We lost this page\n\n" + tails[0]))  # learned from what stands beside the signs
    truth[220] = "error_page"
    for i in range(230, 245):
        rows.append((i, rng.choice(["Please enable JavaScript to view this page.", "This viewer needs scripts. Allow them and load the page again."]) + "\n\nLoading"))
        truth[i] = "script_notice"
    for i in range(250, 270):
        rows.append((i, "# __TITLE_ONE__\n\n{{valve.name}}\n\nWrite one line on [[pump]]."))
        truth[i] = "placeholder"
    rows.append((270, prose() + " Use the {{pump.size}} to close. " + prose()))
    truth[270] = "placeholder"
    for i in range(280, 290):
        rows.append((i, "Lorem ipsum dolor sit amet nuntia. This is dummy text. Lorem ipsum viride solum."))
        truth[i] = "filler"
    for i in range(300, 310):
        rows.append((i, prose() + "\n\nThe job fills its fields:\n\n```\nset {{ pump }}\n```\n\nWhen the log shows \"404 Not Found\", every valve closes after the first pump. " + prose()))
    return rows, truth


def test_kinds(spark):
    rows, truth = corpus()
    got = {r["doc_id"]: r["residue_kind"] for r in residue.residue(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)).collect()}
    missed = {i: k for i, k in truth.items() if got.get(i) != k}
    false = {i: k for i, k in got.items() if i not in truth}
    assert len(missed) <= 1, missed
    assert len(false) <= 1, false


def test_clean_keeps_the_rest(spark):
    rows, truth = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)
    kept = {r["doc_id"] for r in residue.without_residue(df).collect()}
    assert {i for i, _ in rows} - set(truth) - kept == set()


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "404 Not Found", 1, ""), (1, None, 1, ""), (2, "", 1, ""), (3, " ", 1, ""), (4, "plain " * 100_000, 1, ""), (5, "404 Not Found", 1, ""), (5, "404 Not Found", 1, "")], DOCS)
    assert {tuple(r)[:2] for r in residue.residue(df).collect()} <= {(5, "error_page")}
    assert residue.residue(df.limit(0)).count() == 0


def test_code_and_dense_passages_beside_a_message(spark):
    rows, _ = corpus()
    frames = "\n".join(f'  File "/srv/app/handlers/module_{i}.py", line {i}, in dispatch_request_{i}' for i in range(400))
    fence = f"\n\n```\n{frames}\n```"
    glued = "Thevalvereadsthegaugebeforethepumpstartsandclosestherelayaftereveryfirstswitchofthepanel" * 4
    tail = "The upstream worker did not answer in time."
    rows += [(400, "500 Internal Server Error" + fence), (401, rows[0][1] + "\n\n" + tail + fence), (402, glued + "\n\n" + tail), (403, "Error 403: Forbidden\n\n" + glued), (404, glued)]
    got = {r["doc_id"]: r["residue_kind"] for r in residue.residue(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)).collect()}
    assert {i: got.get(i) for i in range(400, 405)} == {400: "error_page", 401: "error_page", 402: "error_page", 403: "error_page", 404: None}


def test_long_slots_and_long_messages(spark):
    rows, _ = corpus()
    message = "404 Not Found. The page was moved and the upstream worker did not answer in time, so contact the site owner if the problem stays. "
    slot = "{{" + "valve_" * 12 + "}}"
    rows += [(410, message * 5), (411, f"# {slot}\n\n{slot}\n\nWrite one line on [[{'pump ' * 14}x]]."), (412, rows[1][1] + f"\n\nUse the {slot} to close every valve.")]
    got = {r["doc_id"]: r["residue_kind"] for r in residue.residue(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)).collect()}
    assert {i: got.get(i) for i in (410, 411, 412)} == {410: "error_page", 411: "placeholder", 412: "placeholder"}


def test_every_way_to_write_a_slot_is_seen():
    ways = ["{{a}}", "${a}", "#{a}", "{% a %}", "<%= a %>", "[[pump]]", "<<pump>>", "%%pump%%", "@@pump@@", "__pump__", "%pump%", "xxx-pump-xxx", "XXX-pump-XXX", "<your name>", "[INSERT name]"]
    ways += [f"{a}{w}{b}" for a, b in ("<>", "[]", "()") for x in ("tbd", "tba", "tbc", "todo", "xxx") for w in (x, x.upper(), x.title(), f" {x} by May")]
    ways += [f"{w}: later" for x in ("todo", "fixme", "tbd") for w in (x, x.upper(), x.title())]
    ways += [f"({w})" for x in ("supplied", "added", "confirmed", "determined", "written", "defined") for w in (f"name to be {x}", f"NAME TO BE {x.upper()}", f"Name To Be {x.title()}")]
    assert [w for w in ways if "slotof" not in residue._plain(f"The pump is {w} here")] == []


def test_texts_are_read_once(spark):
    from pyspark.sql import functions as F

    rows, truth = corpus()
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    got = {r["doc_id"]: r["residue_kind"] for r in residue.residue(df).collect()}
    assert read.value == len(rows)
    assert sum(got.get(i) != k for i, k in truth.items()) <= 1


def test_written_records_are_those_that_were_split(monkeypatch):
    import numpy as np
    import pandas as pd

    texts = [t for _, t in corpus()[0]] + ["", None, " \n\n ", "one", "{{a}} {{b}}\n\n\n\n# c\n404", "ab " * 50_000]
    (_, ids, pairs, starts, record, size, label, letters), *rest = residue._split(texts)
    assert not rest
    out = list(residue._read(iter([pd.DataFrame({"doc_id": np.arange(len(texts)) + 7, "text": pd.Series(texts, dtype=object)})])))
    kept = pd.concat([x[x["kind"] == residue.WRITTEN] for x in out])
    assert kept["key"].tolist() == (np.unique(record) + 7).tolist()
    for limit in (4_000_000, 1):  # one chunk, and one for each record
        monkeypatch.setattr(residue, "chunks", lambda rows, limit=limit: words.chunks(rows, limit))
        parts = list(residue._written(kept))
        assert len(parts) == (1 if limit > 1 else len(kept))
        for at, whole in ((1, ids), (2, pairs), (6, label), (7, letters)):
            assert np.array_equal(np.concatenate([p[at] for p in parts]), whole)
        assert np.array_equal(np.concatenate([np.diff(p[3]) for p in parts]), np.diff(starts))
        assert np.array_equal(np.concatenate([p[5] for p in parts]), size[size > 0])
        assert np.array_equal(np.concatenate([p[0] + p[4] for p in parts]), np.unique(record, return_inverse=True)[1])
