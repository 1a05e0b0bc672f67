"""The driver's contract, with and without the training-text subpackage."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60 and "p6_found" in queries


def test_core_stands_alone():
    code = (
        "import importlib.util, sys\n"
        "real = importlib.util.find_spec\n"
        "importlib.util.find_spec = lambda n, *a: None if n.startswith('quern.llm') else real(n, *a)\n"
        "import __spark_entry__ as e\n"
        "assert 'p6_found' in e.queries() and 'p1_found' not in e.queries()\n"
        "assert not [m for m in sys.modules if m.startswith('quern.llm')]\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=120)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_core_queries_run(spark):
    from quern.plans import queries as core

    for name, query in core.queries().items():
        assert query(spark, DATA).count() >= 0, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_results_do_not_depend_on_partitions(spark):
    from quern.plans import queries as core

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("p6_found", "q_duplicate_winner", "q_part_groups", "q_ratio_distribution", "q_claim_batch"):
            seen = []
            for n in ("3", "7"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                seen.append(sorted(map(str, core.queries()[name](spark, DATA).collect())))
            assert seen[0] == seen[1], name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
