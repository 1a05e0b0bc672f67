"""Walks over edge tables by frontier joins: every step is one join of the frontier with the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import cut


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, depth: every node within ``depth`` edges of a start, at its least distance. Cycles end the walk."""
    e = edges.select("src", "dst").distinct()
    seen = cut(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for step in range(1, depth + 1):
        ahead = frontier.join(e, frontier["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def import_edges(modules: DataFrame) -> DataFrame:
    """src, dst from (module, source): absolute imports anywhere in the source; unparseable sources give none."""
    import ast

    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for name, source in zip(b["module"], b["source"], strict=True):
                try:
                    tree = ast.parse(source or "")
                except (SyntaxError, ValueError):
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, ast.Import):
                        out += [(name, a.name) for a in n.names]
                    elif isinstance(n, ast.ImportFrom) and not n.level and n.module:
                        out.append((name, n.module))
            yield pd.DataFrame(out, columns=["src", "dst"])

    return modules.select("module", "source").mapInPandas(run, "src string, dst string").distinct()
