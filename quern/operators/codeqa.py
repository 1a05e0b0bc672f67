"""Rules on Python source: an Arrow pass parses each module once and emits rows; thresholds and joins are SQL."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINDINGS = "path string, rule string, severity string, line int, subject string"
METRICS = "path string, name string, line int, params int, length int, complexity int, blocks int, nesting int, public boolean"
NAMES = "path string, name string"
LIMITS = {"params": 5, "length": 25, "complexity": 10, "blocks": 5, "nesting": 4}
# Words of a function name that speak of an indirection; the second list weighs less.
INDIRECTION = ("wrapper", "shim", "proxy", "facade", "delegate", "passthrough", "pass_through", "forwarder", "adapter", "compat", "legacy", "alias")
WEAK_INDIRECTION = ("helper",)
# Cost of a finding by severity, most points of a category, least score of each grade, shares of commented lines.
COST = {"critical": 10, "high": 6, "medium": 3, "low": 1}
CATEGORY_CAP = 20
GRADES = ((97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (63, "D"), (60, "D-"), (0, "F"))
COMMENT_TARGET, COMMENT_FLOOR = 0.8, 0.5
# Syntax nodes that the complexity and the blocks of a function count.
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)
_BLOCK = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try)


def _functions(tree: ast.AST) -> Iterator[ast.FunctionDef]:
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield n


def _depth(node: ast.AST, level: int = 0) -> int:
    return max([level, *(_depth(c, level + isinstance(c, _BLOCK)) for c in ast.iter_child_nodes(node) if not isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))])


def _body(f: ast.FunctionDef) -> list[ast.stmt]:
    b = f.body
    return b[1:] if b and isinstance(b[0], ast.Expr) and isinstance(b[0].value, ast.Constant) and isinstance(b[0].value.value, str) else b


def _metrics(path: str, tree: ast.Module) -> list[tuple]:
    top = {id(n) for n in tree.body}
    out = []
    for f in _functions(tree):
        a = f.args
        params = len([x for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if x.arg not in ("self", "cls")]) + bool(a.vararg) + bool(a.kwarg)
        inside = [n for s in f.body for n in ast.walk(s)]
        complexity = 1 + sum(isinstance(n, _BRANCH) for n in inside) + sum(len(n.values) - 1 for n in inside if isinstance(n, ast.BoolOp))
        out.append((path, f.name, f.lineno, params, (f.end_lineno or f.lineno) - f.lineno + 1, complexity, sum(isinstance(n, _BLOCK) for n in inside), _depth(f), id(f) in top and not f.name.startswith(("_", "test_"))))
    return out


def _is_assert_call(n: ast.AST) -> bool:
    return isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and (n.func.attr.startswith("assert") or n.func.attr in ("raises", "fail"))


def _test_findings(path: str, f: ast.FunctionDef) -> Iterator[tuple]:
    own = [n for s in f.body for n in ast.walk(s)]
    checks = 0
    for n in own:
        if isinstance(n, ast.Assert):
            checks += 1
            t = n.test
            if isinstance(t, ast.Constant) and t.value is True:
                yield (path, "taut_literal_true", "high", n.lineno, f.name)
            if isinstance(t, (ast.Name, ast.Attribute)):
                yield (path, "weak_bare_assert", "medium", n.lineno, f.name)
            if isinstance(t, ast.Compare) and len(t.ops) == 1:
                left, right = t.left, t.comparators[0]
                if isinstance(t.ops[0], ast.IsNot) and isinstance(right, ast.Constant) and right.value is None:
                    yield (path, "weak_is_not_none", "medium", n.lineno, f.name)
                if isinstance(t.ops[0], ast.Eq):
                    if isinstance(left, ast.Constant) and isinstance(right, ast.Constant):
                        yield (path, "taut_literal_equality", "high", n.lineno, f.name)
                    elif ast.dump(left) == ast.dump(right):
                        yield (path, "taut_variable_self_compare", "high", n.lineno, f.name)
                    if isinstance(right, ast.Attribute) and right.attr == "return_value" and isinstance(left, ast.Call) and ast.dump(left.func) == ast.dump(right.value):
                        yield (path, "weak_self_mock_echo", "high", n.lineno, f.name)
        elif _is_assert_call(n):
            checks += 1
            if n.func.attr == "assert_called" and not n.args:
                yield (path, "weak_mock_called_no_args", "medium", n.lineno, f.name)
            if n.func.attr in ("raises", "assertRaises", "assertRaisesRegex") and n.args:
                kinds = n.args[0].elts if isinstance(n.args[0], ast.Tuple) else [n.args[0]]
                if any(isinstance(k, ast.Name) and k.id in ("Exception", "BaseException") for k in kinds):
                    yield (path, "weak_pytest_raises_exception", "medium", n.lineno, f.name)
    if not checks:
        yield (path, "weak_zero_assertions", "high", f.lineno, f.name)


def _style_findings(path: str, tree: ast.Module, source: str) -> Iterator[tuple]:
    for f in _functions(tree):
        body = _body(f)
        stub = not body or all(isinstance(s, ast.Pass) or (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and s.value.value is ...) for s in body) or (
            len(body) == 1 and isinstance(body[0], ast.Raise) and "NotImplementedError" in ast.dump(body[0])
        )
        abstract = any("abstract" in ast.dump(d) or "overload" in ast.dump(d) for d in f.decorator_list)
        if stub and not abstract and not f.name.startswith("__"):
            yield (path, "ARCH-STUB", "medium", f.lineno, f.name)
        elif len(body) == 1 and isinstance(body[0], (ast.Return, ast.Expr)) and isinstance(body[0].value, ast.Call) and not f.name.startswith("__"):
            names = {a.arg for a in f.args.args} - {"self", "cls"}
            c = body[0].value
            callee = c.func.attr if isinstance(c.func, ast.Attribute) else getattr(c.func, "id", "")
            if callee and not callee[0].isupper() and callee != "print" and any(isinstance(a, ast.Name) and a.id in names for a in c.args):
                yield (path, "ARCH-DELEGATE", "low", f.lineno, f.name)
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            parts = {x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", n.name)}
            hit = next((w for w in (*INDIRECTION, *WEAK_INDIRECTION) if w in parts or "_" in w and w in n.name.lower()), None)
            if hit:
                yield (path, "ARCH-NAMING", "low" if hit in WEAK_INDIRECTION else "medium", n.lineno, n.name)
        elif isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else ""
            if name == "input" and isinstance(n.func, ast.Name):
                yield (path, "CONV-INPUT", "medium", n.lineno, name)
            if name in ("debug", "info", "warning", "error", "exception", "critical") and n.args and isinstance(n.args[0], ast.JoinedStr):
                yield (path, "CONV-LOG-FSTRING", "low", n.lineno, name)
        elif isinstance(n, (ast.For, ast.AsyncFor)) and isinstance(n.target, ast.Name) and len(n.target.id) == 1 and n.target.id != "_":
            yield (path, "CONV-NAME", "low", n.lineno, n.target.id)
        elif isinstance(n, ast.Constant) and isinstance(n.value, str) and re.search(r"(?<![A-Za-z])[A-Za-z]:\\", n.value):
            yield (path, "CONV-PATH", "medium", n.lineno, n.value[:20])
    for body in [tree.body, *(c.body for c in ast.walk(tree) if isinstance(c, ast.ClassDef))]:
        for s in body:
            if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and isinstance(s.value, (ast.Name, ast.Attribute)) and not s.targets[0].id.isupper():
                yield (path, "ARCH-ALIAS", "high" if isinstance(s.value, ast.Name) else "medium", s.lineno, s.targets[0].id)


def comment_lines(source: str) -> tuple[set[int], set[int]]:
    """First lines of the statements of a module, and of those that carry a comment on any of their lines.

    Strings alone, decorators, else, try, finally and lines of brackets need none.
    """
    code, commented = set(), set()
    held: list[tokenize.TokenInfo] = []
    note = False
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type == tokenize.COMMENT:
            note = note or bool(held) or bool(t.line[: t.start[1]].strip())
        elif t.type == tokenize.NEWLINE:
            first = held[0].line.strip() if held else ""
            bare = first.startswith("@") or first in ("else:", "try:", "finally:") or not first.strip("()[]{}:,. ")
            if held and not bare and any(x.type != tokenize.STRING for x in held):
                code.add(held[0].start[0])
                if note:
                    commented.add(held[0].start[0])
            held, note = [], False
        elif t.type not in (tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
            held.append(t)
    return code, commented


def _file_findings(path: str, source: str) -> Iterator[tuple]:
    code, commented = comment_lines(source)
    share = len(commented) / len(code) if code else 1.0
    if share < COMMENT_TARGET:
        yield (path, "CONV-COMMENTS", "high" if share < COMMENT_FLOOR else "medium", min(code - commented), "<file>")
    for i, line in enumerate(source.splitlines(), 1):
        if "existing code" in line.lower() and "..." in line:
            yield (path, "CONV-MARKER", "medium", i, "<file>")


def _run(modules: DataFrame, schema: str, make) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for path, source in zip(b["path"], b["source"], strict=True):
                try:
                    tree = ast.parse(source or "")
                except (SyntaxError, ValueError):
                    continue
                out += make(path, tree, source or "")
            yield pd.DataFrame(out, columns=columns)

    return modules.select("path", "source").mapInPandas(run, schema)


def function_metrics(modules: DataFrame) -> DataFrame:
    """Metrics of every function (``METRICS``); unparseable modules give none."""
    return _run(modules, METRICS, lambda p, t, s: _metrics(p, t))


def structure_findings(modules: DataFrame) -> DataFrame:
    """One row per function and exceeded limit; equality passes."""
    m = function_metrics(modules)
    checks = F.array(*[F.struct(F.lit(f"STRUCT-{k.upper()}").alias("rule"), F.col(k).alias("v"), F.lit(n).alias("limit")) for k, n in LIMITS.items()])
    return m.select("path", "line", "name", F.explode(checks).alias("c")).where("c.v > c.limit").select("path", "c.rule", F.lit("medium").alias("severity"), "line", F.col("name").alias("subject"))


def style_findings(modules: DataFrame) -> DataFrame:
    return _run(modules, FINDINGS, lambda p, t, s: [*_style_findings(p, t, s), *_file_findings(p, s)])


def comment_coverage(modules: DataFrame) -> DataFrame:
    """path, statements, percent: share of the statements that carry a comment, one decimal; 100 without statements."""

    def measure(path: str, tree: ast.Module, source: str) -> list[tuple]:
        code, commented = comment_lines(source)
        return [(path, len(code), round(100 * len(commented) / len(code), 1) if code else 100.0)]

    return _run(modules, "path string, statements int, percent double", measure)


def hotspots(modules: DataFrame, most: int = 5) -> DataFrame:
    """The most complex functions of each module, complexity 2 or more, in order of place on ties."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("complexity"), "line"))
    return function_metrics(modules).where("complexity >= 2").withColumn("rank", rank).where(F.col("rank") <= most).select("path", "rank", "name", "complexity")


def module_metrics(modules: DataFrame) -> DataFrame:
    """path, functions, mean_complexity (one decimal), max_complexity of every module with functions."""
    return function_metrics(modules).groupBy("path").agg(F.count("*").alias("functions"), F.bround(F.avg("complexity"), 1).alias("mean_complexity"), F.max("complexity").alias("max_complexity"))


def in_order(findings: DataFrame) -> DataFrame:
    """Findings in their one order: severity (worst first), category, path, line, rule."""
    return findings.orderBy(F.desc(_cost()), category(), "path", "line", "rule")


def worst(findings: DataFrame, most: int = 300) -> DataFrame:
    """A work list of at most ``most`` findings, worst first."""
    return in_order(findings).limit(most)


def test_findings(modules: DataFrame) -> DataFrame:
    """Weak and tautological checks in functions named test_*."""
    return _run(modules, FINDINGS, lambda p, t, s: [x for f in _functions(t) if f.name.startswith("test") for x in _test_findings(p, f)])


def untested(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """path, name of public module-level functions whose name stands nowhere in any test."""
    defined = function_metrics(sources).where("public").select("path", "name")
    used = _run(tests, NAMES, lambda p, t, s: sorted({(p, n.id if isinstance(n, ast.Name) else n.attr) for n in ast.walk(t) if isinstance(n, (ast.Name, ast.Attribute))} | {(p, a.name) for n in ast.walk(t) if isinstance(n, ast.ImportFrom) for a in n.names}))
    return defined.join(used.select("name").distinct(), "name", "left_anti").select("path", "name")


def suppressed(findings: DataFrame, modules: DataFrame) -> DataFrame:
    """Findings without those whose line carries ``noqa`` (bare, or naming the rule)."""
    lines = modules.select("path", F.posexplode(F.split("source", "\n")).alias("n", "text")).where(F.col("text").contains("noqa"))
    marks = lines.select("path", (F.col("n") + 1).alias("line"), F.regexp_extract("text", r"# noqa(?::\s*([A-Za-z0-9_, -]+))?", 1).alias("rules"))
    hit = (F.col("rules") == "") | F.array_contains(F.split(F.regexp_replace("rules", " ", ""), ","), F.col("rule"))
    return findings.join(marks, ["path", "line"], "left").withColumn("off", F.coalesce(hit, F.lit(False))).where(~F.col("off")).drop("rules", "off")


def same_code(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, only_prose: whether two revisions of a module differ in comments, docstrings and layout only."""

    def shape(path: str, tree: ast.Module, source: str) -> list[tuple]:
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Module)) and n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str):
                n.body = n.body[1:] or [ast.Pass()]
        return [(path, ast.dump(tree))]

    a, b = (_run(x, "path string, shape string", shape).select("path", F.sha2("shape", 256).alias(h)) for x, h in ((old, "a"), (new, "b")))
    return a.join(b, "path").select("path", (F.col("a") == F.col("b")).alias("only_prose"))


def _cost() -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COST.items() for x in kv]), F.col("severity")), F.lit(0))


def category() -> Column:
    """Group of a rule."""
    rule = F.col("rule")
    return (
        F.when(rule == "STRUCT-COMPLEXITY", "Complexity").when(rule.startswith("STRUCT-"), "Structure").when(rule.startswith("ARCH-"), "Architecture")
        .when(rule.startswith("CONV-"), "Conventions").otherwise("Tests")
    )


def grade(score: Column) -> Column:
    """Letter of a score."""
    out = F.lit("F")
    for least, letter in reversed(GRADES):
        out = F.when(score >= least, letter).otherwise(out)
    return out


def capped(findings: DataFrame, key: str, group: Column, cost: Column) -> DataFrame:
    """key, score, grade: 100 less the costs of the findings, of each group at most CATEGORY_CAP points."""
    by_group = findings.groupBy(key, group.alias("_group")).agg(F.least(F.sum(cost), F.lit(CATEGORY_CAP)).alias("p"))
    out = by_group.groupBy(key).agg(F.greatest(F.lit(0), 100 - F.sum("p")).cast("int").alias("score"))
    return out.withColumn("grade", grade(F.col("score")))


def scores(findings: DataFrame) -> DataFrame:
    """path, score, grade by severity costs (critical 10, high 6, medium 3, low 1), capped by category."""
    return capped(findings, "path", category(), _cost())
