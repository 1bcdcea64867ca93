"""Operators against brute force and on awkward input."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from loomwork.functions import measures as M
from loomwork.operators import detectors, graph, shape


def closure(pairs):
    seen = set(pairs)
    while True:
        more = {(a, d) for a, b in seen for c, d in seen if b == c} - seen
        if not more:
            return seen
        seen |= more


def test_strong_components_equal_closure(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(26)}
    far = closure(pairs)
    want = {n: min([n, *(m for m in range(14) if (n, m) in far and (m, n) in far)]) for n in range(14)}
    nodes, edges = spark.range(14).withColumnRenamed("id", "node"), spark.createDataFrame(sorted(pairs), "src long, dst long")
    assert len(set(want.values())) < 14
    assert {r.node: r.component for r in graph.strong_components(nodes, edges).collect()} == want


def test_strong_components_without_edges(spark):
    nodes, edges = spark.range(3).withColumnRenamed("id", "node"), spark.createDataFrame([], "src long, dst long")
    assert {tuple(r) for r in graph.strong_components(nodes, edges).collect()} == {(n, n) for n in range(3)}


def test_finding_numbers_are_running(spark):
    rows = [(k, c, "a", s) for k, (c, s) in enumerate(itertools.product("xy", ["low", "critical", "info"]))]
    got = detectors.numbered(spark.createDataFrame(rows, "id long, category string, file string, severity string")).collect()
    by_issue = [r.severity for r in sorted(got, key=lambda r: r.issue)]
    assert by_issue == ["critical"] * 2 + ["low"] * 2 + ["info"] * 2 and min(r.issue for r in got) == "AST-ISSUE-0001"


def test_literals(spark):
    assert [shape.window_hours(t) for t in ("36h", "7d", "2w", "1m", "x", "5y")] == [36, 168, 336, 720, 0, 0]
    made = spark.createDataFrame([("a/b.py",), ("a/c/b.py",), ("a/b.pyc",), ("a/b+.ts",)], "path string")
    matching = lambda g: {r.path for r in made.where(F.col("path").rlike(shape.glob_pattern(g))).collect()}
    assert matching("a/*.py") == {"a/b.py"} and matching("**.py") == {"a/b.py", "a/c/b.py"}
    assert matching("a/b+.{ts,js}") == {"a/b+.ts"} and matching("a/?.py") == {"a/b.py"}


def test_measures(spark):
    rows = [("1024", 1024), ("1.5KB", 1536), ("2G", 2 << 30), ("x", None), (None, None), ("", None)]
    df = spark.createDataFrame(rows, "t string, n long").select("n", M.size_bytes(F.col("t")).alias("got"))
    assert all(r.n == r.got for r in df.collect())
    texts = spark.createDataFrame([("",), ("aaaa",), ("abcd",), (None,)], "t string").select(M.entropy(F.col("t")).alias("e"))
    assert [r.e for r in texts.collect()] == [0.0, 0.0, 2.0, None]
    cut = spark.createDataFrame([("abcdefg hij",), ("ab cdefghij",), ("short",)], "t string").select(M.cut_at_space(F.col("t"), 10).alias("c"))
    assert [r.c for r in cut.collect()] == ["abcdefg...", "ab cdefghi...", "short"]
