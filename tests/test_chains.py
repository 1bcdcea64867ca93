import functools
import random

from pyspark.sql import functions as F

from loomwork.functions import code_lines as L
from loomwork.operators import chains


def test_critical_paths(spark):
    rng = random.Random(4)
    links = sorted({(a, b) for a, b in (sorted(rng.sample(range(20), 2)) for _ in range(40))})
    score = {n: rng.randint(1, 9) for n in range(23)}

    @functools.cache
    def best(n):
        below = [(best(b)[0], best(b)[1], -b) for a, b in links if a == n]
        if not below:
            return score[n], 1, (n,)
        s, k, b = max(below)
        return s + score[n], k + 1, (n, *best(-b)[2])

    want = sorted(((best(n), n) for n in score if best(n)[1] > 1), key=lambda x: (-x[0][0], -x[0][1], x[1]))[:6]
    files = spark.createDataFrame(list(score.items()), "node long, score long")
    edges = spark.createDataFrame([*links, (20, 21), (21, 20)], "src long, dst long")  # a cycle has no chain
    got = chains.critical_paths(files, edges, 6)
    assert sorted((r.start, tuple(r.path), r.score) for r in got.collect()) == sorted((n, p, float(s)) for (s, _, p), n in want)
    found = {r.start: r.severity for r in chains.chain_findings(got, 5).collect()}
    assert found == {n: "critical" if s >= 30 else "high" for (s, _, _), n in want if s >= 15}
    out = {n: sum(a == n for a, _ in links) for n in score}
    spots = {r.start: (r.node, r.outgoing) for r in chains.hotspots(got, edges).collect()}
    assert spots == {n: (m := max(p, key=lambda x: (out[x], -p.index(x))), out[m]) for (_, _, p), n in want}
    assert chains.critical_paths(files, edges.where("false")).count() == 0


def test_lines(spark):
    rows = [
        ("export const foo = 1", "foo", True, "constant"), ("  async function foo() {", "foo", True, "function"), ("foo(1)", "foo", True, "function"), ("x = foo(1)", "foo", False, "function"), ("def a.b():", "a.b", True, "function"), ("def axb():", "a.b", False, "function"),
        ("class Foo:", "Foo", True, "class"), ("pub fn go(", "go", True, "function"), ("func (r *T) go(", "go", True, "function"), ("let f = () => 1", "f", True, "function"), ("private x: number;", "x", True, "property"),
        ("const " + "x" * 1000, "x", False, "constant"), (None, "x", None, None),
    ]
    df = spark.createDataFrame(rows, "t string, n string, d boolean, k string")
    for r in df.select("*", L.is_definition(F.col("t"), F.col("n")).alias("gd"), L.symbol_kind(F.col("t")).alias("gk")).collect():
        assert (r.gd, r.gk) == (r.d, r.k), r
    lines = [("import {a} from 'b'", True, False, False), ("const a = await import('b')", False, True, False), ("reimport('b')", False, False, False), ("go (1)", False, False, True), ("ergo(1)", False, False, False)]
    df = spark.createDataFrame(lines, "t string, i boolean, d boolean, c boolean")
    for r in df.select("*", L.is_import(F.col("t")).alias("gi"), L.is_dynamic_import(F.col("t")).alias("gd"), L.calls(F.col("t"), F.lit("go")).alias("gc")).collect():
        assert (r.gi, r.gd, r.gc) == (r.i, r.d, r.c), r
