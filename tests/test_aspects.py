"""Aspects, signals, findings of a graph's shape, cohesion and the Markdown report."""

import itertools
import random

from pyspark.sql import functions as F

from loomwork.operators import aspects, biconnected, cohesion, markdown


def test_shared_folders_go(spark):
    def rest(*paths):
        rows = aspects.without_shared_folders(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
        return {r.path: list(r.parts) for r in rows}

    assert rest("a/b/c.ts", "a/b/d/e.ts") == {"a/b/c.ts": ["c.ts"], "a/b/d/e.ts": ["d", "e.ts"]}
    assert rest("a/b", "a/b/c") == {"a/b": ["a", "b"], "a/b/c": ["c"]}  # nothing is left of the first
    assert rest("x/y", "z/y") == {"x/y": ["x", "y"], "z/y": ["z", "y"]}
    assert rest("a\\b\\c", "a/b/d", "a/x/c") == {"a\\b\\c": ["b", "c"], "a/b/d": ["b", "d"], "a/x/c": ["x", "c"]}
    assert rest("only/one.ts") == {"only/one.ts": ["only", "one.ts"]}


def aspect_rows(spark, files=(), functions=(), findings=(), hot=(), **more):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    df = aspects.aspect_scores(
        frame(files, "path string, imports int, exports int"), frame(functions, "path string, name string, complexity int"), frame(findings, "category string, severity string, path string"), frame(hot, "path string, risk int"),
        {"dependency-cycle": "architecture", "dead-export": "dead-code"}, **more,
    )
    return {r.aspect: (r.weight, r.score, r.grade, r.confidence) for r in df.collect()}


def test_aspects_of_nothing_and_of_tests_only(spark):
    best = {name: (weight, 88 if name == "common-layer-health" else 100, "A", "low") for name, weight in aspects.WEIGHTS}
    assert aspect_rows(spark) == best | {"overall": (100, 98, "A", None)}
    tests = [("src/tests/a.ts", 9, 0), ("dist/b.js", 9, 0)]
    assert aspect_rows(spark, tests, [("dist/b.js", "<anonymous>", 99)], [("dependency-cycle", "critical", "src/tests/a.ts")], [("dist/b.js", 99)]) == best | {"overall": (100, 98, "A", None)}


def test_aspects_of_a_few_files(spark):
    files = [(f"r/src/f{k}.ts", 1, 1) for k in range(3)] + [("r/utils/helpers.js", 4, 1)]
    got = aspect_rows(spark, files, [("r/src/f0.ts", "<anonymous>", 20), ("r/src/f0.ts", "go", 20), ("r/src/f0.ts", None, None)], [("dependency-cycle", "critical", "r/src/f0.ts"), ("dead-export", "low", "r/utils/helpers.js")], [("r/src/f0.ts", 50)], signal="high")
    # one critical cycle in four files: 24(1-e^-.3375) + 22(1-e^-.475) + 16(1-e^-.55) + 12(1-e^-.65) = 7 + 8 + 7 + 6, and 3 for the signal
    assert got["architecture-structure"] == (30, 75, "B", "low")
    # depth 2; three of four in one folder; one of two folders vague: 18(1-e^-.4) + 24(1-e^-1.1) = 6 + 16
    assert got["folder-topology"][:2] == (15, 78)
    # a third unnamed, one of one short, one of four files generic: 30(1-e^-.767) + 15(1-e^-.45) + 10(1-e^-1.8) = 16 + 5 + 8
    assert got["naming-quality"][:2] == (15, 71)
    # one finding on one shared file, imports 4 / 2: 24(1-e^-1.6) + 18(1-e^-3) = 19 + 17
    assert got["common-layer-health"][:2] == (15, 64)


def test_lenses_and_signals(spark):
    rows = [("broker-module", "graph"), ("dependency-odd", "graph"), ("test-odd", "hybrid"), ("feature-envy", "hybrid"), ("dead-export", "ast")]
    df = spark.createDataFrame(rows, "c string, want string")
    assert all(r.got == r.want for r in df.select("want", aspects.lens(F.col("c")).alias("got")).collect())
    signals = spark.createDataFrame([("b", "graph", 5, "x"), ("a", "graph", 5, "y"), ("c", "ast", 9, "z")], "kind string, lens string, score long, title string")
    assert {(r.lens, r.kind) for r in aspects.strongest_signals(signals).collect()} == {("graph", "a"), ("ast", "c"), ("combined", "c")}
    assert aspects.strongest_signals(signals.where("false")).count() == 0


def test_graph_findings(spark):
    points = spark.createDataFrame([(1, 40, "fan-in", 9, 9, 1, 2), (2, 20, "fan-in", 8, 3, 0, 0), (3, 17, "x", 9, 9, 1, 0), (4, 50, "x", 2, 9, 0, 0)], "node long, score long, reasons string, incoming long, outgoing long, cut int, bridges int")
    clusters = spark.createDataFrame([(1, 5), (7, 3), (9, 2)], "component long, n long")
    chatter = spark.createDataFrame([("p", "q", 9), ("q", "p", 4), ("p", "r", 3)], "src_group string, dst_group string, weight long")
    effects = spark.createDataFrame([(1,), (2,), (2,), (4,)], "node long")
    got = {(r.category, r.severity, r.file) for r in biconnected.graph_findings(points, clusters, chatter, effects).collect()}
    assert got == {
        ("cycle-cluster", "high", "1"), ("cycle-cluster", "medium", "7"), ("broker-module", "high", "1"), ("broker-module", "medium", "2"), ("bridge-module", "high", "1"), ("bridge-module", "medium", "3"),
        ("package-boundary-chatter", "high", "p"), ("package-boundary-chatter", "medium", "q"), ("startup-risk-hub", "high", "1"), ("startup-risk-hub", "medium", "2"),
    }


def test_cohesion_equals_brute_force(spark):
    rng = random.Random(5)
    exports = [(m, f"s{k}") for m in range(6) for k in range(rng.randrange(2, 9))]
    imports = [(rng.randrange(12), rng.randrange(6), f"s{rng.randrange(10)}") for _ in range(60)]
    want = {}
    for m in range(6):
        own = {s for x, s in exports if x == m}
        by_user = {c: {s for d, x, s in imports if (d, x) == (c, m) and s in own} for c in range(12)}
        groups = [{s} for s in set().union(*by_user.values())]
        for a, b in itertools.product(range(12), repeat=2):
            for s in by_user[a]:
                for t in by_user[a]:
                    x, y = next(g for g in groups if s in g), next(g for g in groups if t in g)
                    if x is not y:
                        groups.remove(y)
                        x |= y
        if len(own) >= 3 and sum(map(len, groups)) >= 2 and len(groups) > 1:
            want[m] = (sum(map(len, groups)), len(groups), "high" if len(groups) >= 4 else "medium")
    got = cohesion.low_cohesion(spark.createDataFrame(exports, "module int, name string"), spark.createDataFrame(imports, "consumer int, module int, name string"))
    assert want and {r.module: (r.symbols, r.groups, r.severity) for r in got.collect()} == want


def test_markdown_report(spark):
    schema = "id long, category string, file string, severity string"
    rows = spark.createDataFrame([(1, "a|b", "x\n y.ts", "high"), (2, "c", None, "low")], schema)
    text = "\n".join(r.line for r in sorted(markdown.summary(rows, 10, 1).collect(), key=lambda r: (r.section, r.place)))
    assert "# Scan summary\n\nHealth: 90/100\n## Severity\n\n| Severity | Findings |\n| --- | --- |\n| critical | 0 |\n| high | 1 |" in text
    assert text.endswith("## Top findings\n\n| # | Severity | Category | File |\n| --- | --- | --- | --- |\n| 1 | high | a\\|b | x y.ts |")
    empty = [r.line for r in markdown.summary(rows.where("false"), 10).collect()]
    assert empty.count("| none |  |  |") == 1 and empty.count("| none |  |  |  |") == 1 and "Health: 100/100" in empty
