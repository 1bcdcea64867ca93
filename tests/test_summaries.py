"""Scores with hot files, context of findings, duplicated bodies, records and chosen paths, on nulls, ties and empty tables."""

from pyspark.sql import functions as F

from loomwork.operators import summaries

FINDINGS = "id long, category string, severity string, file string"


def test_feature_scores(spark):
    rows = [(1, "a", "critical", "x"), (2, "a", "low", "x"), (3, "a", "low", "y"), (4, "b", "info", "z"), (5, "c", None, None), (6, "d", "info", "z")]
    hot = spark.createDataFrame([("x", 95), ("x", 10), ("y", 0), ("q", 99)], "file string, risk int")
    got = [tuple(r) for r in summaries.feature_scores(spark.createDataFrame(rows, FINDINGS), hot).collect()]
    # a: 27 points in two files leave 100 / 2.35 = 43, one of two files hot costs 5 + 10
    assert sorted(got) == [(1, "a", 3, 2, 1, 15, 28, "D"), (2, "b", 1, 1, 0, 0, 99, "A"), (3, "c", 1, 0, 0, 0, 99, "A"), (4, "d", 1, 1, 0, 0, 99, "A")]
    assert summaries.feature_scores(spark.createDataFrame([], FINDINGS), hot).count() == 0


def test_context_of_findings(spark):
    rows = spark.createDataFrame([(1, "a", "low", "x"), (2, "b", "low", "x"), (3, "c", "low", "x"), (4, "a", "low", None), (5, "z", "low", "y")], FINDINGS)
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "file string")
    got = {r.id: r.signals for r in summaries.with_context(rows, of("x", "x"), of("y"), of("x"), of(), 3).collect()}
    assert got == {1: "hot-file,critical-path-context,paired:b", 2: "hot-file,critical-path-context,paired:a", 3: "hot-file,critical-path-context,paired:a", 4: "", 5: "cycle-context"}


def test_duplicate_bodies(spark):
    rows = [("h", "f", "a", 1)] * 2 + [("h", "f", "b", k) for k in range(5)] + [("h", "g", "a", 1), ("i", "f", "a", 9), ("i", "f", "a", 8)]
    got = {(r["hash"], r.kind): (r.n, r.files, r.severity, r.places) for r in summaries.duplicate_bodies(spark.createDataFrame(rows, "hash string, kind string, file string, line int"), 2, 3).collect()}
    assert got == {("h", "f"): (7, 2, "high", "a:1,a:1,b:0"), ("i", "f"): (2, 1, "low", "a:8,a:9")}


def test_records_and_critical_nodes(spark):
    files = spark.createDataFrame([(1, "a.ts"), (2, "b.test.ts"), (3, "c.ts")], "node long, path string")
    edges = spark.createDataFrame([(1, 3), (2, 3), (2, 3), (3, 1)], "src long, dst long")
    outer = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "node long, specifier string")
    records = summaries.dependency_records(files, edges, outer, outer.where("false"))
    assert {tuple(r) for r in records.collect()} == {(1, 1, 1, 1, 0, 2, 0), (2, 1, 0, 0, 0, 0, 0), (3, 1, 2, 1, 1, 0, 0)}
    scores = spark.createDataFrame([(1, 70), (2, 13), (3, 12)], "node long, score int")
    assert [(r.node, r.band) for r in summaries.critical_nodes(records, scores).collect()] == [(1, "high"), (2, "low")]


def test_chosen_paths(spark):
    def chosen(path, **rules):
        return spark.createDataFrame([(path,)], "p string").select(summaries.chosen_path(F.col("p"), **rules).alias("c")).first().c

    assert chosen("a/b.ts") and chosen("./a/b.ts") and not chosen("a/.b/c.ts") and chosen("a/.b/c.ts", hidden=True)
    assert chosen("a/b.tsx", kind="ts") and not chosen("a/b.js", kind="ts") and not chosen("ts", kind="ts")
    assert chosen("a/b.ts", include=("*.js", "*.ts")) and not chosen("a/b.ts", include=("b/**",)) and chosen("b/c/d.ts", include=("b/**",))
    assert not chosen("a/b.ts", exclude=("b.*",)) and not chosen("dist/x/b.ts", exclude_folders=("dist",)) and chosen("x/dist", exclude_folders=("dist",))
