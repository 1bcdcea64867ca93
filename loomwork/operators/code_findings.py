"""Findings on modules, exports and similar bodies, from given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import paths as P
from loomwork.operators import graph, merges


def split_degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``files(node, path)``: ``node, production_in, test_in, outgoing``: who depends on a file, tests apart."""
    kind = files.select(F.col("node").alias("src"), P.is_test(F.col("path")).alias("test"))
    into = edges.join(kind, "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.when(~F.col("test"), 1)).alias("production_in"), F.count(F.when(F.col("test"), 1)).alias("test_in"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outgoing"))
    return files.select("node", "path").join(into, "node", "left").join(out, "node", "left").fillna(0, ["production_in", "test_in", "outgoing"])


def test_only(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, path, severity``: no test itself, and only tests depend on it."""
    found = split_degrees(files, edges).where(~P.is_test(F.col("path")) & (F.col("production_in") == 0) & (F.col("test_in") > 0))
    return found.select("node", "path", F.lit("medium").alias("severity"))


def dead_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, path``: nothing depends on it, it depends on nothing, and it is neither entry point nor test."""
    alone = F.col("production_in") + F.col("test_in") + F.col("outgoing") == 0
    return split_degrees(files, edges).where(alone & ~P.is_entry_point(F.col("path")) & ~P.is_test(F.col("path"))).select("node", "path")


def god_modules(files: DataFrame, edges: DataFrame, most_in: int = 20, most_out: int = 15) -> DataFrame:
    """``node, side, n, severity``: more dependants or dependencies than a module should have; high from 1.5 times as many."""
    counted = graph.degrees(files.where(~P.is_test(F.col("path"))).select("node"), edges)
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("n"), F.lit(most).alias("most")) for side, most in (("incoming", most_in), ("outgoing", most_out))])).alias("x")
    found = counted.select("node", sides).select("node", "x.*").where(F.col("n") > F.col("most"))
    return found.select("node", "side", "n", F.when(F.col("n") > 1.5 * F.col("most"), "high").otherwise("medium").alias("severity"))


def boundary_violations(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst, severity``: a dependency on another package that is not on its index file; high on internal or private parts."""
    owner = lambda c: F.regexp_extract(c, "^packages/([^/]+)/", 1)
    s, t = files.select(F.col("node").alias("src"), F.col("path").alias("a")), files.select(F.col("node").alias("dst"), F.col("path").alias("b"))
    both = edges.join(s.where(~P.is_test(F.col("a")) & (owner("a") != "")), "src").join(t.where(owner("b") != ""), "dst")
    public = F.col("b").rlike(r"^packages/[^/]+/(src/)?index\.[mc]?[jt]sx?$")
    deep = F.contains("b", F.lit("/internal/")) | F.contains("b", F.lit("/private/"))
    return both.where((owner("a") != owner("b")) & ~public).select("src", "dst", F.when(deep, "high").otherwise("medium").alias("severity"))


def package_chatter(files: DataFrame, edges: DataFrame, least: int = 4) -> DataFrame:
    """``src_group, dst_group, weight``: pairs of packages with at least ``least`` edges between them."""
    return graph.rolled_up(edges, files.select("node", P.package_of(F.col("path")).alias("grp"))).where(F.col("weight") >= least)


def cycle_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``component, n, inner, entering, leaving``: strongly connected groups of two nodes or more, with their edges."""
    folder: list[str] = []
    edges = graph.written(edges.select("src", "dst"), folder)
    at = graph.strong_components(nodes, edges)
    groups = at.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    s, t = at.select(F.col("node").alias("src"), F.col("component").alias("a")), at.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    both = graph.written(edges.join(s, "src").join(t, "dst").where("a is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")), folder)
    inner = both.where("a = b").groupBy(F.col("a").alias("component")).agg(F.sum("k").alias("inner"))
    into = both.where("a <> b").groupBy(F.col("b").alias("component")).agg(F.sum("k").alias("entering"))
    out = both.where("a <> b").groupBy(F.col("a").alias("component")).agg(F.sum("k").alias("leaving"))
    return groups.join(inner, "component", "left").join(into, "component", "left").join(out, "component", "left").fillna(0)


def hot_files(files: DataFrame, edges: DataFrame, in_cycle: DataFrame, most: int = 20) -> DataFrame:
    """``files(node, path, complexity, exports)``: the ``most`` files with the highest risk; ``in_cycle(node)`` are on a cycle.

    risk = 3 dependants + complexity / 2 + 1.5 exports + dependencies / 2, and 20 on a cycle, rounded half up; tests don't count.
    """
    rows = graph.degrees(files.where(~P.is_test(F.col("path"))), edges).join(in_cycle.select("node", F.lit(20).alias("c")), "node", "left")
    risk = F.floor(3 * F.col("incoming") + 0.5 * F.col("complexity") + 1.5 * F.col("exports") + 0.5 * F.col("outgoing") + F.coalesce("c", F.lit(0)) + 0.5)
    scored = rows.select("node", risk.cast("long").alias("risk"), "incoming", "outgoing", F.col("c").isNotNull().alias("in_cycle")).where("risk > 0")
    return scored.orderBy(F.desc("risk"), "node").limit(most)


def untested_critical(risky: DataFrame, files: DataFrame, edges: DataFrame, severe: int = 60, most: int = 25) -> DataFrame:
    """``risky(node, risk)``: those that no test depends on: ``node, risk, severity``, the worst ``most``."""
    tests = files.where(P.is_test(F.col("path"))).select(F.col("node").alias("src"))
    covered = edges.join(tests, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    once = risky.groupBy("node").agg(F.max("risk").alias("risk"))
    found = once.join(covered, "node", "left_anti").withColumn("severity", F.when(F.col("risk") >= severe, "critical").otherwise("high"))
    return found.orderBy(F.desc("risk"), "node").limit(most)


def dead_exports(exports: DataFrame, uses: DataFrame, tests: DataFrame) -> DataFrame:
    """``exports(module, name, kind)`` that no ``uses(module, name)`` names; types weigh less, ``test_use`` marks what only tests use.

    A use of ``*`` uses all names of its module.
    """
    def used(rows: DataFrame) -> DataFrame:
        whole = rows.where("name = '*'").select("module").distinct()
        return exports.join(rows.select("module", "name").distinct(), ["module", "name"], "left_semi").unionByName(exports.join(whole, "module", "left_semi").select(*exports.columns)).select("module", "name").distinct()

    rest = exports.join(used(uses), ["module", "name"], "left_anti")
    marked = rest.join(used(tests).withColumn("t", F.lit(True)), ["module", "name"], "left")
    return marked.select("module", "name", F.when(F.col("kind") == "type", "medium").otherwise("high").alias("severity"), F.coalesce("t", F.lit(False)).alias("test_use"))


def re_exports(passed: DataFrame, uses: DataFrame, own: DataFrame) -> DataFrame:
    """``passed(module, name, source)``: ``module, name, problem``.

    ``dead``: no ``uses(module, name)``; a ``*`` counts as used if anything of
    its module is.  ``duplication``: one name from several sources.
    ``shadowed``: the module has an ``own(module, name)`` of that name.
    """
    names = passed.select("module", "name").distinct()
    star = names.where("name = '*'").join(uses.select("module").distinct(), "module", "left_anti")
    dead = names.where("name <> '*'").join(uses.select("module", "name").distinct(), ["module", "name"], "left_anti").unionByName(star)
    twice = passed.where("name <> '*'").groupBy("module", "name").agg(F.count_distinct("source").alias("n")).where("n > 1").select("module", "name")
    shadowed = names.where("name <> '*'").join(own.select("module", "name").distinct(), ["module", "name"], "left_semi")
    parts = [rows.withColumn("problem", F.lit(problem)) for problem, rows in (("dead", dead), ("duplication", twice), ("shadowed", shadowed))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def similar_bodies(bodies: DataFrame, measures: tuple[str, ...], least: float = 0.85, most_bucket: int | None = 50) -> DataFrame:
    """``bodies(id, kind, hash, statements, ...)``: pairs ``a, b, similarity, severity`` of alike bodies in one bucket.

    A bucket holds bodies of one kind and about as many statements; one with
    more than ``most_bucket`` bodies is left out, which bounds the pairs but
    leaves nothing of large tables; None keeps all, and pairs are then as many
    as alike bodies have.  The
    similarity is the mean over ``measures`` of one less their difference as a
    share of the larger, 1 at least.
    """
    bucket = F.floor(F.col("statements") / 3 + 0.5)
    rows = bodies.withColumn("bucket", bucket)
    fit = rows.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 2) & ((F.col("n") <= most_bucket) if most_bucket is not None else F.lit(True))).select("kind", "bucket")
    rows = rows.join(fit, ["kind", "bucket"])
    columns = dict.fromkeys(("id", "hash", "statements", *measures))
    a = rows.select("kind", "bucket", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = rows.select("kind", "bucket", *[F.col(c).alias(f"{c}_b") for c in columns])
    same = lambda c: 1 - F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) / F.greatest(f"{c}_a", f"{c}_b", F.lit(1))
    mean = sum((same(c) for c in measures[1:]), same(measures[0])) / len(measures)
    pairs = a.join(b, ["kind", "bucket"]).where("id_a < id_b and hash_a <> hash_b and least(statements_a, statements_b) >= 0.8 * greatest(statements_a, statements_b)")
    found = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.round(mean, 6).alias("similarity")).where(F.col("similarity") >= least)
    return found.withColumn("severity", F.when(F.col("similarity") >= 0.95, "high").otherwise("medium"))


def scoped(findings: DataFrame, scope: str) -> DataFrame:
    """``findings(file, files, ...)`` of which the file or any related file is ``scope`` or lies below it."""
    inside = lambda f: (f == scope) | F.startswith(f, F.lit(scope.rstrip("/") + "/"))
    return findings.where(inside(F.col("file")) | F.exists("files", inside))


def with_issue_ids(files: DataFrame, findings: DataFrame) -> DataFrame:
    """``files(file)`` with ``issues``: the ids of their ``findings(id, file)``, sorted; none is an empty list.

    A file's findings are as many as its detectors give.
    """
    own = findings.groupBy("file").agg(F.array_sort(F.collect_list("id")).alias("issues"))
    return files.join(own, "file", "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<bigint>")))


def pressure(findings: DataFrame, files: int | Column) -> DataFrame:
    """``pressure``: weights of all findings by severity, a file; 0 without findings."""
    weight = F.lit(0.2)
    for name, w in SEVERITY_PRESSURE:
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    return findings.agg((F.coalesce(F.sum(weight), F.lit(0.0)) / F.greatest(F.lit(1), files if isinstance(files, Column) else F.lit(files))).alias("pressure"))


#: How much a finding of a severity presses.
SEVERITY_PRESSURE = (("critical", 1.0), ("high", 0.75), ("medium", 0.45), ("low", 0.2), ("info", 0.05))
#: Grades and confidence from a bound.
GRADES = ((80, "A"), (60, "B"), (40, "C"), (20, "D"))
CONFIDENCE = ((25, "high"), (8, "medium"))


def banded_by(value: Column, bounds: tuple, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for bound, name in reversed(bounds):
        out = F.when(value >= bound, name).otherwise(out)
    return out


def grade(score: Column) -> Column:
    return banded_by(score, GRADES, "F")


def confidence(n: Column) -> Column:
    return banded_by(n, CONFIDENCE, "low")


def soft_penalty(ratio: Column, most: float, sensitivity: float = 1.4) -> Column:
    """A penalty that rises to ``most`` and less with each further step, rounded half up; 0 for no ratio."""
    return F.when(ratio > 0, F.floor(most * (1 - F.exp(-ratio * sensitivity)) + 0.5)).otherwise(0).cast("long")


def severity_matrix(findings: DataFrame) -> DataFrame:
    """``pillar, critical, high, medium, low, info, total`` and a row ``all`` over all pillars."""
    count = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s, _ in SEVERITY_PRESSURE]
    rows = findings.rollup("pillar").agg(*count, F.count(F.lit(1)).alias("total"), F.grouping("pillar").alias("g"))
    return rows.select(F.when(F.col("g") == 1, "all").otherwise(F.col("pillar")).alias("pillar"), *[s for s, _ in SEVERITY_PRESSURE], "total")


def pillar_scores(findings: DataFrame, total_files: int) -> DataFrame:
    """``pillar, files, score, grade``: health by pillar.

    A pillar's files are those with findings, but a tenth of all at least and
    all at most.
    """
    from loomwork.operators import report

    weight = F.element_at(F.array(*map(F.lit, [*report.WEIGHTS, 0])), report.rank_of(F.col("severity")) + 1)
    sums = findings.groupBy("pillar").agg(F.sum(weight).alias("p"), F.min(report.rank_of(F.col("severity"))).alias("worst"), F.count_distinct("file").alias("covered"))
    files = F.greatest(F.ceil(F.lit(total_files * 0.1)), F.lit(1), F.least(F.lit(total_files), F.col("covered")))
    cap = F.when(F.col("worst") == 0, 95).when(F.col("worst") == 1, 98).otherwise(99)
    score = F.least(F.floor(100 / (1 + F.col("p") / F.col("files") / 10) + 0.5), cap).cast("long")
    return sums.withColumn("files", files.cast("long")).withColumn("score", score).select("pillar", "files", "score", grade(F.col("score")).alias("grade"))


def merged_sets(chains: DataFrame, least: float = 0.8) -> DataFrame:
    """``place, heads, members`` of chains merged in order of their place; see merges.merged_chains()."""
    return merges.merged_chains(chains, least)
