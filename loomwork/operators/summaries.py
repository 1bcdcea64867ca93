"""Scores by category, context of findings, duplicated bodies, dependency records, and chosen paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import paths as P
from loomwork.operators import report
from loomwork.operators.code_findings import grade
from loomwork.operators.shape import glob_pattern

#: What a hot file among a category's files costs by the largest risk, and the most that all cost.
RISK_COSTS, LEAST_COST, MOST_COST = ((90, 10), (75, 7), (60, 4)), 2, 20


def feature_scores(findings: DataFrame, hot: DataFrame) -> DataFrame:
    """``place, category, n, files, hot_files, penalty, score, grade``: health of each category, less what its hot files cost; the worst first.

    ``findings(category, severity, file)``, ``hot(file, risk)``.  Health falls with
    weighted findings a file with findings and is capped by the worst severity.
    """
    rank = report.rank_of(F.col("severity"))
    weight = F.element_at(F.array(*map(F.lit, [*report.WEIGHTS, 0])), rank + 1)
    risks = hot.where("risk > 0").groupBy("file").agg(F.max("risk").alias("risk"))
    each = findings.groupBy("category", "file").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("p"), F.min(rank).alias("worst"))
    sums = each.join(risks, "file", "left").groupBy("category").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.min("worst").alias("worst"), F.count("file").alias("files"), F.count("risk").alias("hot_files"), F.coalesce(F.max("risk"), F.lit(0)).alias("risk")
    )
    files = F.greatest("files", F.lit(1))
    cap = F.when(F.col("worst") == 0, 95).when(F.col("worst") == 1, 98).otherwise(99)
    health = F.least(F.floor(100 / (1 + F.col("p") / files / 10) + 0.5), cap)
    cost = reduce(lambda rest, rc: F.when(F.col("risk") >= rc[0], rc[1]).otherwise(rest), reversed(RISK_COSTS), F.lit(LEAST_COST))
    penalty = F.when(F.col("hot_files") == 0, 0).otherwise(F.least(F.lit(MOST_COST), F.floor(F.col("hot_files") / files * 10 + cost + 0.5)))
    scored = sums.withColumn("penalty", penalty.cast("long")).withColumn("score", F.greatest(F.lit(0), health - F.col("penalty")).cast("long"))
    # categories are as many as there are detectors, so one array orders them
    row = F.struct("score", (-F.col("n")).alias("order"), "category", "n", "files", "hot_files", "penalty", grade(F.col("score")).alias("grade"))
    placed = scored.agg(F.sort_array(F.collect_list(row)).alias("rows")).select(F.posexplode("rows").alias("k", "r"))
    return placed.select((F.col("k") + 1).alias("place"), *[f"r.{c}" for c in ("category", "n", "files", "hot_files", "penalty", "score", "grade")])


def with_context(findings: DataFrame, hot: DataFrame, cyclic: DataFrame, critical: DataFrame, effects: DataFrame, most: int = 8) -> DataFrame:
    """``id, signals``: what else is known of a finding's file: hot, on a cycle, on a critical path, with effects on import, and the other categories found in it.

    The first ``most`` signals count.  ``hot, cyclic, critical, effects`` have a column ``file``.
    """
    rows = findings.join(findings.groupBy("file").agg(F.sort_array(F.collect_set("category")).alias("all")), "file", "left")
    names = {"hot-file": hot, "cycle-context": cyclic, "critical-path-context": critical, "top-level-effects": effects}
    for k, files in enumerate(names.values()):
        rows = rows.join(files.select("file").distinct().withColumn(f"s{k}", F.lit(True)), "file", "left")
    own = F.array_compact(F.array(*[F.when(F.col(f"s{k}"), name) for k, name in enumerate(names)]))
    others = F.transform(F.filter(F.coalesce("all", F.array().cast("array<string>")), lambda c: c != F.col("category")), lambda c: F.concat(F.lit("paired:"), c))
    return rows.select("id", F.array_join(F.slice(F.concat(own, others), 1, most), ",").alias("signals"))


def duplicate_bodies(bodies: DataFrame, least: int = 2, shown: int = 20) -> DataFrame:
    """``hash, kind, n, files, severity, places`` of bodies that occur ``least`` times: ``bodies(hash, kind, file, line)``.

    ``places`` are the first ``shown`` by file and line (the feature); all are
    counted.  Each task keeps its first ones only, so a body of very many copies
    is no large row.
    """
    from pyspark.sql import Window

    place = Window.partitionBy("hash", "kind").orderBy("file", "line")
    first = bodies.withColumn("k", F.row_number().over(place)).where(F.col("k") <= shown)
    first = first.groupBy("hash", "kind").agg(F.sort_array(F.collect_list(F.struct("k", F.concat_ws(":", "file", F.col("line").cast("string")).alias("at")))).alias("p"))
    each = bodies.groupBy("hash", "kind", "file").agg(F.count(F.lit(1)).alias("n")).groupBy("hash", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))
    found = each.where(F.col("n") >= least).join(first, ["hash", "kind"])
    severity = F.when(F.col("n") >= 6, "high").when(F.col("n") >= 3, "medium").otherwise("low")
    return found.select("hash", "kind", "n", "files", severity.alias("severity"), F.array_join("p.at", ",").alias("places"))


def dependency_records(files: DataFrame, edges: DataFrame, externals: DataFrame, unresolved: DataFrame) -> DataFrame:
    """``files(node, path)``: ``node, outgoing, incoming, from_production, from_tests, externals, unresolved``, each of different names.

    ``externals`` and ``unresolved`` have ``node, specifier``.
    """
    links = edges.select("src", "dst").distinct()
    by = links.join(files.select(F.col("node").alias("src"), P.is_test(F.col("path")).alias("test")), "src")
    into = by.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("incoming"), F.count_if(~F.col("test")).alias("from_production"), F.count_if("test").alias("from_tests"))
    rows = files.select("node").join(links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outgoing")), "node", "left").join(into, "node", "left")
    for name, table in (("externals", externals), ("unresolved", unresolved)):
        rows = rows.join(table.groupBy("node").agg(F.count_distinct("specifier").alias(name)), "node", "left")
    names = ["outgoing", "incoming", "from_production", "from_tests", "externals", "unresolved"]
    return rows.select("node", *names).fillna(0, names)


def critical_nodes(records: DataFrame, scores: DataFrame, most: int = 150) -> DataFrame:
    """``node, score, band, incoming, outgoing`` of files that score above 12, depend on more than 5 or have more than 8 dependants; the ``most`` weightiest.

    ``scores(node, score)``; a file without one scores 0.
    """
    rows = records.join(scores.select("node", "score"), "node", "left").fillna(0, ["score"])
    busy = rows.where((F.col("score") > 12) | (F.col("outgoing") > 5) | (F.col("incoming") > 8))
    band = F.when(F.col("score") >= 60, "high").when(F.col("score") >= 30, "medium").otherwise("low")
    # tenths as whole numbers, so that ties are ties
    weight = F.col("score") * 10 + F.col("incoming") * 8 + F.col("outgoing") * 4
    return busy.orderBy(weight.desc(), "node").limit(most).select("node", "score", band.alias("band"), "incoming", "outgoing")


#: Endings of the files of a type.
TYPES = {
    "ts": ("ts", "tsx", "mts", "cts"), "js": ("js", "jsx", "mjs", "cjs"), "py": ("py", "pyi"), "go": ("go",), "rust": ("rs",), "java": ("java",), "css": ("css", "scss"), "html": ("html", "htm"), "json": ("json",), "md": ("md", "markdown"),
}


def chosen_path(
    path: Column, *, kind: str | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), exclude_folders: tuple[str, ...] = (), hidden: bool = False
) -> Column:
    """Whether a search looks at a path.

    Of a type, by its ending; in one of the ``include`` globs, if there are any,
    and none of ``exclude``; below none of ``exclude_folders``; and without a
    hidden part, unless ``hidden``.  A glob without a slash is met by the name.
    """

    def meets(globs: tuple[str, ...]) -> Column:
        whole, names = [g for g in globs if "/" in g], [g for g in globs if "/" not in g]
        found = F.lit(False)
        for own, against in ((whole, path), (names, F.substring_index(path, "/", -1))):
            if own:
                found = found | against.rlike("|".join(f"(?:{glob_pattern(g)})" for g in own))
        return found

    parts = F.split(path, "/")
    chosen = F.lit(True)
    if kind is not None:
        chosen = chosen & F.substring_index(path, ".", -1).isin(*TYPES[kind]) & F.contains(path, F.lit("."))
    if include:
        chosen = chosen & meets(include)
    if exclude:
        chosen = chosen & ~meets(exclude)
    if exclude_folders:
        chosen = chosen & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, exclude_folders)))
    return chosen if hidden else chosen & ~F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".", ".."))
