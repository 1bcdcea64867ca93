"""The heaviest dependency chains, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import graph


#: Score of a file without one.
NO_SCORE = 1.0


def critical_paths(files: DataFrame, edges: DataFrame, most: int = 12, *, closing: bool = False) -> DataFrame:
    """``start, path, score``: for the ``most`` heaviest starts, the chain of dependencies with the largest sum of ``files(node, score)``.

    A chain has two files at least; of equal sums the longer one counts, then
    the one over smaller nodes.  A null score counts as 1.  Edges within a
    strongly connected group are left out, so a chain never turns back.  With
    ``closing``, a chain may end with one such edge: it leads into a cycle, and
    the file at its end counts half.  Rounds are as many as the longest chain
    has edges; in each, a file takes over the best of what it depends on.
    """
    folder: list[str] = []
    at = graph.strong_components(files.select("node"), edges)
    s, t = at.select(F.col("node").alias("src"), F.col("component").alias("a")), at.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    links = graph.written(edges.join(s, "src").join(t, "dst").where("a <> b").select("src", "dst").distinct(), folder)
    own = F.coalesce(F.col("score").cast("double"), F.lit(NO_SCORE))
    best = files.select("node", own.alias("own"), own.alias("least"), F.lit(1).alias("least_n"), F.lit(None).cast("long").alias("end"))
    if closing:  # where a chain enters a cycle and ends
        inner = edges.join(s, "src").join(t, "dst").where("a = b and src <> dst").select("src", "dst").distinct()
        ends = inner.join(files.select(F.col("node").alias("dst"), (own / 2).alias("half")), "dst")
        ends = ends.groupBy(F.col("src").alias("node")).agg(F.max(F.struct("half", (-F.col("dst")).alias("d"))).alias("m"))
        best = best.join(ends, "node", "left").select(
            "node", "own", (F.col("own") + F.coalesce("m.half", F.lit(0.0))).alias("least"), F.when(F.col("m").isNull(), 1).otherwise(2).alias("least_n"), (-F.col("m.d")).alias("end")
        )
    best = graph.written(best.select("*", F.col("least").alias("sum"), F.col("least_n").alias("n"), F.lit(None).cast("long").alias("next")), folder)
    while True:
        below = best.select(F.col("node").alias("dst"), F.col("sum").alias("s"), F.col("n").alias("k"))
        step = links.join(below, "dst").groupBy(F.col("src").alias("node")).agg(F.max(F.struct("s", "k", (-F.col("dst")).alias("d"))).alias("m"))
        on = best.join(step, "node", "left").withColumn("s", F.col("own") + F.col("m.s")).withColumn("k", 1 + F.col("m.k"))
        goes = F.coalesce(F.struct("s", "k") > F.struct(F.col("least").alias("s"), F.col("least_n").alias("k")), F.lit(False)) & F.col("m").isNotNull()
        new = on.select(
            "node", "own", "least", "least_n", "end", F.when(goes, F.col("s")).otherwise(F.col("least")).alias("sum"), F.when(goes, F.col("k")).otherwise(F.col("least_n")).alias("n"),
            F.when(goes, -F.col("m.d")).alias("next"), F.col("sum").alias("before_sum"), F.col("n").alias("before_n")
        )
        new = graph.written(new, folder)
        best = new.drop("before_sum", "before_n")
        if new.where("sum <> before_sum or n <> before_n").isEmpty():
            break
    top = best.where("n > 1").orderBy(F.desc("sum"), F.desc("n"), "node").limit(most)
    closed = F.when(F.col("next").isNull(), F.col("end"))
    paths = graph.written(top.select(F.col("node").alias("start"), F.array("node").alias("path"), F.col("sum").alias("score"), "next", closed.alias("end")), folder)
    ahead = best.select(F.col("node").alias("at"), F.col("next").alias("after"), closed.alias("last"))
    while not paths.where("next is not null").isEmpty():
        moved = paths.join(ahead, F.col("next") == F.col("at"), "left")
        path = F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path"))
        paths = graph.written(moved.select("start", path.alias("path"), "score", F.col("after").alias("next"), F.coalesce("end", "last").alias("end")), folder)
    whole = F.when(F.col("end").isNotNull(), F.concat("path", F.array("end"))).otherwise(F.col("path"))
    return paths.select("start", whole.alias("path"), "score")


def chain_findings(paths: DataFrame, threshold: float = 30, most: int = 10) -> DataFrame:
    """Of the first ``most`` chains, those of three times the threshold: ``start, path, score, severity``, critical from six times."""
    first = paths.orderBy(F.desc("score"), F.desc(F.size("path")), "start").limit(most).where(F.col("score") >= 3 * threshold)
    return first.withColumn("severity", F.when(F.col("score") >= 6 * threshold, "critical").otherwise("high"))


def hotspots(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """``start, node, outgoing``: the file of each chain with the most dependencies; the first of equals."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outgoing"))
    each = paths.select("start", F.posexplode("path").alias("k", "node")).join(out, "node", "left").fillna(0, ["outgoing"])
    return each.groupBy("start").agg(F.max(F.struct("outgoing", (-F.col("k")).alias("k"), "node")).alias("m")).select("start", "m.node", "m.outgoing")
