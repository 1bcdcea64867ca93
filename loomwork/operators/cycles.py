"""Dependency cycles as paths, by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import graph


def simple_cycles(edges: DataFrame, most: int, groups: DataFrame | None = None) -> DataFrame:
    """``cycle, node_count``: every cycle of up to ``most`` nodes that passes no node twice, from its smallest node on.

    Paths grow by one edge a round, away from their first node and only over
    larger ones, so each cycle is found once; paths that an edge leads back to
    their first node are cycles.  ``groups(node, component)``, such as strong
    components, spares edges that lie on no cycle.  An edge from a node to
    itself is a cycle of one.  Null ends are no edges; repeated edges count once.
    """
    folder: list[str] = []
    links = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    if groups is not None:
        s, t = (groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group")) for c in ("src", "dst"))
        links = links.join(s, "src").join(t, "dst").where("src_group = dst_group").select("src", "dst")
    links = graph.written(links, folder)
    onward, home = links.where("src <> dst"), links.select(F.col("src").alias("last"), F.col("dst").alias("n0")).hint("shuffle_hash")
    paths = links.select(F.col("src").alias("n0")).distinct().select("n0", F.col("n0").alias("last"))
    found = []
    for n in range(1, most + 1):
        own = [f"n{k}" for k in range(n - 1)] + ["last"]
        found.append(paths.join(home, ["n0", "last"], "left_semi").select(F.array(*own).alias("cycle"), F.lit(n).alias("node_count")))
        if n < most:  # the longest paths are many, and only those that close are kept
            step = onward.select(F.col("src").alias("last"), F.col("dst").alias("next"))
            grown = paths.join(step, "last").where((F.col("next") > F.col("n0")) & ~F.col("next").isin(*[F.col(c) for c in own]))
            grown = grown.select(*own[:-1], F.col("last").alias(f"n{n - 1}"), F.col("next").alias("last")) if n > 1 else grown.select("n0", F.col("next").alias("last"))
            paths = grown if n + 1 == most else graph.written(grown, folder)
    return reduce(DataFrame.unionByName, found)


def cycle_text(cycle, arrow: str = " -> "):
    """The nodes of a cycle and its first one again."""
    return F.concat_ws(arrow, F.concat(cycle, F.slice(cycle, 1, 1)).cast("array<string>"))


def cycle_findings(cycles: DataFrame, lines: DataFrame, most: int = 15) -> DataFrame:
    """Findings of the first ``most`` cycles, the longest first, then by their nodes: ``category, severity, file, line, title, reason``.

    ``lines(src, dst, line)`` has where a dependency stands; the first line of
    the cycle's first edge counts, 1 if none is known.
    """
    first = cycles.orderBy(F.desc("node_count"), "cycle").limit(most)
    ends = graph.written(first, []).withColumns({"file": F.col("cycle")[0], "next": F.coalesce(F.get("cycle", F.lit(1)), F.col("cycle")[0])})
    stand = lines.select(F.col("src").alias("file"), F.col("dst").alias("next"), "line").join(F.broadcast(ends.select("file", "next")), ["file", "next"], "left_semi")
    at = stand.groupBy("file", "next").agg(F.min("line").alias("line"))
    title = F.format_string("Dependency cycle detected (%d node cycle)", "node_count")
    return ends.join(at, ["file", "next"], "left").select(
        F.lit("dependency-cycle").alias("category"),
        F.lit("high").alias("severity"),
        "file",
        F.coalesce("line", F.lit(1)).alias("line"),
        title.alias("title"),
        F.concat(F.lit("Import cycle exists across: "), cycle_text(F.col("cycle"))).alias("reason"),
    )
