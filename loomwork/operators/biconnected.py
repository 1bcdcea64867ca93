"""Bridges, articulation points and chokepoints of a graph, as joins.

A breadth-first forest gives each node a parent.  Each other edge closes a
cycle with the two tree paths from its ends to where they meet.  No such edge
leads to an ancestor, so all those at one node pass the tree edge above it:
what hangs together over other edges alone is of one block, and with it the
tree edges between its nodes.  These are found by carrying, level by level,
how many nodes of each such part lie below a tree edge: some, but not all.
Parts that share a tree edge are one block.  Tree edges of no part are
bridges, and nodes whose tree edges lie in several blocks are articulation
points.  Rounds are as many as the forest is deep.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import graph


def undirected(edges: DataFrame) -> DataFrame:
    """``a, b`` with a < b: each pair once; loops and null ends don't count."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def forest(nodes: DataFrame, pairs: DataFrame, folder: list[str]) -> tuple[DataFrame, int]:
    """``node, parent, level``: from the smallest node of each component, parents are the smallest of the level above; and how many levels there are."""
    links = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    roots = graph.written_components(nodes, links, folder).where("node = component").select("node")
    both = links.union(graph.backward(links))
    front = graph.written(roots.select("node", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level")), folder)
    seen, level = front, 0
    while True:
        level += 1
        step = both.join(front.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        front, n = graph.written_counting(step.join(seen.select("node"), "node", "left_anti").select("node", "parent", F.lit(level).alias("level")), folder, F.lit(True))
        if not n:
            return graph.written(seen, folder), level
        seen = seen.unionByName(front)


def blocks(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree edges ``node, parent, block``, named by their lower ends, with a null block for a bridge, and the forest."""
    folder: list[str] = []
    pairs = graph.written(undirected(edges), folder)
    tree, levels = forest(nodes, pairs, folder)
    own = tree.where("parent is not null").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    rest = graph.written(pairs.join(own, ["a", "b"], "left_anti").select(F.col("a").alias("src"), F.col("b").alias("dst")), folder)
    ends = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
    part = graph.written_components(ends, rest, folder).withColumnRenamed("component", "part")
    total = graph.written(part.groupBy("part").agg(F.count(F.lit(1)).alias("total")), folder)
    placed = graph.written(part.join(tree, "node").select("node", "parent", "level", "part", F.lit(1).cast("long").alias("n")), folder)
    above, marks = tree.select("node", F.col("parent").alias("next"), "level"), None
    carried = placed.where("false").select("node", "parent", "part", "n")
    for level in range(levels - 1, 0, -1):
        here = placed.where(F.col("level") == level).select("node", "parent", "part", "n").unionByName(carried)
        here = here.groupBy("node", "parent", "part").agg(F.sum("n").alias("n")).join(total, "part")
        passed = graph.written(here.where("n < total").select("node", "parent", "part", "n"), folder)
        marks = passed.select("node", "part") if marks is None else marks.unionByName(passed.select("node", "part"))
        up = above.where(F.col("level") == level - 1).select(F.col("node").alias("parent"), "next")
        carried = passed.join(up, "parent").select(F.col("parent").alias("node"), F.col("next").alias("parent"), "part", "n")
    if marks is None:
        return tree.where("parent is not null").select("node", "parent", F.lit(None).cast("long").alias("block")), tree
    least = graph.written(marks.groupBy("node").agg(F.min("part").alias("least"), F.count(F.lit(1)).alias("n")), folder)
    links = marks.join(least.where("n > 1"), "node").where("part <> least").select(F.col("part").alias("src"), F.col("least").alias("dst")).distinct()
    named = graph.components(total.select(F.col("part").alias("node")), links).select(F.col("node").alias("least"), F.col("component").alias("block"))
    return tree.where("parent is not null").select("node", "parent").join(least.join(named, "least").select("node", "block"), "node", "left"), tree


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``a, b``: pairs without which their component falls apart."""
    return lone_edges(blocks(nodes, edges)[0])


def lone_edges(found: DataFrame) -> DataFrame:
    """The bridges of the tree edges of blocks()."""
    return found.where("block is null").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))


def articulation_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``: nodes without which their component falls apart."""
    return shared_ends(blocks(nodes, edges)[0])


def shared_ends(found: DataFrame) -> DataFrame:
    """The articulation points of the tree edges of blocks()."""
    block = F.coalesce(F.concat(F.lit("b"), F.col("block").cast("string")), F.concat(F.lit("t"), F.col("node").cast("string")))
    ends = found.select(F.explode(F.array("node", "parent")).alias("x"), block.alias("block"))
    return ends.groupBy(F.col("x").alias("node")).agg(F.count_distinct("block").alias("n")).where("n > 1").select("node")


def chokepoints(files: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """``node, score, reasons`` of chokepoint_rows()."""
    return chokepoint_rows(files, edges, most).select("node", "score", "reasons")


def chokepoint_rows(files: DataFrame, edges: DataFrame, most: int = 40, strong: DataFrame | None = None) -> DataFrame:
    """``files(node, criticality)``: the ``most`` files that much hangs on: ``node, score, reasons, incoming, outgoing, cut, bridges``.

    score = 3 dependants + 1.2 dependencies + criticality / 10 + 12 for an
    articulation point + 4 a bridge + 6 in a cycle, rounded half up.  A file
    needs a reason: 8 dependants, 6 dependencies, a part in the graph's shape,
    or a criticality of 20.  ``strong(node, component)`` are the strong
    components, if they are known.
    """
    folder: list[str] = []
    nodes, edges = files.select("node"), graph.written(edges.select("src", "dst"), folder)
    found = graph.written(blocks(nodes, edges)[0], folder)
    cut = shared_ends(found).withColumn("cut", F.lit(1))
    ends = lone_edges(found).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("bridges"))
    strong = graph.strong_components(nodes, edges) if strong is None else strong
    cyclic = strong.join(strong.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "component").select("node", F.lit(1).alias("cycles"))
    rows = graph.degrees(files.select("node", "criticality"), edges)
    for part in (cut, ends, cyclic):
        rows = rows.join(part, "node", "left")
    rows = rows.fillna(0, ["cut", "bridges", "cycles"])
    score = F.floor(3 * F.col("incoming") + 1.2 * F.col("outgoing") + F.col("criticality") / 10 + 12 * F.col("cut") + 4 * F.col("bridges") + 6 * F.col("cycles") + 0.5)
    tests = (("incoming", 8, "fan-in"), ("outgoing", 6, "fan-out"), ("cut", 1, "articulation"), ("bridges", 1, "bridges"), ("cycles", 1, "cycle"), ("criticality", 20, "complexity"))
    reasons = F.concat_ws(",", *[F.when(F.col(c) >= least, name) for c, least, name in tests])
    shown = rows.select("node", score.cast("long").alias("score"), reasons.alias("reasons"), "incoming", "outgoing", "cut", "bridges")
    return shown.where("reasons <> ''").orderBy(F.desc("score"), "node").limit(most)


def graph_findings(points: DataFrame, clusters: DataFrame, chatter: DataFrame, effects: DataFrame) -> DataFrame:
    """``category, severity, file, detail`` of what a graph's shape says, from short ranked lists.

    ``points`` is chokepoint_rows(); ``clusters(component, n)`` has groups of
    files in cycles, ``chatter(src_group, dst_group, weight)`` edges between
    packages, ``effects(node)`` files that do something when they are imported.
    Brokers are among the first eight points, and so are bridges among the cut
    points; six clusters of three files and five pairs of packages with four
    edges at least.
    """
    text = lambda c: F.col(c).cast("string")

    def rows(df: DataFrame, category: str, high: Column, file: Column, detail: Column) -> DataFrame:
        severity = F.when(high, "high").otherwise("medium")
        return df.select(F.lit(category).alias("category"), severity.alias("severity"), file.alias("file"), detail.alias("detail"))

    points = graph.written(points, [])
    ranked = points.orderBy(F.desc("score"), "node")
    busy = ranked.limit(8).where("incoming >= 3 and outgoing >= 3 and score >= 18")
    cuts = ranked.where("cut = 1").limit(8)
    hubs = points.join(effects.select("node").distinct(), "node", "left_semi").where("incoming >= 8 and score >= 18")
    rings = clusters.where("n >= 3").orderBy(F.desc("n"), "component").limit(6)
    talks = chatter.where("weight >= 4").orderBy(F.desc("weight"), "src_group", "dst_group").limit(5)
    parts = [
        rows(rings, "cycle-cluster", F.col("n") >= 5, text("component"), F.concat(text("n"), F.lit(" files"))),
        rows(busy, "broker-module", (F.col("cut") == 1) | (F.col("score") >= 30), text("node"), F.col("reasons")),
        rows(cuts, "bridge-module", F.col("bridges") >= 2, text("node"), F.concat(text("bridges"), F.lit(" bridge edges"))),
        rows(talks, "package-boundary-chatter", F.col("weight") >= 8, text("src_group"), F.concat(text("dst_group"), F.lit(": "), text("weight"), F.lit(" edges"))),
        rows(hubs, "startup-risk-hub", F.col("score") >= 30, text("node"), F.concat(text("incoming"), F.lit(" dependants"))),
    ]
    return reduce(DataFrame.unionByName, parts)
