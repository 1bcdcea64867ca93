"""Graph measures over ``edges(src, dst)``."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame, folder: list[str]) -> DataFrame:
    """``df`` written to the shared folder and read back, so that lineage ends here."""
    spark = df.sparkSession
    if not folder:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:  # a folder of this machine only where all tasks run in its own process, as in tests
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="loomwork-")
        folder.append(f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}")
    path = f"{folder[0]}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, outgoing, incoming, kind`` with kind root, leaf, orphan or inner."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outgoing"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("incoming"))
    both = nodes.join(out, "node", "left").join(into, "node", "left").fillna(0, ["outgoing", "incoming"])
    o, i = F.col("outgoing") > 0, F.col("incoming") > 0
    kind = F.when(o & i, "inner").when(o, "root").when(i, "leaf").otherwise("orphan")
    return both.withColumn("kind", kind)


def instability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, instability``: outgoing share of all edges, 0 without any."""
    d = degrees(nodes, edges)
    total = F.col("outgoing") + F.col("incoming")
    return d.select("node", F.when(total > 0, F.col("outgoing") / total).otherwise(0.0).alias("instability"))


def unstable_dependencies(nodes: DataFrame, edges: DataFrame, gap: float = 0.15, most: float = 0.6) -> DataFrame:
    """Edges from a stable to a clearly less stable node: ``src, dst, delta, severity``."""
    i = instability(nodes, edges)
    s, t = i.select(F.col("node").alias("src"), F.col("instability").alias("si")), i.select(F.col("node").alias("dst"), F.col("instability").alias("ti"))
    delta = F.col("ti") - F.col("si")
    found = edges.join(s, "src").join(t, "dst").where((delta > gap) & (F.col("si") < most))
    return found.select("src", "dst", F.round(delta, 6).alias("delta"), F.when(delta > 0.3, "high").otherwise("medium").alias("severity"))


def written_counting(df: DataFrame, folder: list[str], what: Column) -> tuple[DataFrame, int]:
    """As written(), and on how many rows ``what`` is true."""
    saved = written(df, folder)
    return saved, saved.where(what).count()


def reachable(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """``node, hops``: nodes reachable from ``seeds(node)`` and the fewest hops.  Cycles are allowed."""
    folder: list[str] = []
    return walked(written(edges.select("src", "dst"), folder), seeds, most, folder)


def walked(edges: DataFrame, seeds: DataFrame, most: int | None, folder: list[str]) -> DataFrame:
    """reachable() over edges that are written; repeated ones do no harm."""
    front = written(seeds.select("node").distinct().withColumn("hops", F.lit(0)), folder)
    seen, k = front, 0
    while most is None or k < most:
        k += 1
        step = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front, n = written_counting(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k)), folder, F.lit(True))
        if not n:
            break
        seen = seen.unionByName(front)
    return seen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node of each undirected component.

    Each round, every node takes the smallest node next to it, if that is
    smaller, and chains of these are followed to their ends by doubling.  What
    ends at one node is one node from then on, and only edges between different
    ones stay, so later rounds are small.
    """
    folder: list[str] = []
    return written_components(nodes, written(edges.select("src", "dst").where("src <> dst"), folder), folder)


def lowest(links: DataFrame) -> DataFrame:
    """``node, up``: the smallest of each node and those next to it."""
    both = links.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(links.select("dst", "src"))
    return both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))


def written_components(nodes: DataFrame, links: DataFrame, folder: list[str]) -> DataFrame:
    """components() over edges that are written, without loops and null ends; repeated ones do no harm."""
    own = nodes.select("node").where("node is not null")
    up = written(lowest(links), folder)
    if not up.join(own, "node", "left_anti").isEmpty():  # edges of other nodes don't count
        links = links.join(own.select(F.col("node").alias("src")), "src", "left_semi").join(own.select(F.col("node").alias("dst")), "dst", "left_semi")
        links = written(links.select("src", "dst"), folder)
        up = written(lowest(links), folder)
    label = own.withColumn("component", F.col("node"))
    while True:
        moved = 1
        while moved:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up, moved = written_counting(up.join(above, "up").select("node", "up", "top"), folder, F.col("top") < F.col("up"))
            up = up.select("node", F.col("top").alias("up"))
        label = label.join(up.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        s, t = up.select(F.col("node").alias("src"), F.col("up").alias("s")), up.select(F.col("node").alias("dst"), F.col("up").alias("t"))
        apart = links.join(s, "src").join(t, "dst").where("s <> t").select(F.least("s", "t").alias("src"), F.greatest("s", "t").alias("dst")).distinct()
        links, n = written_counting(apart, folder, F.lit(True))
        if not n:
            return written(label, folder)
        up = written(lowest(links), folder)


def rolled_up(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Edges between groups with their weights: ``src_group, dst_group, weight``; ``group`` has node and grp."""
    s = group.select(F.col("node").alias("src"), F.col("grp").alias("src_group"))
    t = group.select(F.col("node").alias("dst"), F.col("grp").alias("dst_group"))
    return edges.join(s, "src").join(t, "dst").where("src_group <> dst_group").groupBy("src_group", "dst_group").agg(F.count(F.lit(1)).alias("weight"))


def backward(edges: DataFrame) -> DataFrame:
    """Edges turned around: what depends on a node instead of what it depends on."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``node, hops``: ``changed(node)`` and everything that depends on it, directly or not."""
    return reachable(backward(edges), changed)


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``node, hops``: nodes within ``hops`` of the seeds, in either direction."""
    folder: list[str] = []
    links = written(edges.select("src", "dst"), folder)
    return walked(links.unionByName(backward(links)), seeds, hops, folder)


#: Share of nodes from which those without an edge in or out are taken away before a round.
TRIM = 0.01


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node of each strongly connected component.

    Each round, the smallest ancestor's id colours every node; a colour's
    members that lead back to the node of that id are one component and leave.
    A colour is an ancestor itself, so nodes also take the colour of their
    colour, which halves long ways.
    """
    folder: list[str] = []
    left = written(edges.select("src", "dst").where("src <> dst"), folder)
    found = []
    while True:
        sides = left.select(F.col("dst").alias("node"), F.col("src").alias("up"), F.lit(False).alias("out")).union(left.select("src", F.lit(None).cast(left.schema["src"].dataType), F.lit(True)))
        sides = sides.groupBy("node").agg(F.min("up").alias("up"), F.max("out").alias("out"))
        sides, n = written_counting(sides, folder, F.lit(True))
        if not n:
            break
        alone = sides.where("up is null or not out").select("node")
        if alone.count() > TRIM * n:
            inner = left.join(alone.select(F.col("node").alias("src")), "src", "left_anti").join(alone.select(F.col("node").alias("dst")), "dst", "left_anti")
            left = written(inner.select("src", "dst"), folder)
            continue
        stepped = sides.select("node", F.least("node", F.coalesce("up", "node")).alias("c"))
        while True:
            colours = written(stepped.join(stepped.select(F.col("node").alias("c"), F.col("c").alias("above")), "c").select("node", F.least("c", "above").alias("c")), folder)
            low = left.join(colours.select(F.col("node").alias("src"), F.col("c").alias("up")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("up").alias("up"))
            new = colours.join(low, "node", "left").select("node", F.col("c").alias("old"), F.least("c", F.coalesce("up", "c")).alias("c"))
            new, moved = written_counting(new, folder, F.col("c") < F.col("old"))
            stepped = new.select("node", "c")
            if not moved:
                break
        members = front = written(colours.where("node = c"), folder)
        while True:
            step = left.join(front.select(F.col("node").alias("dst"), "c"), "dst").select(F.col("src").alias("node"), "c").distinct()
            step = step.join(colours, ["node", "c"], "left_semi").join(members.select("node"), "node", "left_anti")
            front, n = written_counting(step.select("node", "c"), folder, F.lit(True))
            if not n:
                break
            members = members.unionByName(front)
        found.append(members.select("node", F.col("c").alias("component")))
        rest, n = written_counting(colours.join(members.select("node"), "node", "left_anti").select("node", "c"), folder, F.lit(True))
        if not n:
            break
        s, t = rest.select(F.col("node").alias("src"), F.col("c").alias("sc")), rest.select(F.col("node").alias("dst"), F.col("c").alias("tc"))
        left = written(left.join(s, "src").join(t, "dst").where("sc = tc").select("src", "dst"), folder)
    if not found:
        return nodes.select("node", F.col("node").alias("component"))
    known = reduce(DataFrame.unionByName, found)
    return written(nodes.select("node").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component")), folder)
