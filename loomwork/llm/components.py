"""Connected components of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, remove, save, save_counting, scratch


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for each node of ``links(a, b)``.

    Each round joins every node to the smallest label around it and then to
    that label's own label, so paths shrink to stars in a logarithmic number of
    rounds in practice.  Labels are reduced with partial aggregation, so a node
    with very many links is no hot key.  Of few links the labels are broadcast
    and a round shuffles once.  Loops and repeated links are allowed; null ends
    are ignored; no links give an empty result.
    """
    spark, folder = links.sparkSession, scratch(links.sparkSession)
    links = links.where("a is not null and b is not null")
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
    edges, n = save_counting(both, f"{folder}/edges", F.lit(True))
    near = F.broadcast if n <= BROADCAST_ROWS else lambda rows: rows  # there are no more labels than edges
    labels = save(edges.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("component")), f"{folder}/labels0")
    k = 0
    while True:
        # labels are nodes of their component, so they are final as soon as no edge lies between two of them
        ends = [near(labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))) for x in ("a", "b")]
        if edges.join(ends[0], "a").join(ends[1], "b").where("of_a <> of_b").isEmpty():
            return labels
        k += 1
        of = near(labels.select(F.col("node").alias("at"), F.col("component").alias("above")))
        around = edges.join(of, F.col("b") == F.col("at")).select(F.col("a").alias("node"), F.col("above").alias("c"))
        low = around.unionByName(labels.select("node", F.col("component").alias("c"))).groupBy("node").agg(F.min("c").alias("c"))
        new = low.join(of, F.col("c") == F.col("at"), "left").select("node", F.least("c", "above").alias("component"))
        labels = save(new, f"{folder}/labels{k}")
        remove(spark, f"{folder}/labels{k - 1}")
