"""Detectors: each gives findings ``category, subject, severity`` with the measures that caused them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators import graph, report


def banded(value: Column, *bands: tuple[float, str], otherwise: str = "low") -> Column:
    """The severity of the first bound that ``value`` reaches."""
    out = F.lit(otherwise)
    for bound, name in reversed(bands):
        out = F.when(value >= bound, name).otherwise(out)
    return out


def coupling(nodes: DataFrame, edges: DataFrame, most: int = 15, high: int = 25) -> DataFrame:
    """Nodes with more than ``most`` edges: ``category, subject, severity, total``."""
    total = (F.col("incoming") + F.col("outgoing")).alias("total")
    found = graph.degrees(nodes, edges).select(F.lit("high-coupling").alias("category"), F.col("node").alias("subject"), total)
    return found.where(F.col("total") > most).withColumn("severity", F.when(F.col("total") > high, "high").otherwise("medium"))


def off_main_sequence(nodes: DataFrame, edges: DataFrame, abstract: DataFrame, least: float = 0.7, high: float = 0.85) -> DataFrame:
    """Nodes far from abstractness + instability = 1; ``abstract`` has node and share: ``subject, distance, severity``."""
    busy = graph.degrees(nodes, edges).where(F.col("incoming") + F.col("outgoing") >= 3)
    i = F.col("outgoing") / (F.col("outgoing") + F.col("incoming"))
    far = busy.join(abstract, "node").select(F.col("node").alias("subject"), F.round(F.abs(F.col("share") + i - 1), 6).alias("distance"))
    return far.where(F.col("distance") >= least).withColumn("severity", F.when(F.col("distance") > high, "high").otherwise("medium"))


def layer_violations(edges: DataFrame, names: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """Edges into an earlier layer; a node is in the first layer whose name its own name contains: ``src, dst, from_layer, to_layer``."""
    rank = F.lit(None).cast("int")
    for k in reversed(range(len(layers))):
        rank = F.when(F.contains("name", F.lit(layers[k])), k).otherwise(rank)
    ranked = names.select("node", rank.alias("layer")).where("layer is not null")
    s, t = ranked.select(F.col("node").alias("src"), F.col("layer").alias("a")), ranked.select(F.col("node").alias("dst"), F.col("layer").alias("b"))
    label = lambda c: F.element_at(F.array(*map(F.lit, layers)), F.col(c) + 1)
    return edges.join(s, "src").join(t, "dst").where("b < a").select("src", "dst", label("a").alias("from_layer"), label("b").alias("to_layer"))


def envy(uses: DataFrame, share: float = 0.6, least: int = 5, high: float = 0.8) -> DataFrame:
    """``uses(subject, target)``: subjects that draw most from one target: ``subject, target, n, share, severity``."""
    each = uses.groupBy("subject", "target").agg(F.count(F.lit(1)).alias("n"))
    part = F.col("n") / F.sum("n").over(Window.partitionBy("subject"))
    found = each.withColumn("share", F.round(part, 6)).where((F.col("share") >= share) & (F.col("n") >= least))
    return found.withColumn("severity", F.when(F.col("share") > high, "high").otherwise("medium"))


def mega_folders(files: DataFrame, least: int = 25, share: float = 0.25) -> DataFrame:
    """``files(folder)``: folders with many of all files: ``folder, n, share, severity``."""
    each = files.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    total = files.agg(F.count(F.lit(1))).scalar()
    found = each.withColumn("share", F.round(F.col("n") / total, 6))
    high = (F.col("share") >= 0.5) | (F.col("n") >= 50)
    return found.where((F.col("n") >= least) & (F.col("share") >= share)).withColumn("severity", F.when(high, "high").otherwise("medium"))


def repeated_literals(docs: DataFrame, pattern: str, least: int = 3) -> DataFrame:
    """``literal, n, n_docs, first_id, severity`` of what ``pattern`` matches at least ``least`` times in all texts."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("literal"))
    own = found.groupBy("literal", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    each = own.groupBy("literal").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_id"))
    return each.where(F.col("n") >= least).withColumn("severity", banded(F.col("n"), (8, "high"), (5, "medium")))


def correlated(findings: DataFrame, most: int = 8) -> DataFrame:
    """``id, signals``: the other categories found in the same file.  A file has no more categories than there are detectors."""
    own = findings.groupBy("file").agg(F.sort_array(F.collect_set("category")).alias("all"))
    others = F.slice(F.filter("all", lambda c: c != F.col("category")), 1, most)
    return findings.join(own, "file").select("id", F.array_join(others, ",").alias("signals"))


def category_scores(findings: DataFrame) -> DataFrame:
    """``category, n, files, score``: 100 without findings, falling with findings a file."""
    n = findings.groupBy("category", "file").agg(F.count(F.lit(1)).alias("n")).groupBy("category").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))
    return n.withColumn("score", F.floor(100 / (1 + F.col("n") / F.col("files") / 10) + 0.5).cast("long"))


def numbered(findings: DataFrame, prefix: str = "AST-ISSUE-") -> DataFrame:
    """``issue, id, category, severity``: running numbers over severity, category, id.

    Range partitions number their own rows; the partitions' sizes, one row
    each, give the offsets.  No task sees all rows.
    """
    rank = report.rank_of(F.col("severity"))
    dealt = findings.select("id", "category", "severity", rank.alias("r")).repartitionByRange("r", "category", "id")
    dealt = graph.written(dealt.withColumn("part", F.spark_partition_id()), [])
    own = dealt.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("r", "category", "id")))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # as many rows as partitions
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = (F.col("before") + F.col("k")).cast("string")
    issue = F.concat(F.lit(prefix), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))
    return own.join(sizes.select("part", before.alias("before")), "part").select(issue.alias("issue"), "id", "category", "severity")
