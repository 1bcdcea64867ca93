"""Cohesion of modules by which of their symbols are imported together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import graph


def symbol_groups(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """``module, name, grp`` of each imported export: symbols that one consumer imports together, directly or over others, share a group.

    ``exports(module, name)``, ``imports(consumer, module, name)``; imports of
    names that a module does not export don't count.  Each consumer ties its
    symbols of a module to the smallest of them, so links are as many as imports.
    """
    folder: list[str] = []
    used = imports.join(exports.select("module", "name").distinct(), ["module", "name"], "left_semi").select("consumer", "module", "name").distinct()
    used = graph.written(used, folder)
    symbols = graph.written(used.select("module", "name").distinct().withColumn("node", F.monotonically_increasing_id()), folder)
    first = used.groupBy("consumer", "module").agg(F.min("name").alias("least"))
    ties = used.join(first, ["consumer", "module"]).where("name <> least").select("module", "name", "least").distinct()  # consumers repeat them
    links = ties.join(symbols.withColumnRenamed("node", "src"), ["module", "name"])
    links = links.join(symbols.select("module", F.col("name").alias("least"), F.col("node").alias("dst")), ["module", "least"]).select("src", "dst")
    return symbols.join(graph.components(symbols.select("node"), links), "node").select("module", "name", F.col("component").alias("grp"))


def low_cohesion(exports: DataFrame, imports: DataFrame, least_exports: int = 3) -> DataFrame:
    """``module, symbols, groups, severity`` of modules whose imported symbols fall into several groups, high from four.

    Modules need ``least_exports`` exports, and two imported symbols at least.
    """
    exports = graph.written(exports.select("module", "name"), [])
    large = exports.groupBy("module").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_exports).select("module")
    sums = symbol_groups(exports.join(large, "module", "left_semi"), imports).groupBy("module").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("grp").alias("groups"))
    return sums.where("symbols >= 2 and groups > 1").withColumn("severity", F.when(F.col("groups") >= 4, "high").otherwise("medium"))
