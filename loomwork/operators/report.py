"""Findings: severity counts, health, ranked limits and diversified top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from high to low, with their weights in the health score.
SEVERITIES = ("critical", "high", "medium", "low", "info")
WEIGHTS = (25, 10, 3, 1, 0)


def rank_of(severity: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for k, name in enumerate(SEVERITIES):
        out = F.when(severity == name, k).otherwise(out)
    return out


def severity_counts(findings: DataFrame) -> DataFrame:
    """``severity, n`` for all five levels, zero-filled."""
    spark = findings.sparkSession
    levels = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    n = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(n, "severity", "left").fillna(0, ["n"])


def health(findings: DataFrame, files: int | None = None) -> DataFrame:
    """``score``: 100 without findings, falling with the weighted findings a file; capped by the worst severity.

    Without ``files``, the files are those that have findings.
    """
    weight = F.element_at(F.array(*map(F.lit, [*WEIGHTS, 0])), rank_of(F.col("severity")) + 1)
    sums = findings.agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("p"),
        F.coalesce(F.min(rank_of(F.col("severity"))), F.lit(9)).alias("worst"),
        (F.count_distinct("file") if files is None else F.lit(files)).alias("files"),
    )
    raw = F.floor(100 / (1 + F.col("p") / F.greatest("files", F.lit(1)) / 10) + 0.5)
    cap = F.when(F.col("worst") == 0, 95).when(F.col("worst") == 1, 98).when(F.col("worst") < 9, 99).otherwise(100)
    return sums.select(F.least(raw, cap).cast("long").alias("score"))


def top_per_category(findings: DataFrame, each: int = 2, most: int = 20) -> DataFrame:
    """At most ``each`` findings of a category and ``most`` in all, by severity, then id."""
    rank = rank_of(F.col("severity"))
    own = F.row_number().over(Window.partitionBy("category").orderBy(rank, "id"))
    return findings.withColumn("_own", own).where(F.col("_own") <= each).orderBy(rank, "category", "id").limit(most).drop("_own")


def diversified(findings: DataFrame, most: int) -> DataFrame:
    """Round robin over categories: the best of each, then the second best, until ``most``."""
    rank = rank_of(F.col("severity"))
    turn = F.row_number().over(Window.partitionBy("category").orderBy(rank, "id"))
    return findings.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", rank, "category", "id").limit(most)


def against_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose category and file the baseline lacks."""
    return findings.join(baseline.select("category", "file").distinct(), ["category", "file"], "left_anti").select(*findings.columns)
