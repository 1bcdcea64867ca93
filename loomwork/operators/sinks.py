"""Findings and graphs as text, and reports as folders of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The level that a severity has in a build log.
LEVELS = (("critical", "error"), ("high", "error"), ("medium", "warning"), ("low", "notice"))


def compact_line() -> Column:
    """``severity:file:line - [category] title``; no line number without one."""
    place = F.concat(F.col("file"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    return F.concat(F.col("severity"), F.lit(":"), place, F.lit(" - ["), F.col("category"), F.lit("] "), F.col("title"))


def annotation() -> Column:
    """A finding as a note of a build log, on line 1 without a line number."""
    level = F.lit("warning")
    for name, shown in reversed(LEVELS):
        level = F.when(F.col("severity") == name, shown).otherwise(level)
    line = F.coalesce(F.col("line").cast("string"), F.lit("1"))
    return F.concat(F.lit("::"), level, F.lit(" file="), F.col("file"), F.lit(",line="), line, F.lit("::"), F.col("title"), F.lit(" ["), F.col("category"), F.lit("]"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """``line`` of each edge of a flow chart; names of nodes are quoted."""
    node = lambda c: F.concat(F.lit("n"), F.sha1(F.col(c).cast("string").cast("binary")).substr(1, 8), F.lit('["'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit("'")), F.lit('"]'))
    return edges.select(F.concat(F.lit("  "), node("src"), F.lit(" --> "), node("dst")).alias("line"))


def clean_json(row: Column) -> Column:
    """A row as JSON without null fields."""
    return F.to_json(row, {"ignoreNullFields": "true"})


def write_lines(rows: DataFrame, line: Column, path: str) -> None:
    """One line a row, as text files below ``path``."""
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def write_report(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, one folder a category, and their counts beside them."""
    findings.write.mode("overwrite").partitionBy("category").json(f"{path}/findings")
    findings.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def save_baseline(findings: DataFrame, path: str) -> None:
    """The known findings by category, file and title; a later run leaves them out."""
    findings.select("category", "file", "title").distinct().write.mode("overwrite").json(path)


def new_findings(findings: DataFrame, path: str) -> DataFrame:
    """``findings`` that the baseline at ``path`` does not have; nulls are equal."""
    spark: SparkSession = findings.sparkSession
    known = spark.read.schema("category string, file string, title string").json(path).select(*[F.col(c).alias(f"k_{c}") for c in ("category", "file", "title")])
    same = [F.col(c).cast("string").eqNullSafe(F.col(f"k_{c}")) for c in ("category", "file", "title")]
    return findings.join(known, same[0] & same[1] & same[2], "left_anti")
