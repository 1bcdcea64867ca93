"""A report of findings as lines of Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import report


def cell(value: Column) -> Column:
    """A value within a table: one line, and no bar that ends the cell."""
    return F.regexp_replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, cells)), F.lit(" |"))


def section(rows: DataFrame, number: int, title: str, heads: tuple[str, ...], line: Column, place: Column) -> DataFrame:
    """``section, place, line`` of a titled table; without rows the table says so."""
    top = [f"## {title}", "", "| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads)]
    fixed = rows.sparkSession.createDataFrame([(number, k - len(top), t) for k, t in enumerate(top)], "section int, place long, line string")
    own = rows.select(F.lit(number).alias("section"), place.cast("long").alias("place"), line.alias("line"))
    none = own.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(number).alias("section"), F.lit(1).cast("long").alias("place"), F.lit("| " + " | ".join(["none"] + [""] * (len(heads) - 1)) + " |").alias("line"))
    return fixed.unionByName(own).unionByName(none)


def summary(findings: DataFrame, total_files: int, most: int = 20) -> DataFrame:
    """``section, place, line``: a report of ``findings(id, category, file, severity)``; in order of section and place it is the text.

    Counts by severity, counts by category, and the first ``most`` findings, one
    of each category in turn.  What comes out is short however many findings
    there are; they are counted where they are.
    """
    title = findings.sparkSession.createDataFrame([(0, 0, "# Scan summary"), (0, 1, "")], "section int, place long, line string")
    health = report.health(findings, total_files).select(F.lit(0).alias("section"), F.lit(2).cast("long").alias("place"), F.concat(F.lit("Health: "), F.col("score").cast("string"), F.lit("/100")).alias("line"))
    counts = report.severity_counts(findings)
    severities = section(counts, 1, "Severity", ("Severity", "Findings"), table_row(F.col("severity"), F.col("n")), report.rank_of(F.col("severity")) + 1)
    by_category = findings.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
    counted = F.struct((-F.col("n")).alias("order"), "category", "n", "files")
    placed = by_category.agg(F.sort_array(F.collect_list(counted)).alias("rows")).select(F.posexplode("rows").alias("k", "r"))
    categories = section(placed, 2, "Categories", ("Category", "Findings", "Files"), table_row(F.col("r.category"), F.col("r.n"), F.col("r.files")), F.col("k") + 1)
    chosen = report.diversified(findings, most).select("turn", report.rank_of(F.col("severity")).alias("rank"), "category", "id", "file", "severity")
    top = chosen.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("rows")).select(F.posexplode("rows").alias("k", "r"))
    firsts = section(top, 3, "Top findings", ("#", "Severity", "Category", "File"), table_row(F.col("k") + 1, F.col("r.severity"), F.col("r.category"), F.col("r.file")), F.col("k") + 1)
    return reduce(DataFrame.unionByName, (title, health, severities, categories, firsts))
