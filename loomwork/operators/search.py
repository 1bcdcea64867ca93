"""Line search: predicates, output modes, context windows, ranges and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.tables import lines


def line_pattern(pattern: str, *, regex: bool = False, whole_word: bool = False, whole_line: bool = False, case: str = "smart") -> str:
    """A Java pattern.  ``case``: sensitive, insensitive, or smart (insensitive unless the pattern has an upper-case letter)."""
    body = pattern if regex else re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", pattern)
    if whole_line:
        body = f"^(?:{body})$"
    elif whole_word:
        body = rf"\b(?:{body})\b"
    blind = case == "insensitive" or case == "smart" and pattern == pattern.lower()
    return f"(?i){body}" if blind else body


def matching(docs: DataFrame, pattern: str, *, invert: bool = False, **options) -> DataFrame:
    """``doc_id, line, content`` of lines that match (or don't)."""
    hit = F.col("content").rlike(line_pattern(pattern, **options))
    return lines(docs).where(~hit if invert else hit)


def file_counts(docs: DataFrame, pattern: str, **options) -> DataFrame:
    """``doc_id, match_lines, matches`` for documents with a match: count mode and count-matches mode."""
    java = line_pattern(pattern, **options)
    n = F.regexp_count("content", F.lit(java))
    return (
        lines(docs).select("doc_id", n.alias("n")).where("n > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("match_lines"), F.sum("n").alias("matches"))
    )


def files_without_match(docs: DataFrame, pattern: str, **options) -> DataFrame:
    return docs.select("doc_id").join(matching(docs, pattern, **options).select("doc_id").distinct(), "doc_id", "left_anti")


def cut(text: Column, limit: int = 200) -> Column:
    """At most ``limit`` code points; longer texts end in three dots."""
    return F.when(F.char_length(text) > limit, F.concat(F.substr(text, F.lit(1), F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def with_context(docs: DataFrame, pattern: str, before: int, after: int, *, limit: int = 200, **options) -> DataFrame:
    """``doc_id, line, value``: each match with its neighbouring lines, cut to ``limit`` code points."""
    all_lines = lines(docs)
    order = Window.partitionBy("doc_id").orderBy("line")
    around = order.rowsBetween(-before, after)
    hit = F.col("content").rlike(line_pattern(pattern, **options))
    joined = all_lines.withColumn("hit", hit).withColumn("value", F.array_join(F.collect_list("content").over(around), "\n"))
    return joined.where("hit").select("doc_id", "line", cut(F.col("value"), limit).alias("value"))


def match_ranges(docs: DataFrame, pattern: str, context: int = 5, **options) -> DataFrame:
    """``doc_id, first, last, n_matches``: context ranges, merged where they touch."""
    total = lines(docs).groupBy("doc_id").agg(F.max("line").alias("total"))
    spans = matching(docs, pattern, **options).join(total, "doc_id").select(
        "doc_id", "line", F.greatest(F.lit(1), F.col("line") - context).alias("first"), F.least("total", F.col("line") + context).alias("last")
    )
    order = Window.partitionBy("doc_id").orderBy("line")
    starts = (F.col("first") > F.coalesce(F.lag("last").over(order), F.lit(-1)) + 1).cast("int")
    island = spans.withColumn("new", starts).withColumn("island", F.sum("new").over(order))
    return island.groupBy("doc_id", "island").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n_matches")
    ).drop("island")


def search_page(docs: DataFrame, pattern: str, *, page: int = 1, files: int = 10, per_file: int = 10, **options) -> DataFrame:
    """One page of documents by id, with the first matches of each and both totals."""
    found = matching(docs, pattern, **options)
    per_doc = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_matches"))
    chosen = per_doc.orderBy("doc_id").offset((page - 1) * files).limit(files)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    return found.join(F.broadcast(chosen), "doc_id").withColumn("rank", rank).where(F.col("rank") <= per_file).select("doc_id", "line", "content", "total_matches")


def line_range(docs: DataFrame, first: int, last: int) -> DataFrame:
    """``doc_id, n_lines, content`` of a range of lines, clamped; nothing where it starts behind the end."""
    all_lines = F.split("text", "\n")
    return docs.where(F.size(all_lines) >= first).select(
        "doc_id", F.size(all_lines).alias("n_lines"), F.array_join(F.slice(all_lines, first, last - first + 1), "\n").alias("content")
    )


def char_page(docs: DataFrame, offset: int, length: int) -> DataFrame:
    """``doc_id, page, tokens, content``: one page of code points, its number and its estimated tokens."""
    part = F.substr("text", F.lit(offset + 1), F.lit(length))
    return docs.select(
        "doc_id", F.lit(offset // length + 1).alias("page"), F.ceil(F.char_length(part) / 4).alias("tokens"), part.alias("content")
    )
