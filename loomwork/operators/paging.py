"""Pages of texts and of rows by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_page(text: Column, offset: int, length: int) -> Column:
    """Struct ``shown, start, next, lines`` of a page that begins and ends with whole lines.

    It begins with the line in which ``offset`` lies, holds ``length`` code
    points or more, up to the end of a line, and ``next`` is where the
    following page begins, or null after the last.  Past the end, the page is
    empty; an empty text has one empty page.
    """
    total = F.char_length(text)
    head = F.substr(text, F.lit(1), F.lit(offset))
    start = F.char_length(head) - F.char_length(F.substring_index(head, "\n", -1))
    least = F.least(start + length, total)
    # a page that ends with a line is whole; else the line is taken to its end
    rest = F.substr(text, least + 1)
    whole = (F.substr(text, least, F.lit(1)) == "\n") | (least == total)
    stop = F.when(whole, least).otherwise(F.least(least + F.char_length(F.substring_index(rest, "\n", 1)) + 1, total))
    past = (total > 0) & (F.lit(offset) >= total)
    shown = F.when(past, "").otherwise(F.substr(text, start + 1, stop - start))
    following = F.when(past, total).when(stop < total, stop)
    begin = F.when(past, total).otherwise(start)
    return F.when(text.isNotNull(), F.struct(shown.alias("shown"), begin.cast("long").alias("start"), following.cast("long").alias("next"), (F.char_length(shown) - F.char_length(F.replace(shown, F.lit("\n"), F.lit("")))).cast("long").alias("lines")))


def size_page(rows: DataFrame, group: str, order: str, size: Column, offset: int, length: int) -> DataFrame:
    """Rows of which any part lies in a window of summed sizes, group by group.

    Sizes are summed within ``group`` in the order of ``order``, one unit apart
    as items of a list are; ``before`` is where a row begins.
    """
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("size_", size.cast("long"))
    placed = placed.withColumn("before", F.coalesce(F.sum(F.col("size_") + 1).over(upto), F.lit(0)) + 1)
    return placed.where((F.col("before") < offset + length) & (F.col("before") + F.col("size_") > offset)).drop("size_")


def limited(text: Column, *, most: int = 2000, page: int = 10_000) -> Column:
    """A text that is longer than ``most`` is cut to its first page of ``page`` code points."""
    return F.when(F.char_length(text) > most, F.substr(text, F.lit(1), F.lit(page))).otherwise(text)


def first_match_context(docs: DataFrame, needle: str, reach: int = 5) -> DataFrame:
    """``doc_id, start, stop, shown``: the lines around the first line that holds ``needle``."""
    lines = F.split("text", "\n")
    at = F.get(F.filter(F.transform(lines, lambda x, k: F.when(F.contains(x, F.lit(needle)), k)), lambda k: k.isNotNull()), F.lit(0))
    rows = docs.select("doc_id", lines.alias("lines"), at.alias("k")).where("k is not null")
    start, stop = F.greatest(F.col("k") - reach, F.lit(0)), F.least(F.col("k") + reach + 1, F.size("lines"))
    return rows.select("doc_id", (start + 1).cast("long").alias("start"), stop.cast("long").alias("stop"), F.array_join(F.slice("lines", start + 1, stop - start), "\n").alias("shown"))
