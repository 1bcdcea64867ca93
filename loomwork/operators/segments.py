"""Pages of serialised items that may end within an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(items: DataFrame, key: str, order: list[str], text: Column, *, joiner: str = ",", base: Column | int = 0) -> DataFrame:
    """``items`` with ``body``, ``start`` and ``end``: where each stands when all of a key are joined behind ``base`` characters.

    Every item but a key's first begins with the joiner.  Null texts are empty.
    """
    before = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(before) == 1
    body = F.concat(F.when(first, "").otherwise(joiner), F.coalesce(text, F.lit("")))
    own = items.withColumn("body", body)
    end = F.sum(F.char_length("body")).over(before.rowsBetween(Window.unboundedPreceding, 0)) + (F.lit(base) if isinstance(base, int) else base)
    return own.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.char_length("body"))


def cut_pages(placed: DataFrame, size: int) -> DataFrame:
    """Rows of offsets() on the pages that they touch: ``page`` (from 1), ``piece``, ``whole`` (the piece is all of the item).

    Pages of a key, read in order, are the whole text: an item that does not end
    on its page goes on on the next one, cut between code points.  Empty items
    stand on the page where they begin.
    """
    first = F.floor(F.col("start") / size)
    last = F.greatest(first, F.floor((F.col("end") - 1) / size))
    pages = placed.withColumn("page", F.explode(F.sequence(first, last))).withColumn("page", F.col("page") + 1)
    left = F.greatest(F.col("start"), (F.col("page") - 1) * size)
    right = F.least(F.col("end"), F.col("page") * size)
    piece = F.substr("body", (left - F.col("start") + 1).cast("int"), (right - left).cast("int"))
    return pages.withColumn("piece", piece).withColumn("whole", (left == F.col("start")) & (right == F.col("end")))


def page_texts(cut: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key, page, text, items, has_more``: each page as one text, of how many items, and whether pages follow."""
    piece = F.struct(*order, "piece")
    pages = cut.groupBy(key, "page").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.count(F.lit(1)).alias("items"))
    more = F.lead("page").over(Window.partitionBy(key).orderBy("page")).isNotNull()
    return pages.select(key, "page", F.array_join(F.col("p.piece"), "").alias("text"), "items", more.alias("has_more"))
