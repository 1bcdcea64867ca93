"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary over all digests names the few that may be frequent.
Their exact winners are aggregated (with map-side partial sums), broadcast, and
joined without a shuffle of the frequent rows; all other digests are shuffled
as usual.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, save, scratch

#: Counters of the Misra-Gries summary, and the most digests that are ever broadcast.
HEAVY_ITEMS = 256


def without_spaces(text: Column) -> Column:
    """``text`` without the six space characters; null counts as empty."""
    return reduce(lambda c, space: F.replace(c, F.lit(space), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", heavy_items: int = HEAVY_ITEMS
) -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Texts are equal if they are the same after all space characters are
    deleted.  The row with the most code points in its original text stays;
    ties go to the smallest id.  Returns ``doc_id, keep_id, group_size, kept,
    text_sha256``.  Null texts count as empty, and all empty texts form one
    group.  A null id loses against any id.  Rows that repeat an id share that
    id's fate.  An empty table gives an empty result; further columns are
    ignored.

    Broadcast data: at most ``heavy_items / 2`` digests with their winners.  The
    summary may miss a group of a few hundredths of the rows; the ordinary part
    holds no group in one task either: winners are partial sums, and joining
    them to the rows is an ordinary join, in which large partitions are split.
    """
    spark = docs.sparkSession
    row = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
        F.sha2(without_spaces(F.col(text_col)).cast("binary"), 256).alias("digest"),
    )
    # Texts are read and digested once; everything below reads this narrow table.
    digests = save(row, f"{scratch(spark)}/digests")

    summary = digests.agg(F.expr(f"approx_top_k(digest, {heavy_items // 2}, {heavy_items})").alias("top"))
    frequent = summary.select(F.inline("top")).where(F.col("count") > 1).select(F.col("item").alias("digest"))

    # max() of this struct: most code points, then an id before none, then the smallest id.
    rank = F.struct("n", F.col("doc_id").isNotNull().alias("has_id"), F.bitwise_not("doc_id").alias("back"))
    winners = (
        digests.join(F.broadcast(frequent), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = save(winners, f"{scratch(spark)}/winners")
    split = digests.join(F.broadcast(winners), "digest", "left")
    heavy = split.where(F.col("group_size").isNotNull())
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # sums are partial before the shuffle, and a large group that is joined to its winner can be split
    groups = rest.groupBy("digest").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    rest = rest.join(groups, "digest")
    keep = F.bitwise_not("best.back")
    return heavy.select("doc_id", "digest", "best", "group_size").unionByName(
        rest.select("doc_id", "digest", "best", "group_size")
    ).select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
