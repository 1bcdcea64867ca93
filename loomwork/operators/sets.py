"""Keep-first unions and duplicates, anti-joins against baselines, and overlapping ranges."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, null keys included, whatever the columns' names; ``order`` must be total, or ties fall either way."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    name = new_name(df)
    return df.withColumn(name, rank).where(F.col(name) == 1).drop(name)


def new_name(*frames: DataFrame) -> str:
    """A column name that none of ``frames`` has."""
    taken = {c.lower() for df in frames for c in df.columns}
    return next(n for n in (f"own_{k}" for k in itertools.count()) if n not in taken)


def union_keep_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``left``, repeated ones too, and those of ``right`` whose keys it lacks; a null key equals nothing, so its rows stay."""
    return left.unionByName(right.join(left.select(*keys).distinct(), keys, "left_anti").select(*left.columns))


def unused(defined: DataFrame, used: DataFrame, on: Column) -> DataFrame:
    """Rows that nothing refers to."""
    return defined.join(used, on, "left_anti")


def duplicate_groups(docs: DataFrame, least: int = 2) -> DataFrame:
    """``digest, n, first_id`` of texts that several rows share; null texts are one group without a digest."""
    return (
        docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
        .where(F.col("n") >= least)
    )


def range_overlap(left: DataFrame, right: DataFrame, key: str, span: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Rows of ``left`` whose range meets a range of ``right`` under the same key; null keys and ends meet nothing."""
    own = new_name(left)
    r = right.select(F.struct(F.col(key).alias("key"), F.col(other[0]).alias("first"), F.col(other[1]).alias("last")).alias(own))
    meets = [F.col(key) == F.col(f"{own}.key"), F.col(span[0]) <= F.col(f"{own}.last"), F.col(span[1]) >= F.col(f"{own}.first")]
    return left.join(r, reduce(lambda a, b: a & b, meets), "left_semi")
