"""Tables of a folder, and the relations derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: ``doc_id, line`` (from 1) and ``content``.  Null texts have no lines."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("at", "content")).select(
        "doc_id", (F.col("at") + 1).alias("line"), "content"
    )


def edges(lineitem: DataFrame, least: int = 1) -> DataFrame:
    """A directed graph over all orders: consecutive parts of an order, where at least ``least`` orders have that pair."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = lineitem.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst is not null")
    if least <= 1:
        return pairs.distinct()
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("src", "dst")
