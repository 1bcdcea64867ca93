"""Ordered greedy merging of overlapping sets, in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators import graph

#: Places that one window over the running minimum covers.
SPAN = 10_000


def prefix_tokens(sets: DataFrame, frequency: DataFrame, least: float, *keys: str) -> DataFrame:
    """``token`` rows of ``sets(..., members)``: the rarest members, one of which any set shares that overlaps by ``least``."""
    each = sets.select(*keys, F.size("members").alias("n"), F.explode("members").alias("token")).join(frequency, "token")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("frequency", "token"))
    # rounding may only lengthen the prefix
    return each.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select(*keys, "token")


def overlaps(a: Column, b: Column, least: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= least * (F.size(a) + F.size(b) - both)


def pairs(bases: DataFrame, items: DataFrame, rare: DataFrame, live: DataFrame, frequency: DataFrame, least: float, folder: list[str]) -> DataFrame:
    """``base, k, grows``: which live items behind its cursor each base would take as it is now, and which of these would add members.

    ``rare(place, token)`` are the prefix_tokens() of all items.
    """
    near = prefix_tokens(bases, frequency, least, "base", "cursor").join(rare, "token").where(F.col("place") > F.col("cursor"))
    near = graph.written(near.select("base", "place").distinct().join(live, "place", "left_semi"), folder)
    whole = near.join(bases.select("base", F.col("members").alias("own")), "base").join(items.select("place", "members"), "place")
    whole = whole.where(overlaps(F.col("own"), F.col("members"), least))
    return whole.select("base", F.col("place").alias("k"), (F.size(F.array_except("members", "own")) > 0).alias("grows"))


def earlier_minimum(bases: DataFrame, part: str, place: str, value: str, name: str) -> DataFrame:
    """``bases`` with the smallest ``value`` of all rows of a part before each: within spans of places, and of the spans before."""
    span = F.floor(F.col(place) / SPAN)
    rows = bases.withColumn("span", span)
    before = Window.orderBy("span").partitionBy(part).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(part, "span").agg(F.min(value).alias("v")).select(part, "span", F.min("v").over(before).alias("far"))
    near = F.min(value).over(Window.partitionBy(part, "span").orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("near", near).join(spans, [part, "span"]).withColumn(name, F.least("near", "far")).drop("span", "near", "far")


def merged_chains(chains: DataFrame, least: float = 0.8) -> DataFrame:
    """``chains(place, head, members)``: each chain, in order of its place, takes the later ones that it resembles and grows by their members.

    A chain takes another if they share ``least`` of all their members; it looks
    at the later chains once each, in order, with what it has grown to by then,
    and what is taken takes nothing.  Returns ``place, heads, members`` of what
    is left: heads in the order in which they were taken, members ascending.
    Places have to differ; null members are left out, and a chain of none is
    merged with nothing.

    Each round finds, over an inverted index of rare members, what every chain
    would take up to the next one by which it grows.  Until it grows, what it
    does not take it never will, so a take is certain if no earlier chain of the
    same component grows before it and none takes either of the two.  The
    earliest chain that takes anything in its component is always certain.
    Rounds are as many as the longest row of growths that wait for each other.
    """
    folder: list[str] = []
    tidy = F.array_distinct(F.array_compact("members"))
    each = chains.select("place", F.explode(tidy).alias("member"))
    numbers = each.groupBy("member").agg(F.count(F.lit(1)).alias("frequency"), F.min("place").alias("first"))
    numbers = graph.written(numbers.withColumn("token", F.monotonically_increasing_id()), folder)
    each = graph.written(each.join(numbers, "member").select("place", "token", "first"), folder)  # members travel as numbers from here on
    frequency = numbers.select("token", "frequency")
    items = graph.written(each.groupBy("place").agg(F.array_sort(F.collect_list("token")).alias("members")), folder)
    rare = graph.written(prefix_tokens(items, frequency, least, "place"), folder)
    links = each.select(F.col("place").alias("src"), F.col("first").alias("dst")).where("src <> dst")
    component = graph.components(items.select(F.col("place").alias("node")), links).select(F.col("node").alias("base"), F.col("component").alias("part"))
    live = items.select("place")
    bases = items.select(F.col("place").alias("base"), F.col("place").alias("cursor"), "members")
    found = graph.written(pairs(bases, items, rare, live, frequency, least, folder), folder)
    owners = changed = None
    while not found.isEmpty():
        stops = found.groupBy("base").agg(F.min(F.when(F.col("grows"), F.col("k"))).alias("stop"))
        reach = graph.written(found.join(stops, "base").where(F.col("stop").isNull() | (F.col("k") <= F.col("stop"))), folder)
        takers = reach.groupBy("k").agg(F.min("base").alias("base"))
        blocked = earlier_minimum(stops.join(component, "base"), "part", "base", "stop", "wait").select("base", "wait")
        sure = takers.join(blocked, "base").where(F.col("wait").isNull() | (F.col("wait") > F.col("k")))
        sure = sure.join(takers.select(F.col("k").alias("base")), "base", "left_anti").select("base", "k")
        taken = graph.written(sure, folder)
        owners = taken if owners is None else owners.unionByName(taken)
        live = items.select("place").join(owners.select(F.col("k").alias("place")), "place", "left_anti")
        grown = graph.written(taken.join(stops, "base").where(F.col("k") == F.col("stop")).select("base", "k"), folder)
        more = grown.join(items.select(F.col("place").alias("k"), F.col("members").alias("added")), "k")
        # what has not grown stands among the items, so that only the others are written anew
        own = grown.select("base").join(items.select(F.col("place").alias("base"), "members"), "base")
        if changed is not None:
            own = own.join(changed.select("base"), "base", "left_anti").unionByName(changed.select("base", "members"))
        larger = graph.written(more.join(own, "base").select("base", F.col("k").alias("cursor"), F.array_union("members", "added").alias("members")), folder)
        if changed is not None:
            kept = changed.join(larger.select("base"), "base", "left_anti").join(taken.select(F.col("k").alias("base")), "base", "left_anti")
        changed = larger if changed is None else graph.written(kept.unionByName(larger), folder)
        gone = taken.select("k")
        rest = found.join(larger.select("base"), "base", "left_anti").join(gone, "k", "left_anti").join(gone.select(F.col("k").alias("base")), "base", "left_anti")
        found = graph.written(rest.unionByName(pairs(larger, items, rare, live, frequency, least, folder)), folder)
    items = chains.select("place", "head", tidy.alias("members"))
    own = items.select(F.col("place").alias("base"), "place", "head", "members")
    if owners is not None:
        own = own.join(owners.select(F.col("k").alias("place"), F.col("base").alias("taker")), "place", "left").withColumn("base", F.coalesce("taker", "base")).drop("taker")
    gathered = own.groupBy(F.col("base").alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "head"))).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))
    return gathered.select("place", F.col("h.head").alias("heads"), "members")
