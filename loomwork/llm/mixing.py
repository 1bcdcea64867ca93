"""Mixing sources to target weights by entropy balancing.

Each source has a token target.  Among all document rates that meet the
targets, the one nearest to "every document once" in relative entropy tilts
exponentially with document size, ``rate = min(cap, exp(lambda * size / scale))``,
and the lambdas solve a convex dual.  Newton steps run as joins and
aggregations over (source, size) cells; rates are then rounded into copies.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, remove, save, scratch

#: Rows that one bucket of equal documents (same source and size) holds on average, for rounding.
BUCKET_ROWS = 4096
#: Newton steps in one Spark job, and jobs at most; bisection inside the bracket halves the error at least.
STEPS, ROUNDS = 4, 20
TOLERANCE = 1e-7


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``source_size`` and ``target`` of each source of ``sizes(skey, source, source_size)``.

    Weights repeat over the sources by code point, null last.  The targets
    share the sum of all sizes; no target is above ``cap`` times its source,
    and what a capped source cannot take is shared by weight among the others:
    target = min(cap * size, level * weight) with one common level, found with
    running sums over the sources in the order in which they reach their cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1
    )
    by_cap = Window.orderBy("full_at", "skey")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.lit(cap) * F.col("source_size"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("sharing", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("full_at") <= F.col("left") / F.col("sharing"))
    )
    spare = F.sum("source_size").over(everything) - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(
        everything
    )
    level = F.try_divide(spare, F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything))
    target = F.when(F.col("capped"), F.col("most")).otherwise(level * F.col("weight"))
    return ranked.withColumn("target", target).select("skey", "source_size", "target")


def rate(cap: float):
    """Copies expected of a document, from its source's multiplier and scale."""
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("scale"))))


def exact_sum(x: Column) -> Column:
    """A sum that is the same in any order of rows: doubles are added as decimals of 12 places."""
    return F.sum(x.cast("decimal(38,12)")).cast("double")


def solve_dual(cells: DataFrame, targets: DataFrame, cap: float, folder: str) -> DataFrame:
    """Multiplier ``lam`` and ``scale`` of each source, by safeguarded Newton steps.

    The derivative of the dual in a source's multiplier is tokens taken minus
    target; it rises with the multiplier, so each step also narrows a bracket,
    and a Newton step that leaves the bracket becomes a bisection.
    """
    spark = cells.sparkSession
    width = cells.groupBy("skey").agg(
        (F.sum(F.col("n") * F.col("size")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean")
    )
    state = targets.join(width, "skey").select(
        "skey",
        "target",
        F.greatest("mean", F.lit(1.0)).alias("scale"),
        F.lit(0.0).alias("lam"),
        F.lit(-200.0).alias("lo"),
        F.lit(200.0).alias("hi"),
        F.lit(1.0).alias("off"),
    )
    x = F.col("size") / F.col("scale")
    at = f"{folder}/state0"
    state = save(state, at)
    for k in range(1, ROUNDS + 1):
        for _ in range(STEPS):
            sums = (
                cells.join(state.select("skey", "lam", "scale"), "skey")
                .withColumn("r", rate(cap))
                .groupBy("skey")
                .agg(
                    exact_sum(F.col("n") * F.col("size") * F.col("r")).alias("taken"),
                    exact_sum(F.when(F.col("r") < cap, F.col("n") * F.col("size") * x * F.col("r")).otherwise(0.0)).alias("slope"),
                )
            )
            over = F.col("taken") - F.col("target")
            lo = F.when(over < 0, F.col("lam")).otherwise(F.col("lo"))
            hi = F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
            newton = F.col("lam") - F.try_divide(over, F.col("slope"))  # null where flat: bisection then
            state = (
                state.join(sums, "skey")
                .withColumns({"lo": lo, "hi": hi, "off": F.abs(over) / F.greatest("target", F.lit(1.0)), "step": newton})
                .withColumn(
                    "lam",
                    F.when(over == 0, F.col("lam"))
                    .when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step"))
                    .otherwise((F.col("lo") + F.col("hi")) / 2),
                )
                .select("skey", "target", "scale", "lam", "lo", "hi", "off")
            )
        state = save(state, f"{folder}/state{k}")
        remove(spark, at)
        at = f"{folder}/state{k}"
        if (state.agg(F.max(F.when(F.col("hi") - F.col("lo") > 1e-12, F.col("off")))).first()[0] or 0) <= TOLERANCE:
            break
    return state


def settle(cells: pa.Table) -> pa.Table:
    """How many documents of each size get one copy more than the whole part of their rate, in one source.

    Goes from the largest size to the smallest and carries what is still owed
    in words, up or down as the smaller documents can still settle, so that the
    smallest settle the rest.  One row for each different size of a source,
    whatever the number of its documents.
    """
    rows = [r for r in zip(*(cells[c].to_pylist() for c in ("size", "n", "part"))) if r[2] > 0]
    rows.sort(reverse=True)
    give = sum((1 - part) * n * size for size, n, part in rows)
    drop = sum(part * n * size for size, n, part in rows)
    owed, extra = 0.0, []
    for size, n, part in rows:
        give, drop = give - (1 - part) * n * size, drop - part * n * size
        owed += part * n * size
        low = min(n, max(0, math.floor(owed / size))) if size else 0

        def rest(more: int) -> tuple[float, float]:
            """How far the words then owed lie beyond what smaller documents can settle, and how many they are."""
            left = owed - more * size
            return max(left - give, -left - drop, 0.0), abs(left)

        more = min({low, min(n, low + 1)}, key=rest) if size else 0
        owed -= more * size
        extra.append(more)
    keys = cells["skey"].slice(0, len(rows))  # one source
    return pa.table([keys, pa.array([size for size, *_ in rows], pa.int64()), pa.array(extra, pa.int64())], names=["skey", "size", "extra"])


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How many copies of each document the mix takes.

    Size is the number of words (null text: 0).  Returns ``doc_id, size,
    source_size, target, rate, copies, taken`` and the columns named in
    ``keep``; ``taken`` = copies * size.  Rates are rounded from
    the largest documents of a source to its smallest, and what rounding leaves
    is carried on in words: the taken words of a source miss its target by
    about one of its small documents, no document has more than ``cap`` copies
    (rounded up), and equal input gives equal output in any partitioning.

    Null sources are one source, last in order.  Empty texts have rate 1 and
    take nothing.  Rows that repeat an id are documents of their own and may
    share the copies either way.  An empty table gives an empty result; other
    columns are ignored.  No source is collected: documents of one source and
    size meet only in buckets of about BUCKET_ROWS rows.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("skey"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *[F.col(c).alias(f"keep_{c}") for c in keep],
    )
    sized = save(sized, f"{folder}/sized")
    cells = save(sized.groupBy("skey", "source", "size").agg(F.count(F.lit(1)).alias("n")), f"{folder}/cells")
    by_source = cells.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = save(source_targets(by_source, weights, cap), f"{folder}/targets")
    state = solve_dual(cells, targets, cap, folder)

    rated = (
        cells.join(state.select("skey", "lam", "scale"), "skey")
        .join(targets, "skey")
        # a target at the cap is the limit of an infinite multiplier
        .withColumn("rate", F.when(F.col("target") >= F.lit(cap) * F.col("source_size"), F.lit(float(cap))).otherwise(rate(cap)))
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
        .withColumn("part", F.col("rate") - F.floor("rate"))
    )
    # how many documents of each cell get one copy more
    settled = rated.select("skey", "size", "n", "part").groupBy("skey").applyInArrow(settle, "skey string, size long, extra long")
    rated = save(rated.drop("source", "lam", "scale").join(settled, ["skey", "size"], "left").fillna(0, ["extra"]), f"{folder}/rated")
    placed = (
        sized.join(rated.select("skey", "size", "source_size", "target", "rate", "buckets", "n", F.col("extra").alias("more")), ["skey", "size"])
        .withColumn("order", F.xxhash64(F.lit("mix"), "doc_id"))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "doc_id", "order"), F.col("buckets")))
    )
    filled = placed.groupBy("skey", "size", "bucket").agg(
        F.count(F.lit(1)).alias("here"), F.first("n").alias("n"), F.first("more").alias("more")
    )
    # a bucket's share of the extra copies: the difference of two running sums, so that all shares add up
    along = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    quota = filled.withColumn("upto", F.sum("here").over(along)).select(
        "skey", "size", "bucket", F.expr("upto * more div n - (upto - here) * more div n").alias("extra")
    )
    turn = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("order", "doc_id"))
    copies = F.floor("rate") + F.when(turn <= F.col("extra"), 1).otherwise(0)
    return (
        placed.join(quota, ["skey", "size", "bucket"])
        .withColumn("copies", copies.cast("long"))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            "rate",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
            *[F.col(f"keep_{c}").alias(c) for c in keep],
        )
    )
