"""Exact top-k search by term-at-a-time accumulation.

Vectors are stored as blocks of postings: for each term (component number) the
rows of the block that have a weight other than zero there, and the weights.
Sparse query rows visit the postings of their terms and scatter products into a
dense array of scores, one row a query and one column a vector of the block.
Partition selection keeps the best of a block, a task keeps the best of its
blocks, and one window merges what the tasks found.  No candidate is skipped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, scratch

#: Vectors and weights of a block of postings, and queries of a block of queries.
BLOCK_ROWS, BLOCK_WEIGHTS, QUERY_ROWS = 2048, 1 << 20, 64
#: Bytes of query blocks that are broadcast for one pass over the postings.
PASS_BYTES = 16 << 20
#: What a sum of products may not reach: by Cauchy and Schwarz no partial sum does either.
MOST = float(1 << 62)

INDEX = "block string, ids array<long>, terms array<int>, ends array<int>, rows array<int>, weights array<long>"
QUERIES = "block string, ids array<long>, places array<int>, terms binary, ends array<int>, rows binary, weights binary"
FOUND = "block string, place int, query_id long, vec_id long, score long"


def weighted(vectors: DataFrame, *, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """``vec_id, weights``: each component times ``factor``, rounded down.

    Vectors that are null or hold a null or non-finite component are left out.
    A vector whose weights' squares add to 2**62 or more is an error, as scores
    would not fit 64 bits.
    """
    scaled = F.transform(F.col(vector_col), lambda x: F.lit(float(factor)) * x.cast("double"))
    squares = F.aggregate("scaled", F.lit(0.0), lambda a, x: a + F.floor(x).cast("double") * F.floor(x).cast("double"))
    kept = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("scaled"))
    kept = kept.where(F.forall("scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    fits, error = squares < MOST, F.raise_error(F.lit("a vector's scores do not fit 64 bits"))
    return kept.select("vec_id", F.when(fits, F.transform("scaled", lambda x: F.floor(x))).otherwise(error).alias("weights"))


def id_order(ids: list) -> np.ndarray:
    """Positions by ascending id, null ids last."""
    return np.array(sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)), np.int64)


def build_index(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """A written table of blocks of postings; in a block rows ascend by id, null ids last."""

    def run(batches):
        part, seq, ids, lists, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            order = id_order(ids)
            lens = np.array([len(lists[k]) for k in order], np.int64)
            flat = np.concatenate([np.asarray(lists[k], np.int64) for k in order])
            row = np.repeat(np.arange(len(order)), lens)
            term = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
            row, term, flat = (x[flat != 0] for x in (row, term, flat))
            by = np.argsort(term, kind="stable")
            terms, counts = np.unique(term, return_counts=True)
            values = (f"{part}-{seq}", [ids[k] for k in order], terms, np.cumsum(counts), row[by], flat[by])
            kinds = (pa.string(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "ids", "terms", "ends", "rows", "weights"])

        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (len(ids) >= block_rows or size + len(own) > BLOCK_WEIGHTS):
                    yield block()
                    seq, ids, lists, size = seq + 1, [], [], 0
                ids.append(key)
                lists.append(own)
                size += len(own)
        if ids:
            yield block()

    rows = weighted(vectors, id_col=id_col, vector_col=vector_col, factor=factor)
    return save(rows.mapInArrow(run, INDEX), f"{scratch(vectors.sparkSession)}/postings")


def stored_queries(index: DataFrame, every: int) -> DataFrame:
    """The stored vectors whose id is divisible by ``every``, as blocks of sparse query rows ordered by term.

    ``places`` are their rows in the block of the index, which name a query: ids may repeat.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                wanted = [k for k, i in enumerate(row["ids"]) if i is not None and i % every == 0]
                place, weight = np.asarray(row["rows"], np.int64), np.asarray(row["weights"], np.int64)
                ends = np.asarray(row["ends"], np.int64)
                term = np.repeat(np.asarray(row["terms"], np.int32), np.diff(ends, prepend=0))
                for a in range(0, len(wanted), QUERY_ROWS):
                    part = wanted[a : a + QUERY_ROWS]
                    number = np.full(len(row["ids"]), -1, np.int32)
                    number[part] = np.arange(len(part))
                    mine = number[place] >= 0
                    terms, counts = np.unique(term[mine], return_counts=True)
                    yield pa.RecordBatch.from_pylist(
                        [
                            {
                                "block": row["block"],
                                "ids": [row["ids"][k] for k in part],
                                "places": part,
                                "terms": terms.astype(np.int32).tobytes(),
                                "ends": np.cumsum(counts).tolist(),
                                "rows": number[place][mine].tobytes(),
                                "weights": weight[mine].tobytes(),
                            }
                        ],
                        schema=ARROW_QUERIES,
                    )

    return index.mapInArrow(run, QUERIES)


def longest(rows: np.ndarray, weights: np.ndarray) -> float:
    """A bound of the lengths of a block's vectors."""
    return math.sqrt(np.bincount(rows, weights=weights.astype(np.float64) ** 2).max(initial=0)) + 1


def by_term(terms, ends, places: np.ndarray, weights: np.ndarray, width: int) -> list[tuple]:
    """``term, places, weights`` of a block.  Where most rows have a term, its weights are spread over all rows (no places)."""
    found = []
    for term, a, b in zip(terms, [0, *ends[:-1]], ends):
        if 2 * (b - a) >= width:
            spread = np.zeros(width, weights.dtype)
            spread[places[a:b]] = weights[a:b]
            found.append((term, None, spread))
        else:
            found.append((term, places[a:b], weights[a:b]))
    return found


class QueryRows:
    """Some sparse query rows, by term, and the best that each has found so far."""

    def __init__(self, names: list[tuple], terms: np.ndarray, rows: np.ndarray, weights: np.ndarray):
        self.names = names  # block, place and id of each
        order = np.argsort(terms, kind="stable")
        terms, counts = np.unique(terms[order], return_counts=True)
        self.terms = by_term(terms.tolist(), np.cumsum(counts).tolist(), rows[order], weights[order], len(names))
        self.norm = longest(rows, weights)
        self.best: list[list[tuple]] = [[] for _ in names]
        self.least = np.full(len(names), -np.inf)

    def scores(self, postings: dict, width: int, kind) -> np.ndarray:
        """Dense scores of all query rows with all vectors of a block: term by term, products are scattered to the rows that have the term."""
        found = np.zeros((len(self.names), width), kind)
        part = np.empty_like(found)
        for term, rows, weights in self.terms:
            if term in postings:
                places, own = postings[term]
                weights = weights.astype(kind)[:, None]
                if rows is None and places is None:
                    np.multiply(weights, own, out=part)
                    found += part
                elif places is None:
                    found[rows] += weights * own
                else:
                    found[(np.arange(len(found)) if rows is None else rows)[:, None], places] += weights * own
        return found

    def keep_best(self, found: np.ndarray, ids: list, block: str, k: int) -> None:
        """Merge the ``k`` best of a block; its columns ascend by id, so of equal scores the first are taken."""
        some = np.flatnonzero(found.max(axis=1) >= self.least)
        at = max(0, found.shape[1] - k - 1)  # one more than k, as a query's own row does not count
        levels = np.partition(found[some], at, axis=1)[:, at]
        for q, level in zip(some.tolist(), levels):
            row = found[q]
            over = np.flatnonzero(row > level)
            even = np.flatnonzero(row == level)[: k + 1 - len(over)]
            own = self.names[q][1] if block == self.names[q][0] else -1
            fresh = [(-int(row[c]), ids[c] is None, ids[c]) for c in np.concatenate((over, even)).tolist() if c != own]
            self.best[q] = sorted(self.best[q] + fresh, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
            if len(self.best[q]) == k:
                self.least[q] = -self.best[q][-1][0]


def query_rows(blocks: list[dict]) -> list[QueryRows]:
    """The query blocks of one pass as groups of QUERY_ROWS."""
    names, terms, rows, weights = [], [], [], []
    for row in blocks:
        ends = np.asarray(row["ends"], np.int64)
        terms.append(np.repeat(np.frombuffer(row["terms"], np.int32), np.diff(ends, prepend=0)))
        rows.append(np.frombuffer(row["rows"], np.int32) + len(names))
        weights.append(np.frombuffer(row["weights"], np.int64))
        names += [(row["block"], place, i) for place, i in zip(row["places"], row["ids"])]
    if not names:
        return []
    terms, rows, weights = map(np.concatenate, (terms, rows, weights))
    found = []
    for a in range(0, len(names), QUERY_ROWS):
        mine = (rows >= a) & (rows < a + QUERY_ROWS)
        found.append(QueryRows(names[a : a + QUERY_ROWS], terms[mine], rows[mine] - a, weights[mine]))
    return found


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of ``index`` for each query row.

    Query blocks come to the driver in parts of at most PASS_BYTES (or one
    block), each of which is broadcast for one pass over the whole index.
    """
    spark = index.sparkSession
    folder, passes, chunk, size = scratch(spark), 0, [], 0

    def one_pass(chunk):
        shared = spark.sparkContext.broadcast(chunk)

        def run(batches):
            groups = query_rows(shared.value)
            most = max((g.norm for g in groups), default=0)
            for batch in batches:
                for row in batch.to_pylist():
                    places, weights, width = np.asarray(row["rows"], np.int32), np.asarray(row["weights"], np.int64), len(row["ids"])
                    # doubles are exact where no partial sum can reach 2**53
                    kind = np.float64 if most * longest(places, weights) < 1 << 53 else np.int64
                    postings = {t: (at, own) for t, at, own in by_term(row["terms"], row["ends"], places, weights.astype(kind), width)}
                    for own in groups:
                        own.keep_best(own.scores(postings, width, kind), row["ids"], row["block"], k)
            for own in groups:
                found = [(block, place, i, x[2], -x[0]) for (block, place, i), best in zip(own.names, own.best) for x in best]
                if found:
                    kinds = (pa.string(), pa.int32(), *[pa.int64()] * 3)
                    names = ["block", "place", "query_id", "vec_id", "score"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)], names=names)

        index.mapInArrow(run, FOUND).write.parquet(f"{folder}/found/pass={passes}")
        shared.destroy()

    for row in queries.toLocalIterator():
        row = row.asDict()
        own = sum(len(row[x]) for x in ("terms", "rows", "weights"))
        if chunk and size + own > PASS_BYTES:
            one_pass(chunk)
            passes, chunk, size = passes + 1, [], 0
        chunk.append(row)
        size += own
    one_pass(chunk)
    found = spark.read.schema(FOUND).parquet(f"{folder}/found")
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(
    vectors: DataFrame, *, k: int = 5, every: int = 50, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each row whose id is divisible by ``every``, against all other rows.

    The score is the inner product of the vectors of weighted(); where lengths
    differ, missing components count as zero.  Ties go to the smaller id, null
    ids last; a row with a null id is no query.  With fewer than ``k`` other
    rows all are returned.  Rows that repeat an id are queries and candidates of
    their own.  Other columns are ignored; an empty table gives an empty result.
    """
    index = build_index(vectors, id_col=id_col, vector_col=vector_col, factor=factor, block_rows=block_rows)
    queries = save(stored_queries(index, every), f"{scratch(vectors.sparkSession)}/queries")
    return search(index, queries, k)


ARROW_QUERIES = pa.schema(
    [
        ("block", pa.string()),
        ("ids", pa.list_(pa.int64())),
        ("places", pa.list_(pa.int32())),
        ("terms", pa.binary()),
        ("ends", pa.list_(pa.int32())),
        ("rows", pa.binary()),
        ("weights", pa.binary()),
    ]
)
