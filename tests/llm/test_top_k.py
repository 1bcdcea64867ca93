"""Exact search against brute force: ties, repeated and null ids, odd vectors, small blocks, several passes."""

import collections
import math
import random

import pytest
from pyspark.errors import PySparkException

from loomwork.llm import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, block string, score string, rank string"


def brute(rows, k=5, every=50):
    kept = []
    for row in rows:
        v = row[1]
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((row[0], [math.floor(256 * x) for x in v]))
    out = []
    for a, (q, x) in enumerate(kept):
        if q is not None and q % every == 0:
            found = [(-sum(s * t for s, t in zip(x, y)), c is None, c or 0, c) for b, (c, y) in enumerate(kept) if b != a]
            out += [(q, n + 1, f[3], -f[0]) for n, f in enumerate(sorted(found)[:k])]
    return collections.Counter(out)


def got(df):
    return collections.Counter(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "b", "s", "r") for i, v in rows], SCHEMA)


def odd_rows():
    rng = random.Random(4)
    rows = [(k, [rng.choice((0.0, 0.0, -0.5, 0.25, rng.random())) for _ in range(6)]) for k in range(-100, 160)]
    hot = [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]
    rows += [(1000 + k, hot) for k in range(60)]  # one vector many times: ties
    rows += [(50, hot), (50, hot), (None, hot), (None, [0.9] * 6), (7, None), (100, None), (8, [0.1, None]), (150, [float("nan")] * 6), (200, [float("inf"), 0.0])]
    return rows + [(250, []), (300, [0.0] * 6), (350, [1.0, 1.0]), (400, [0.125] * 9)]


@pytest.mark.parametrize("block_rows", [3, 64, 4096])
def test_equals_brute_force(spark, block_rows):
    rows = odd_rows()
    out = top_k.top_k(table(spark, rows).repartition(3), block_rows=block_rows)
    assert got(out) == brute(rows)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(top_k, "PASS_BYTES", 200)
    rows = odd_rows()
    assert got(top_k.top_k(table(spark, rows).repartition(4), block_rows=16)) == brute(rows)


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, -1.0]), (2, [3.0, 0.5])]
    assert got(top_k.top_k(table(spark, rows))) == brute(rows)
    assert got(top_k.top_k(table(spark, rows[:1]))) == brute(rows[:1]) == collections.Counter()
    assert got(top_k.top_k(table(spark, rows[1:]))) == collections.Counter()


def test_scores_beyond_64_bits_are_an_error(spark):
    with pytest.raises(PySparkException, match="64 bits"):
        top_k.top_k(table(spark, [(0, [1e30]), (1, [1.0])])).collect()
