"""Cycles and closing chains against brute force on small graphs."""

import functools
import itertools
import random

from pyspark.sql import functions as F

from loomwork.operators import chains, cycles, graph

LINKS = "src long, dst long"


def brute_cycles(links, most):
    """All simple cycles, each from its smallest node on."""
    found = set()
    nodes = sorted({x for e in links for x in e})
    for n in range(1, most + 1):
        for first in nodes:
            for rest in itertools.permutations([x for x in nodes if x > first], n - 1):
                path = (first, *rest)
                if all((a, b) in links for a, b in zip(path, (*rest, first))):
                    found.add(path)
    return found


def test_cycles_equal_brute_force(spark):
    rng = random.Random(3)
    for seed in range(3):
        links = {(rng.randrange(8), rng.randrange(8)) for _ in range(18 + 4 * seed)}
        edges = spark.createDataFrame([*links, *list(links)[:3], (None, 1), (1, None)], LINKS)
        for most in (1, 3, 5):
            got = [(tuple(r.cycle), r.node_count) for r in cycles.simple_cycles(edges, most).collect()]
            assert sorted(got) == sorted((c, len(c)) for c in brute_cycles(links, most))
        nodes = spark.range(8).select(F.col("id").alias("node"))
        within = cycles.simple_cycles(edges, 5, graph.strong_components(nodes, edges.where("src is not null and dst is not null")))
        assert {tuple(r.cycle) for r in within.collect()} == brute_cycles(links, 5)
    assert cycles.simple_cycles(edges.where("false"), 4).count() == 0


def test_cycle_findings(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (5, 5)], LINKS)
    lines = spark.createDataFrame([(1, 2, 9), (1, 2, 7), (5, 5, 3)], "src long, dst long, line int")
    got = cycles.cycle_findings(cycles.simple_cycles(edges, 4), lines).collect()
    assert [(r.file, r.line, r.title, r.reason) for r in sorted(got, key=lambda r: (-len(r.reason), r.file))] == [
        (2, 1, "Dependency cycle detected (3 node cycle)", "Import cycle exists across: 2 -> 3 -> 4 -> 2"),
        (1, 7, "Dependency cycle detected (2 node cycle)", "Import cycle exists across: 1 -> 2 -> 1"),
        (5, 3, "Dependency cycle detected (1 node cycle)", "Import cycle exists across: 5 -> 5"),
    ]
    top = cycles.cycle_findings(cycles.simple_cycles(edges, 4), lines, 1).collect()
    assert [(r.category, r.severity, r.file) for r in top] == [("dependency-cycle", "high", 2)]


def test_chains_that_close(spark):
    rng = random.Random(9)
    links = {(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(26)) if a != b}
    score = {n: (rng.randint(1, 9) if n % 5 else None) for n in range(15)}
    own = {n: 1 if s is None else s for n, s in score.items()}
    reach = {n: {n} for n in score}
    for _ in score:
        for a, b in links:
            reach[a] |= reach[b]
    same = lambda a, b: b in reach[a] and a in reach[b]

    @functools.cache
    def best(n):
        closing = [(own[b] / 2, 1, -b) for a, b in links if a == n and same(a, b)]
        half = max(closing, key=lambda c: (c[0], c[2]), default=None)
        here = (own[n] + half[0], 2, (n, -half[2])) if half else (own[n], 1, (n,))
        onward = max(((best(b)[0], best(b)[1], -b) for a, b in links if a == n and not same(a, b)), default=None)
        if onward and (onward[0] + own[n], onward[1] + 1) > here[:2]:
            return onward[0] + own[n], onward[1] + 1, (n, *best(-onward[2])[2])
        return here

    files = spark.createDataFrame(list(score.items()), "node long, score long")
    got = chains.critical_paths(files, spark.createDataFrame(sorted(links), LINKS), 100, closing=True).collect()
    assert {(r.start, tuple(r.path), r.score) for r in got} == {(n, best(n)[2], float(best(n)[0])) for n in score if best(n)[1] > 1}
