"""Bridges and articulation points against removal of each edge and node."""

import random

from loomwork.operators import biconnected


def parts(nodes, pairs):
    at = {n: n for n in nodes}

    def find(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in pairs:
        at[find(a)] = find(b)
    return len({find(n) for n in nodes})


def test_equal_removal(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(44)} | {(50, 51), (51, 52), (50, 52), (52, 53)}
    nodes = {n for p in pairs for n in p} | {99}
    whole = parts(nodes, pairs)
    want_bridges = {p for p in pairs if parts(nodes, pairs - {p}) > whole}
    want_cuts = {n for n in nodes if parts(nodes - {n}, {p for p in pairs if n not in p}) > whole - (not any(n in p for p in pairs))}
    df = spark.createDataFrame([(n,) for n in sorted(nodes)], "node long")
    edges = spark.createDataFrame([*pairs, (5, 5), *[(b, a) for a, b in sorted(pairs)[:9]]], "src long, dst long")
    assert want_bridges and {tuple(r) for r in biconnected.bridges(df, edges).collect()} == want_bridges
    assert want_cuts and {r.node for r in biconnected.articulation_points(df, edges).collect()} == want_cuts
    none = edges.where("false")
    assert biconnected.bridges(df, none).count() == 0 and biconnected.articulation_points(df, none).count() == 0


def test_chokepoints(spark):
    files = spark.createDataFrame([(1, 0), (2, 50), (3, 0), (4, 0)], "node long, criticality long")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4)], "src long, dst long")
    got = {r.node: (r.score, r.reasons) for r in biconnected.chokepoints(files, edges).collect()}
    # 1: 1 in, 1 out, one bridge, cycle; 2: 1 in, 2 out, cut, two bridges, cycle, criticality
    assert got == {1: (14, "bridges,cycle"), 2: (36, "articulation,bridges,cycle,complexity"), 3: (24, "articulation,bridges"), 4: (7, "bridges")}
