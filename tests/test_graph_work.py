"""How many rows the graph operators write: about as many as a graph has edges, not as many as its cycles have or as its rounds take."""

import random

from loomwork.operators import biconnected, cycles, graph


def test_rows_written(spark, monkeypatch):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(1200)})
    nodes = spark.createDataFrame([(n,) for n in range(60)], "node long")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    plain, sizes = graph.written, []

    def counted(df, folder):
        saved = plain(df, folder)
        sizes.append(saved.count())
        return saved

    monkeypatch.setattr(graph, "written", counted)
    found, _ = biconnected.blocks(nodes, edges)
    assert {r.block is None for r in found.collect()} == {False} and sum(sizes) < 5 * len(pairs)
    sizes.clear()
    assert graph.components(nodes, edges).where("component = 0").count() == 60 and sum(sizes) < 2 * len(pairs)
    sizes.clear()
    triangles = cycles.simple_cycles(edges.union(graph.backward(edges)), 3).where("node_count = 3").count()
    near = {p: 1 for p in pairs} | {(b, a): 1 for a, b in pairs}
    assert triangles == 2 * sum((a, b) in near and (b, c) in near and (a, c) in near for a in range(60) for b in range(a) for c in range(b))
    assert sum(sizes) < 4 * len(pairs)
