"""Walks over all edges, on a table in which no two orders share a pair of parts."""

from loomwork.plans.queries import QUERIES

#: Parts of each order, in line order: a ring 1-2-3-4-1, a hub 5 with 20 ends that leads to 1, and 40-41 apart.
ORDERS = [[1, 2, 3], [3, 4, 1], [5, 1], [40, 41], *([5, k] for k in range(10, 30))]


def test_walks_take_every_edge(spark, tmp_path):
    items = [(o, k, p) for o, parts in enumerate(ORDERS, 1) for k, p in enumerate(parts, 1)]
    nodes = sorted({p for _, _, p in items} | {50})
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(n,) for n in nodes], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")

    def rows(name):
        return {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}

    assert rows("graph_reachable_all") == {(1, 0), (2, 0), (3, 0), (4, 1)}
    assert rows("graph_neighbourhood_all") == {(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), *((k, 2) for k in range(10, 30))}
    assert rows("graph_components_all") == {(n, n if n == 50 else 40 if n >= 40 else 1) for n in nodes}
    assert rows("graph_strong_components_all") == {(n, 1 if n <= 4 else n) for n in nodes}
    assert rows("graph_affected_findings_all") == {("high-coupling", 5, "medium", 21)}
