"""What the driver is given to do: how many jobs it starts, and how much it gathers."""

from loomwork.llm import decontaminate as D
from loomwork.llm import jaccard_join
from loomwork.llm.components import connected_components


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("others", "others")


def test_few_pairs_take_few_jobs(spark):
    """Near copies of one text, each with another word changed: one pass over all pairs."""
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(0, 120, 20)] + ["alone " * 9, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, jobs = jobs_of(spark, "jaccard", lambda: jaccard_join.jaccard_join(docs).collect())
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(k, 0 if k < 6 else k) for k in range(8)]
    assert jobs <= 80  # 105 with a pass around centres first


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100 + k, 90) for k in range(40)] + [(7, 7), (None, 3)]
    links = spark.createDataFrame(chain, "a long, b long")
    rows = connected_components(links).collect()
    assert {r.node: r.component for r in rows} == {k: 0 for k in range(41)} | {k: 90 for k in [90, *range(100, 140)]}
    assert connected_components(links.limit(0)).collect() == []


def test_labels_of_many_links_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("loomwork.llm.components.BROADCAST_ROWS", 3)
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (21, 22), (22, 10)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {k: 3 for k in (3, 4, 5, 9)} | {k: 10 for k in (10, 20, 21, 22)}


def test_tasks_sum_the_axes_before_they_reach_the_driver(spark, monkeypatch):
    sample = spark.createDataFrame([([k, k + 1, 2 * k],) for k in range(64)], "f array<int>").repartition(D.FIT_TASKS)
    gathered, collect = [], type(sample).collect
    monkeypatch.setattr(type(sample), "collect", lambda self: [gathered.append(len(r.z)) or r for r in collect(self)])
    assert D.latent_axes(sample, D.np.ones(D.FEATURES)).shape == (D.FEATURES, D.AXES)
    assert sum(gathered) <= (D.POWER + 1) * D.FEATURES * D.AXES * 8
