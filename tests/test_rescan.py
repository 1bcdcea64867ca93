"""Re-scans after edits against full scans."""

import collections
import random

from pyspark.sql import functions as F

from loomwork.operators import rescan

SCHEMA = "path long, text string"
LINKS = "src long, dst long"


def total(texts, links, path):
    """A finding of a path depends on all that it leads to."""
    seen, todo = set(), [path]
    while todo:
        p = todo.pop()
        if p not in seen:
            seen.add(p)
            todo += [b for a, b in links if a == p]
    return sum(len(texts[p] or "") for p in seen if p in texts)


def test_equals_a_full_scan_and_looks_at_stale_files_only(spark):
    rng = random.Random(2)
    before = {k: "x" * rng.randrange(9) for k in range(40)}
    links = [(k, rng.randrange(k)) for k in range(5, 40)] + [(3, 4), (4, 3)]
    after = {k: t for k, t in before.items() if k not in (7, 33)} | {12: "changed!", 3: None, 50: "new"}
    links_after = [e for e in links if e[0] not in (7, 33)] + [(50, 20)]
    known = [(p, total(before, links, p)) for p in before]
    looked = []

    def detect(paths):
        looked.extend(r.path for r in paths.collect())
        rows = [(p, total(after, links_after, p)) for p in looked]
        return spark.createDataFrame(rows, "path long, n long")

    frame = lambda t: spark.createDataFrame(list(t.items()), SCHEMA)
    version = F.sha2(F.col("text").cast("binary"), 256)
    shots = [rescan.snapshot(frame(t), version) for t in (before, after)]
    depends = spark.createDataFrame(links + links_after, LINKS)
    found, fresh = rescan.rescan(*shots, depends, spark.createDataFrame(known, "path long, n long"), detect)
    assert collections.Counter(tuple(r) for r in found.collect()) == collections.Counter((p, total(after, links_after, p)) for p in after)
    stale = {p for p in after if p == 50 or any(q in (3, 12, 7, 33) for q in reach(links + links_after, p))}
    assert sorted(looked) == sorted(stale) == sorted(r.path for r in fresh.collect()) and len(stale) < len(after)


def reach(links, path):
    seen, todo = set(), [path]
    while todo:
        p = todo.pop()
        if p not in seen:
            seen.add(p)
            todo += [b for a, b in links if a == p]
    return seen


def test_changes_and_ages(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "path string, version string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "path string, version string")
    assert {r.path: r.state for r in rescan.changes(old, new).collect()} == {"a": "same", "b": "changed", "c": "same", "d": "removed", "e": "added"}
    assert rescan.changes(old.where("false"), new.where("false")).count() == 0
    cache = spark.sql("select * from values ('a', timestamp'2024-01-10'), ('b', timestamp'2024-01-01'), ('c', null) as t(path, used)")
    assert [r.path for r in rescan.collected(cache, F.to_timestamp(F.lit("2024-01-11")), "7 days").collect()] == ["a"]


def test_nothing_changed_scans_nothing(spark):
    files = rescan.snapshot(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), F.length("text"))
    known = spark.createDataFrame([(1, 5)], "path long, n long")
    found, fresh = rescan.rescan(files, files, spark.createDataFrame([(1, 2)], LINKS), known, lambda paths: paths.select("path", F.lit(0).cast("long").alias("n")))
    assert fresh.count() == 0 and [tuple(r) for r in found.collect()] == [(1, 5)]
