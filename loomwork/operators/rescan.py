"""Incremental re-scans: only what changed, and what depends on it, is looked at again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import graph


def snapshot(files: DataFrame, version: Column) -> DataFrame:
    """``path, version`` of files.  A version is what changes with a file: its size and time, or a hash of its text.

    With size and time only the list of files is read, no text.
    """
    return files.select("path", version.cast("string").alias("version"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, state`` with state added, removed, changed or same; a version that is null on both sides is the same."""
    old = before.select("path", F.col("version").alias("old"), F.lit(True).alias("was"))
    new = after.select("path", F.col("version").alias("new"), F.lit(True).alias("is"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return old.join(new, "path", "full").select("path", state.alias("state"))


def rescan(before: DataFrame, after: DataFrame, depends: DataFrame, known: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The findings of a full scan, made of the ``known`` ones and a scan of what changed; and the paths that were scanned.

    ``before`` and ``after`` are snapshots; ``depends(src, dst)`` has what files
    depend on, now or in the scan before.  Stale is what was added, removed or
    changed and whatever depends on that, directly or not.  ``detect(paths)``
    gets the stale paths that still exist and returns findings with a column
    ``path``, among them every finding of each such path; it should join these
    paths before it reads texts.  Findings of other paths stay as they are.
    """
    folder: list[str] = []
    touched = graph.written(changes(before, after).where("state <> 'same'").select(F.col("path").alias("node")), folder)
    stale = graph.written(graph.affected(depends, touched).select(F.col("node").alias("path")).distinct(), folder)
    fresh = graph.written(after.join(stale, "path", "left_semi").select("path"), folder)
    kept = known.join(stale, "path", "left_anti")
    return kept.unionByName(detect(fresh).select(*known.columns)), fresh


def collected(cache: DataFrame, now: Column, most_age: str) -> DataFrame:
    """A snapshot with ``used`` times, without entries that were not used for ``most_age``; a null time is old."""
    return cache.where(F.col("used") >= now - F.expr(f"interval {most_age}"))
