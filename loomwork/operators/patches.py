"""Unified diffs as rows: lines with their numbers, chosen lines, counts, and one patch a file.

All work on ``patches(id, patch)``; a null patch has no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the head of a hunk.
HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def patch_lines(patches: DataFrame) -> DataFrame:
    """``id, at, kind, old_line, new_line, content`` of each line of a patch.

    Heads of hunks set both counters and are no lines themselves; a head that
    is not well formed sets none.  Lines behind a backslash are notes.  An
    added line has no old number, a deleted one no new number.
    """
    rows = patches.select("id", F.posexplode(F.split("patch", "\n")).alias("at", "content"))
    line, own = F.col("content"), Window.partitionBy("id").orderBy("at")
    kind = F.when(F.startswith(line, F.lit("@@")), "head").when(F.startswith(line, F.lit("+")), "addition").when(F.startswith(line, F.lit("-")), "deletion")
    rows = rows.withColumn("kind", kind.when(F.startswith(line, F.lit("\\")), "note").otherwise("context"))
    sets = (F.col("kind") == "head") & line.rlike(HUNK)
    start = F.when(sets, F.struct(F.regexp_extract(line, HUNK, 1).cast("long").alias("old"), F.regexp_extract(line, HUNK, 2).cast("long").alias("new")))
    rows = rows.withColumns({"hunk": F.count(F.when(sets, 1)).over(own), "start": F.last(start, ignorenulls=True).over(own)})
    inside = Window.partitionBy("id", "hunk").orderBy("at")

    def number(side: str, kinds: tuple[str, ...]) -> Column:
        run = F.count(F.when(F.col("kind").isin(*kinds), 1)).over(inside)
        return F.when(F.col("kind").isin(*kinds), F.coalesce(F.col(f"start.{side}") - 1, F.lit(0)) + run)

    rows = rows.withColumns({"old_line": number("old", ("context", "deletion")), "new_line": number("new", ("context", "addition"))})
    return rows.where(F.col("kind").isin("context", "addition", "deletion")).select("id", "at", "kind", "old_line", "new_line", "content")


def chosen_lines(patches: DataFrame, added: list[int] | None, deleted: list[int] | None) -> DataFrame:
    """``id, shown``: the lines whose new numbers are in ``added`` or old ones in ``deleted``, each behind its number.

    None chooses all of a kind.  Context stays unless both lists are empty.  A
    patch of which nothing stays is the empty text.
    """
    def among(number: str, chosen: list[int] | None) -> Column:
        return F.lit(True) if chosen is None else F.col(number).isin(*chosen) if chosen else F.lit(False)

    stays = F.when(F.col("kind") == "addition", among("new_line", added)).when(F.col("kind") == "deletion", among("old_line", deleted))
    stays = stays.otherwise(F.lit(added is None or deleted is None or bool(added or deleted)))
    mark = F.when(F.col("kind") == "addition", F.concat(F.lit("+"), F.col("new_line"))).when(F.col("kind") == "deletion", F.concat(F.lit("-"), F.col("old_line")))
    shown = F.concat(mark.otherwise(F.concat(F.lit(" "), F.col("new_line"))), F.lit(": "), F.substr("content", F.lit(2)))
    rows = patch_lines(patches).where(stays).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("shown")))).alias("lines"))
    return patches.select("id").join(rows, "id", "left").select("id", F.coalesce(F.array_join("lines.shown", "\n"), F.lit("")).alias("shown"))


def line_changes(patch: Column) -> Column:
    """Struct ``additions, deletions``: lines that begin with one sign, not with three."""
    def count(sign: str) -> Column:
        lines = F.filter(F.split(patch, "\n"), lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(sign * 3)))
        return F.coalesce(F.size(lines), F.lit(0)).cast("long")

    return F.struct(count("+").alias("additions"), count("-").alias("deletions"))


def by_file(diffs: DataFrame) -> DataFrame:
    """``id, path, patch`` of each file of ``diffs(id, diff)``, under its old and its new path; the last patch of a path wins."""
    rows = diffs.select("id", F.posexplode(F.split("diff", r"(?m)^(?=diff --git )")).alias("at", "part")).where(F.startswith("part", F.lit("diff --git ")))
    rows = rows.withColumn("next", F.lead("at").over(Window.partitionBy("id").orderBy("at")))
    text = F.when(F.col("next").isNotNull(), F.regexp_replace("part", r"\n\z", "")).otherwise(F.col("part"))
    head = r"^diff --git a/(.+?) b/([^\n]+)"
    paths = F.array_distinct(F.array(F.regexp_extract("part", head, 1), F.regexp_extract("part", head, 2)))
    each = rows.where(F.col("part").rlike(head)).select("id", "at", text.alias("patch"), F.explode(paths).alias("path"))
    return each.groupBy("id", "path").agg(F.max(F.struct("at", "patch"))["patch"].alias("patch"))


def body_limit(limit: int | None) -> int | None:
    """How much of a body a list of so many entries shows (fixed values); None shows all."""
    most = 5 if limit is None else limit
    return None if most <= 1 else 2000 if most <= 3 else 800


def shown_body(body: Column, number: Column, limit: int | None) -> Column:
    """A body cut at ``limit`` code points, with a note on what is missing."""
    if limit is None:
        return body
    note = F.concat(F.lit("... [truncated "), F.char_length(body) - limit, F.lit(" chars, use type='fullContent' or prNumber="), number, F.lit(" for complete body]"))
    return F.when(F.char_length(body) > limit, F.concat(F.substr(body, F.lit(1), F.lit(limit)), note)).otherwise(body)


def merge_state(requests: DataFrame) -> DataFrame:
    """``requests(id, state, merged_at, files array<struct<additions, deletions>>)``: ``id, merged, additions, deletions, changed_files``."""
    total = lambda name: F.aggregate(F.coalesce(f"files.{name}", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    merged = (F.col("state") == "closed") & F.col("merged_at").isNotNull()
    return requests.select("id", merged.alias("merged"), total("additions").alias("additions"), total("deletions").alias("deletions"), F.greatest(F.size("files"), F.lit(0)).cast("long").alias("changed_files"))
