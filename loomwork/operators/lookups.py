"""First matches of several tables, single implementations, and orders of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def import_lines(links: DataFrame, imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """``src, dst, line_start, line_end``: where each link stands: its first import, else its first re-export, else line 1.

    ``imports`` and ``reexports`` have ``src, dst, pos, line_start, line_end``; the
    smallest ``pos`` is the first, then the smallest lines.
    """
    found = links.select("src", "dst").distinct()
    for name, table in (("own", imports), ("passed", reexports)):
        first = table.groupBy("src", "dst").agg(F.min(F.struct("pos", "line_start", "line_end")).alias(name))
        found = found.join(first, ["src", "dst"], "left")
    at = lambda c: F.coalesce(F.col(f"own.{c}"), F.col(f"passed.{c}"), F.lit(1)).alias(c)
    return found.select("src", "dst", at("line_start"), at("line_end"))


def lone_implementations(interfaces: DataFrame, implementations: DataFrame) -> DataFrame:
    """``name, file, line, implementation``: interfaces that exactly one file implements.

    ``interfaces(name, file, line)`` counts once a name, where it stands first;
    ``implementations(name, file)`` of several places in a file are one.
    """
    first = interfaces.groupBy("name").agg(F.min(F.struct("file", "line")).alias("at"))
    users = implementations.groupBy("name").agg(F.count_distinct("file").alias("files"), F.min("file").alias("implementation")).where("files = 1")
    return first.join(users, "name").select("name", "at.file", "at.line", "implementation")


def ranked_references(references: DataFrame, most: int | None = None) -> DataFrame:
    """``references(symbol, uri, line, is_definition)`` of each symbol with ``place``: definitions first, then by file and line."""
    order = Window.partitionBy("symbol").orderBy(F.desc("is_definition"), "uri", "line")
    ranked = references.withColumn("place", F.row_number().over(order))
    return ranked if most is None else ranked.where(F.col("place") <= most)


def code_matches(items: DataFrame, *, repo: str | None = None, prefix: str | None = None, name: str | None = None, extension: str | None = None) -> DataFrame:
    """Rows of ``items(repo, path)`` that a remote search could not narrow down itself: by repository, folder, file name and ending."""
    kept = items
    if repo is not None:
        kept = kept.where(F.col("repo") == repo)
    if prefix is not None:
        kept = kept.where(F.startswith("path", F.lit(prefix)))
    if name is not None:
        kept = kept.where(F.substring_index("path", "/", -1) == name)
    if extension is not None:
        kept = kept.where(F.endswith("path", F.lit("." + extension.lstrip("."))))
    return kept


def shown_files(files: DataFrame, *, details: bool = False, modified: bool = False) -> DataFrame:
    """``path, type`` of files, with ``size`` and ``permissions`` on demand of ``details``, and the time on demand of ``modified``."""
    return files.select("path", "type", *["size", "permissions"] * details, *["modified"] * modified)


def nested_matches(matches: DataFrame, most: int = 10) -> DataFrame:
    """``repo, only_repo, total, files``: matches gathered by repository and file.

    ``matches(repo, path, line, text)``; of a file the first ``most`` matches are
    shown (the feature) and all are counted.  ``only_repo`` is true where all
    matches are of one repository, which a report then names once.
    """
    order = Window.partitionBy("repo", "path").orderBy("line", "text")
    ranked = matches.withColumn("k", F.row_number().over(order))
    shown = F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("line", "text"))))
    files = ranked.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"), shown.alias("matches"))
    repos = files.groupBy("repo").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("path", "n", "matches"))).alias("files"))
    one = matches.agg((F.count_distinct("repo") == 1).alias("only_repo"))
    return repos.crossJoin(F.broadcast(one)).select("repo", "only_repo", "total", "files")
