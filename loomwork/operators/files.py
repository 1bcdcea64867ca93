"""Lists of files: entry filters, shapes, orders, suggestions, catalogues, lookups by package."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import paths as P


def name_filter(name: Column, pattern: str) -> Column:
    """A glob over names, in any case, or, without ``*``, ``?`` and ``[``, a part of the name as it is."""
    if not set("*?[") & set(pattern):
        return F.contains(name, F.lit(pattern))
    out = re.sub(r"([.+^${}()|\\])", r"\\\1", pattern).replace("*", ".*").replace("?", ".").replace("[!", "[^")
    return name.rlike(f"(?is)^{out}$")


def entries(files: DataFrame, *, pattern: str | None = None, extensions: tuple[str, ...] = (), kind: str | None = None) -> DataFrame:
    """``files(path, type, ...)`` whose name fits; folders pass the extension filter; ``kind`` keeps only ``file`` or ``dir``."""
    keep = F.lit(True)
    if pattern is not None:
        keep = keep & name_filter(P.name_of(F.col("path")), pattern)
    if extensions:
        keep = keep & ((F.col("type") == "dir") | P.extension(F.col("path")).isin(*extensions))
    return files.where(keep if kind is None else keep & (F.col("type") == kind))


def found_files(files: DataFrame, *, least_depth: int = 0, most_depth: int | None = None, names: tuple[str, ...] = (), regex: str | None = None, larger: int | None = None, smaller: int | None = None, pruned: tuple[str, ...] = ()) -> DataFrame:
    """``files(path, size)`` for which all given tests hold.

    Depth counts slashes; ``names`` are globs of which one has to fit; ``regex``
    has to fit the whole path, behind anything unless it begins with a mark of
    its own; sizes are bounds that are not reached; nothing below a folder
    named in ``pruned`` counts.
    """
    depth = F.size(F.split("path", "/")) - 1
    keep = depth >= least_depth
    if most_depth is not None:
        keep = keep & (depth <= most_depth)
    if names:
        fits = F.lit(False)
        for n in names:
            fits = fits | name_filter(P.name_of(F.col("path")), n if set("*?[") & set(n) else f"{n}*")
        keep = keep & fits
    if regex is not None:
        own = regex if regex.startswith((".*", "/", "^")) else f".*{regex}"
        keep = keep & F.col("path").rlike(f"^(?:{own.removeprefix('^')})$")
    if larger is not None:
        keep = keep & (F.col("size") > larger)
    if smaller is not None:
        keep = keep & (F.col("size") < smaller)
    if pruned:
        keep = keep & ~F.arrays_overlap(F.slice(F.split("path", "/"), F.lit(1), depth), F.array(*map(F.lit, pruned)))
    return files.where(keep)


def shown_entries(files: DataFrame) -> DataFrame:
    """``name, type, depth`` of ``files(path, type)``: folders end with a slash, links count as links, depth 0 is null."""
    depth = F.size(F.split("path", "/")) - 1
    name = F.concat(P.name_of(F.col("path")), F.when(F.col("type") == "dir", "/").otherwise(""))
    return files.select("path", name.alias("name"), "type", F.when(depth > 0, depth).alias("depth"))


ORDERS = {
    "size": (F.desc, "size"),
    "modified": (F.desc, "modified"),
}


def sorted_files(files: DataFrame, by: str, most: int) -> DataFrame:
    """The first ``most`` of ``files(path, size, modified)`` by ``size`` or ``modified`` from the top, by ``name``, by ``path``, or by ``kind`` with folders first."""
    if by in ORDERS:
        turn, column = ORDERS[by]
        first = [turn(column)]
    else:
        first = {"name": [F.lower(P.name_of(F.col("path")))], "path": [], "kind": [F.desc(F.col("type") == "dir")]}[by]
    return files.orderBy(*first, "path").limit(most)


def without_ignored(files: DataFrame, **lists) -> DataFrame:
    """Files that is_ignored() does not name; a folder is there only as long as a file in it is."""
    return files.where(~P.is_ignored(F.col("path"), **lists))


def structure(files: DataFrame) -> DataFrame:
    """``folder, files, folders``: the names in each folder that holds anything, sorted."""
    file = files.select(P.folder_of(F.col("path")).alias("folder"), P.name_of(F.col("path")).alias("name"), F.lit(False).alias("sub"))
    parts = F.split("path", "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("f")).where("f <> ''").distinct()
    sub = above.select(P.folder_of(F.col("f")).alias("folder"), P.name_of(F.col("f")).alias("name"), F.lit(True).alias("sub"))
    both = file.unionByName(sub).groupBy("folder").agg(F.array_sort(F.collect_set(F.when(~F.col("sub"), F.col("name")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("sub"), F.col("name")))).alias("b"))
    return both.select("folder", F.array_join("a", ",").alias("files"), F.array_join("b", ",").alias("folders"))


def suggestions(files: DataFrame, asked: DataFrame, most: int = 3) -> DataFrame:
    """``asked(ask)``: up to ``most`` ``ask, k, path`` in the same folder: first the same name in another case, then the same stem."""
    at = files.select("path", P.folder_of(F.col("path")).alias("folder"), P.name_of(F.col("path")).alias("name"))
    want = asked.select("ask", P.folder_of(F.col("ask")).alias("folder"), P.name_of(F.col("ask")).alias("wanted"))
    both = want.join(at, "folder").where("path <> ask")
    same = F.lower("name") == F.lower("wanted")
    stem = F.startswith("name", F.concat(F.regexp_replace("wanted", r"\.[^/.]+$", ""), F.lit(".")))
    ranked = both.where(same | stem).withColumn("k", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc(same), "path")))
    return ranked.where(F.col("k") <= most).select("ask", "k", "path")


def catalogue_search(items: DataFrame, query: str, columns: tuple[str, ...], tags: str) -> DataFrame:
    """Items of which one of ``columns`` or a tag holds ``query``, in any case."""
    asked = F.lit(query.lower())
    found = F.exists(tags, lambda t: F.contains(F.lower(t), asked))
    for c in columns:
        found = found | F.contains(F.lower(c), asked)
    return items.where(found)


def tag_counts(items: DataFrame, tags: str) -> DataFrame:
    """``tag, n`` over all items."""
    return items.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def right_wins(left: DataFrame, right: DataFrame) -> DataFrame:
    """``key, value`` of two tables with unique keys; where both have a key, the right value stays."""
    return left.join(right.select("key"), "key", "left_anti").unionByName(right)


def path_steps(specifier: Column, folder: Column) -> Column:
    """A relative address seen from a folder, without ``.`` and ``..``; null if it leaves the top."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), specifier), "/"), lambda p: ~p.isin("", "."))
    none = F.lit(None).cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(none)
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p)))), "/")


#: What may stand behind an address, in the order in which it is tried.
CANDIDATES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports(id, file, specifier)``: ``id, target``, the first candidate that is a file; null without one.

    Only relative addresses are followed; ``.js`` may stand for ``.ts``.
    """
    base = path_steps(F.col("specifier"), P.folder_of(F.col("file")))
    tried = F.array(*[F.concat(F.col("base"), F.lit(c)) for c in CANDIDATES], F.regexp_replace("base", r"\.js$", ".ts"))
    rows = imports.where(F.startswith("specifier", F.lit("."))).select("id", base.alias("base"))
    rows = rows.select("id", F.posexplode(tried).alias("k", "path")).join(files.select("path").distinct(), "path")
    best = rows.groupBy("id").agg(F.min(F.struct("k", "path"))["path"].alias("target"))
    return imports.select("id").join(best, "id", "left")
