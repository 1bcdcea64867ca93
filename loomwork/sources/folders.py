"""Files of a folder tree as tables, read through Spark's own readers, so any store will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import paths as P

# What counts as source code, and how much of a file is looked at.
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py")
MINIFIED = r"\.min\.[^./]+$"
SAMPLE_BYTES, CONTROL_SHARE = 8192, 0.05


def file_list(spark: SparkSession, folder: str, *, hidden_folders: tuple[str, ...] = (), most_depth: int | None = None) -> DataFrame:
    """``path, size, modified, depth`` of all files below ``folder``; ``path`` is relative, depth 0 lies directly in it.

    Files below one of ``hidden_folders`` don't count.  No content is read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), "^/+", "/")
    top = folder.split("://")[-1]
    top = "/" + top.split("/", 1)[-1].strip("/") if "://" in folder and not folder.startswith("file:") else "/" + top.removeprefix("file:").strip("/")
    path = F.substr(below, F.lit(len(top.rstrip("/")) + 2))
    rows = rows.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = rows.withColumn("depth", F.size(F.split("path", "/")) - 1)
    if hidden_folders:
        rows = rows.where(~F.arrays_overlap(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), F.array(*map(F.lit, hidden_folders))))
    return rows if most_depth is None else rows.where(F.col("depth") <= most_depth)


def source_files(files: DataFrame, *, tests: bool = False) -> DataFrame:
    """Those of ``files(path, ...)`` that are source code: no declarations, no minified ones, none in ``scripts/`` that ``src/`` mirrors."""
    path = F.col("path")
    kept = files.where(P.extension(path).isin(*SOURCE_EXTENSIONS) & ~F.endswith(path, F.lit(".d.ts")) & ~path.rlike(MINIFIED))
    if not tests:
        kept = kept.where(~P.is_test(path))
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    mirrored = files.where(path.rlike("(^|/)src/")).select(F.regexp_replace(stem(path), "(^|/)src/", "$1scripts/").alias("stem")).distinct()
    return kept.withColumn("stem", stem(path)).join(mirrored, "stem", "left_anti").select(*files.columns)


def looks_binary(content: Column) -> Column:
    """Whether the first bytes hold a zero, are no UTF-8, or hold many control bytes beside terminal colours; false for an empty file."""
    sample = F.substr(content, F.lit(1), F.lit(SAMPLE_BYTES))
    text = F.decode(sample, "ISO-8859-1")  # one character a byte
    plain = F.regexp_replace(text, r"\x1b\[[^\x40-\x7e]*[\x40-\x7e]?", "")
    control = F.regexp_count(plain, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    many = (F.char_length(plain) > 0) & (control > CONTROL_SHARE * F.char_length(plain))
    return F.when(F.octet_length(content) == 0, False).otherwise(F.contains(text, F.lit("\0")) | ~F.is_valid_utf8(sample.cast("string")) | many)


def text_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, content, binary``: files of a folder whole; binary ones have no content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    binary = looks_binary(F.col("content"))
    return rows.select("path", F.when(~binary, F.col("content").cast("string")).alias("content"), binary.alias("binary"))


def packages(spark: SparkSession, folder: str) -> DataFrame:
    """``folder, name`` of each child folder with a ``package.json`` that has a name; one that can't be read is none."""
    rows = spark.read.option("wholetext", True).text(f"{folder}/*/package.json").select(F.col("_metadata.file_path").alias("path"), "value")
    name = F.get_json_object("value", "$.name")
    return rows.select(P.name_of(P.folder_of(F.col("path"))).alias("folder"), name.alias("name")).where("name is not null and name <> ''")


def feed_catalogue(docs: DataFrame) -> DataFrame:
    """``docs(id, text)`` of markdown: ``id, section, url, line`` of each address in it, the first of each section and address.

    A section begins with ``## name``; what stands before the first is
    ``Unknown``.  Trailing marks are no part of an address.
    """
    from pyspark.sql import Window

    rows = docs.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("at", "content"))
    head = F.when(F.col("content").rlike(r"^##\s+.+$"), F.trim(F.regexp_extract("content", r"^##\s+(.+)$", 1)))
    above = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    section = F.coalesce(F.last(head, ignorenulls=True).over(above), F.lit("Unknown"))
    found = rows.withColumn("section", section).select("id", "section", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all("content", F.lit(r"https?://[^\s)`|]+"), F.lit(0))).alias("url"))
    return found.withColumn("url", F.regexp_replace("url", "[),.;]+$", "")).groupBy("id", "section", "url").agg(F.min("line").alias("line"))
