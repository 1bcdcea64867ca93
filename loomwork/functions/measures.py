"""Measures of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text, null for a null one."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars)
    # equal characters stand together: where one differs from the one before, a run ends
    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k == n) | (F.get(chars, k - 1) != F.get(chars, k)))
    runs = F.zip_with(ends, F.concat(F.array(F.lit(0)), ends), lambda a, b: a - b)
    shares = F.transform(F.filter(runs, lambda r: r > 0), lambda r: r / n)
    return F.when(n == 0, 0.0).when(n > 0, F.aggregate(shares, F.lit(0.0), lambda acc, s: acc - s * F.log2(s)))


def volume(text: Column, operands: str, operators: str) -> Column:
    """Halstead struct: vocabulary, length, volume, difficulty, effort."""
    a, b = (F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (operators, operands))
    n1, n2, m1, m2 = F.size(F.array_distinct(a)), F.size(F.array_distinct(b)), F.size(a), F.size(b)
    size = (m1 + m2) * F.log2(F.greatest(n1 + n2, F.lit(1)).cast("double"))
    hard = F.when(n2 > 0, n1 / 2.0 * m2 / n2).otherwise(0.0)
    return F.struct((n1 + n2).cast("long").alias("vocabulary"), (m1 + m2).cast("long").alias("length"), F.round(size, 3).alias("volume"), F.round(hard, 3).alias("difficulty"), F.round(size * hard, 1).alias("effort"))


def maintainability(volume: Column, complexity: Column, lines: Column) -> Column:
    """0 to 100; volume and lines count as 1 at least."""
    one = F.lit(1.0)
    raw = (171 - 5.2 * F.ln(F.greatest(volume, one)) - 0.23 * complexity - 16.2 * F.ln(F.greatest(lines.cast("double"), one))) * 100 / 171
    return F.greatest(F.lit(0.0), raw)


def cut_at_space(text: Column, limit: int) -> Column:
    """At most ``limit`` code points, cut at the last blank if that keeps 60 %, then three dots."""
    head = F.substr(text, F.lit(1), F.lit(limit))
    blank = limit - F.instr(F.reverse(head), " ")  # what stands before the last blank
    kept = F.when(F.contains(head, F.lit(" ")) & (blank >= limit * 0.6), F.substr(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.char_length(text) > limit, F.concat(kept, F.lit("..."))).otherwise(text)


def size_bytes(text: Column) -> Column:
    """Bytes of ``1024``, ``1.5KB`` or ``2G``, rounded half up; null for anything else."""
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, r"^[0-9.]+([KMGTkmgt]?)[Bb]?$", 1))
    power = F.instr(F.lit("KMGT"), unit)
    factor = F.pow(F.lit(1024.0), F.when(unit == "", 0).otherwise(power))
    return F.when(F.rlike(text, F.lit(r"^[0-9]+(\.[0-9]+)?[KMGTkmgt]?[Bb]?$")), F.floor(number * factor + 0.5))


def minified(html: Column) -> Column:
    """Markup without comments, runs of space or space between tags."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\n]+", " "), r"> <", "><"))
