"""Nested rows as YAML, and without what is empty: expressions derived from the schema."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, NumericType, StringType, StructType

#: Fields that keep an empty list at the top, and fields within which deeper empty lists stay.
KEPT_EMPTY, LISTS_KEPT_WITHIN = "results", ("files", "repositories")
#: Characters that a quoted text names by a letter; other control characters are named by number.
ESCAPES = (("\0", "0"), ("\a", "a"), ("\b", "b"), ("\t", "t"), ("\n", "n"), ("\v", "v"), ("\f", "f"), ("\r", "r"), ("\x1b", "e"), ("\x85", "N"), ("\xa0", "_"), ("\u2028", "L"), ("\u2029", "P"))


def cleaned(value: Column, kind: DataType, *, depth: int = 0, within: bool = False) -> Column:
    """``value`` with null for what has nothing in it, at every depth: NaN, lists and structs of nothing.

    Empty strings stay.  An empty list named ``results`` stays at the top, and
    so do empty lists two steps or deeper within ``files`` or ``repositories``.
    """
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, ArrayType):
        inner = F.filter(F.transform(value, lambda x: cleaned(x, kind.elementType, depth=depth + 1, within=within)), lambda x: x.isNotNull())
        return inner if within and depth >= 2 else F.when(F.size(inner) > 0, inner)
    if isinstance(kind, StructType):
        fields = []
        for f in kind:
            enters = f.name in LISTS_KEPT_WITHIN and not within
            own = cleaned(value[f.name], f.dataType, depth=0 if enters else depth + 1, within=within or enters)
            if f.name == KEPT_EMPTY and depth == 0 and isinstance(f.dataType, ArrayType):
                own = F.when(F.size(value[f.name]) == 0, value[f.name]).otherwise(own)
            fields.append(own.alias(f.name))
        some = [f.isNotNull() for f in fields]
        found = some[0]
        for more in some[1:]:
            found = found | more
        return F.when(value.isNotNull() & found, F.struct(*fields))
    return value


def quoted(text: Column) -> Column:
    """A text in double quotes, as YAML escapes it."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for char, letter in ESCAPES:
        escaped = F.replace(escaped, F.lit(char), F.lit("\\" + letter))
    named = {c for c, _ in ESCAPES}
    for code in [*range(32), *range(127, 160)]:
        if chr(code) not in named:
            escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"\\x{code:02X}"))
    odd = text.rlike("[\\x00-\\x1f\\x7f-\\xa0\\u2028\\u2029]")
    return F.concat(F.lit('"'), F.when(odd, escaped).otherwise(plain), F.lit('"'))


def key_text(name: str) -> str:
    """A key is plain where YAML reads it as a string."""
    plain = re.fullmatch(r"[A-Za-z_][\w-]*", name) and name.lower() not in ("true", "false", "null")
    return name if plain else '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'


def scalar(value: Column, kind: DataType) -> Column:
    if isinstance(kind, BooleanType):
        text = value.cast("string")
    elif isinstance(kind, (DoubleType, FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        text = F.when(F.isnan(value), ".nan").when(value == float("inf"), ".inf").when(value == float("-inf"), "-.inf").when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    elif isinstance(kind, NumericType):
        text = value.cast("string")
    else:
        text = quoted(value if isinstance(kind, StringType) else value.cast("string"))
    return F.coalesce(text, F.lit("null"))


def ordered(kind: StructType, priority: tuple[str, ...], sort_keys: bool) -> list:
    """Fields of a struct: those of ``priority`` first, in its order, then the rest by place or by name."""
    first = [kind[name] for name in priority if name in kind.names]
    rest = [f for f in kind if f.name not in priority]
    return first + (sorted(rest, key=lambda f: f.name) if sort_keys else rest)


def to_yaml(value: Column, kind: DataType, *, priority: tuple[str, ...] = (), sort_keys: bool = False) -> Column:
    """``value`` as block-style YAML, indented by two, all texts in double quotes; null fields are left out, null items are ``null``."""

    def nested(own: Column, kind: DataType, level: int) -> Column:
        """What follows a key: on the same line, or as a block below it."""
        if isinstance(kind, (StructType, ArrayType)):
            return empty_or(own, kind, lambda: F.concat(F.lit("\n" + " " * level), block(own, kind, level)), " ")
        return F.concat(F.lit(" "), scalar(own, kind))

    def empty_or(own: Column, kind: DataType, full: Callable[[], Column], lead: str) -> Column:
        if isinstance(kind, ArrayType):
            return F.when(own.isNull(), lead + "null").when(F.size(own) == 0, lead + "[]").otherwise(full())
        nothing = F.lit(True)
        for f in kind:
            nothing = nothing & own[f.name].isNull()
        return F.when(own.isNull(), lead + "null").when(nothing, lead + "{}").otherwise(full())

    def block(own: Column, kind: DataType, level: int) -> Column:
        """Lines of a value, the first without its indentation."""
        between = "\n" + " " * level
        if isinstance(kind, StructType):
            parts = [F.when(own[f.name].isNotNull(), F.concat(F.lit(key_text(f.name) + ":"), nested(own[f.name], f.dataType, level + 2))) for f in ordered(kind, priority, sort_keys)]
            return F.concat_ws(between, *parts)
        if isinstance(kind, ArrayType):
            return F.array_join(F.transform(own, lambda x: F.concat(F.lit("- "), item(x, kind.elementType, level + 2))), between)
        return scalar(own, kind)

    def item(own: Column, kind: DataType, level: int) -> Column:
        if isinstance(kind, (StructType, ArrayType)):
            return empty_or(own, kind, lambda: block(own, kind, level), "")
        return scalar(own, kind)

    return F.concat(item(value, kind, 0), F.lit("\n"))


def yaml_rows(df, name: str = "yaml", *, priority: tuple[str, ...] = (), sort_keys: bool = False, clean: bool = True):
    """One column: each row of ``df`` as YAML, cleaned first."""
    row, kind = F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema
    shown = df.select(cleaned(row, kind).alias("row")) if clean else df.select(row.alias("row"))
    return shown.select(F.when(F.col("row").isNull(), "{}\n").otherwise(to_yaml(F.col("row"), kind, priority=priority, sort_keys=sort_keys)).alias(name))
