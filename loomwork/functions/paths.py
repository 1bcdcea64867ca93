"""File paths and names as column expressions.

A null path gives null.  Folders are parted by ``/``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names by which files are told apart.
TEST_PATHS = (
    r"(?:^|[\\/])(?:__tests__|__test__|tests)(?:[\\/]|$)",
    r"(?:\.test|_test|\.spec)\.(?:ts|tsx|js|jsx|mjs|cjs)$",
    r"(?:^|[\\/])test_[^/\\]*\.py$",
    r"_test\.py$",
    r"(?:^|[\\/])conftest\.py$",
)
ENTRY_POINTS = (r"(^|/)(index|main|app|server|cli|public)\.[mc]?[jt]sx?$", r"\.(config)\.[mc]?[jt]sx?$")
NAME_STYLES = (
    ("kebab", "^[a-z0-9]+(?:-[a-z0-9]+)+$"),
    ("snake", "^[a-z0-9]+(?:_[a-z0-9]+)+$"),
    ("camel", "^[a-z]+(?:[A-Z][a-z0-9]*)+$"),
    ("flat", "^[a-z0-9]+$"),
)
PERMISSIONS = ("---", "--x", "-w-", "-wx", "r--", "r-x", "rw-", "rwx")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """What follows the last dot of the whole path; empty without a dot, or where the only dot comes first."""
    parts = F.split(path, r"\.")
    none = (F.size(parts) <= 1) | ((F.size(parts) == 2) & (F.get(parts, F.lit(0)) == ""))
    return F.when(none, "").otherwise(F.element_at(parts, -1))


def is_test(path: Column) -> Column:
    return path.rlike("|".join(TEST_PATHS))


def is_entry_point(path: Column) -> Column:
    return F.lower(path).rlike("|".join(ENTRY_POINTS))


def is_ignored(path: Column, *, endings: tuple[str, ...], names: tuple[str, ...], folders: tuple[str, ...]) -> Column:
    """Whether the name has one of the ``endings``, is one of ``names``, or any part of the path is one of ``folders``."""
    found = name_of(path).isin(*names)
    for ending in endings:
        found = found | F.endswith(name_of(path), F.lit(ending))
    return found | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))


def package_of(path: Column) -> Column:
    """``packages/x`` for what lies there, else the top folder, else ``<root>``."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\.?/", "")
    package = F.regexp_extract(plain, "^(packages/[^/]+)", 1)
    top = F.get(F.split(plain, "/"), F.lit(0))
    return F.when(package != "", package).when(top != "", top).otherwise("<root>")


def name_style(name: Column) -> Column:
    style = F.lit("other")
    for label, pattern in reversed(NAME_STYLES):
        style = F.when(name.rlike(pattern), label).otherwise(style)
    return F.when(name.isNotNull(), style)


def snake_case(text: Column) -> Column:
    parted = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(parted, r"[-\s]+", "_"))


def pascal_case(text: Column) -> Column:
    words = F.filter(F.split(text, "_"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "")


def permissions(mode: Column) -> Column:
    """Mode bits as ``rwxr-xr-x``."""
    names = F.array(*map(F.lit, PERMISSIONS))
    return F.concat(*[F.get(names, F.shiftright(mode, shift).bitwiseAND(7)) for shift in (6, 3, 0)])


def shown_path(path: Column, root: str, home: str) -> Column:
    """A path below ``root`` is shown without it, one below ``home`` behind ``~``, others by their names."""
    def below(top: str) -> Column:
        return F.startswith(path, F.lit(top.rstrip("/") + "/"))

    inner = F.substr(path, F.lit(len(root.rstrip("/")) + 2))
    return F.when(path == root, ".").when(below(root), inner).when(below(home), F.concat(F.lit("~/"), F.substr(path, F.lit(len(home.rstrip("/")) + 2)))).otherwise(name_of(path))


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-1."""
    return F.substr(F.sha1(text.cast("binary")), F.lit(1), F.lit(16))


def cache_key(prefix: str, *parts: tuple[str, Column]) -> Column:
    """``v1-prefix:`` and the SHA-256 of the named parts, sorted by name, without null ones."""
    named = F.concat_ws(",", *[F.concat(F.lit(f'"{name}":"'), value.cast("string"), F.lit('"')) for name, value in sorted(parts, key=lambda p: p[0])])
    return F.concat(F.lit(f"v1-{prefix}:"), F.sha2(F.concat(F.lit("{"), named, F.lit("}")).cast("binary"), 256))


def size_with_space(n: Column, *, giga: bool = False) -> Column:
    """``512 B``, ``1.5 KB``, ``2.0 MB`` and, with ``giga``, ``1.25 GB``."""
    def of(power: int, digits: int, unit: str) -> Column:
        return F.format_string(f"%.{digits}f {unit}", n.cast("double") / F.lit(float(1024**power)))

    shown = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, of(1, 1, "KB"))
    return shown.when(n < 1024**3, of(2, 1, "MB")).otherwise(of(3, 2, "GB")) if giga else shown.otherwise(of(2, 1, "MB"))


def char_of_byte(text: Column, at: Column) -> Column:
    """Characters before a byte offset in UTF-8; an offset inside a character counts the whole of it."""
    head = F.substr(text.cast("binary"), F.lit(1), at)
    starts = F.regexp_count(F.hex(head), F.lit("(?:[0-7C-F].|[89AB].)"))  # bytes
    later = F.size(F.filter(F.regexp_extract_all(F.hex(head), F.lit("(..)"), F.lit(1)), lambda b: b.rlike("^[89AB]")))
    return (starts - later).cast("long")


def byte_of_char(text: Column, at: Column) -> Column:
    """Bytes in UTF-8 before a character offset."""
    return F.octet_length(F.substr(text, F.lit(1), at)).cast("long")
