"""Search for any of many secret patterns, and what is done with what is found.

Built-in functions try one pattern at a time, so a table of hundreds of patterns
reads each text hundreds of times.  Here each task builds an automaton of the
strings that matches must hold, reads a text once with it, and tries only the
patterns that can match.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loomwork.functions.required_parts import python_source, required_parts
from loomwork.functions.secret_patterns import SECRET_PATTERNS

#: Characters (UTF-16 units) beyond which a text is replaced as a whole, by what, and its name.
MOST_CHARS, TOO_LONG, TOO_LONG_NAME = 10_000_000, "[CONTENT-REDACTED-SIZE-LIMIT]", "content-size-exceeded"


class SecretSearch:
    """All patterns of the table, by what their matches must hold."""

    def __init__(self):
        self.always, self.parts = [], ahocorasick.Automaton()
        by_part: dict[str, list[int]] = {}
        for k, (_, pattern, _) in enumerate(SECRET_PATTERNS):
            for part in required_parts(pattern):
                by_part.setdefault(part, []).append(k)
            if not required_parts(pattern):
                self.always.append(k)
        for part, which in by_part.items():
            self.parts.add_word(part, tuple(which))
        self.parts.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Patterns that may match, in the table's order; all others can't."""
        found = {which for _, which in self.parts.iter(text.lower())}
        return sorted({*self.always}.union(*found))

    @functools.cache
    def pattern(self, k: int) -> re.Pattern:
        return re.compile(python_source(SECRET_PATTERNS[k][1]), re.ASCII)

    @functools.cache
    def paths(self, k: int) -> re.Pattern | None:
        where = SECRET_PATTERNS[k][2]
        return re.compile(where) if where else None

    @functools.lru_cache(maxsize=256)
    def union(self, which: tuple[int, ...]) -> re.Pattern:
        """One alternation of some patterns, upper and lower case alike."""
        sources = (python_source(SECRET_PATTERNS[k][1]).removeprefix("(?i)") for k in which)
        return re.compile("|".join(f"(?:{s})" for s in sources), re.ASCII | re.IGNORECASE)

    def redact(self, text: str, path: str | None) -> tuple[str, int, list[str]]:
        """Each pattern in turn, over what the ones before left; what a mark brings into the text counts, too."""
        if 2 * len(text) > MOST_CHARS and len(text.encode("utf-16-le")) > 2 * MOST_CHARS:
            return TOO_LONG, 1, [TOO_LONG_NAME]
        total, names, todo = 0, [], self.candidates(text)
        while todo:
            k, *todo = todo
            where = self.paths(k)
            if where and not (path is not None and where.search(path)):
                continue
            name = SECRET_PATTERNS[k][0]
            text, n = self.pattern(k).subn(f"[REDACTED-{name}]", text)
            if n:
                total, names = total + n, [*names, name]
                todo = [c for c in self.candidates(text) if c > k]
        return text, total, names

    def mask(self, text: str) -> str:
        which = tuple(self.candidates(text))
        return self.union(which).sub(lambda m: every_other(m[0]), text) if which else text


def every_other(text: str) -> str:
    return "".join("*" if k % 2 == 0 else c for k, c in enumerate(text))


@functools.cache
def search() -> SecretSearch:
    """Built once in each worker process."""
    return SecretSearch()


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("n", IntegerType()), StructField("names", ArrayType(StringType()))]))
def _redacted(texts: pa.Array, paths: pa.Array) -> pa.Array:
    found = [None if t is None else search().redact(t, p) for t, p in zip(texts.to_pylist(), paths.to_pylist())]
    rows = [None if x is None else {"text": x[0], "n": x[1], "names": x[2]} for x in found]
    return pa.array(rows, pa.struct([("text", pa.string()), ("n", pa.int32()), ("names", pa.list_(pa.string()))]))


@F.arrow_udf(StringType())
def _masked(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else search().mask(t) for t in texts.to_pylist()], pa.string())


def redacted(text: Column, path: Column | None = None) -> Column:
    """Struct of ``text`` after the whole pattern table, ``n`` replaced places and the ``names`` found; null for a null text.

    Each pattern is applied to what the ones before left.  A pattern for certain
    paths needs a path that matches.  Longer texts than MOST_CHARS are replaced whole.
    """
    return _redacted(text.cast("string"), F.lit(None).cast("string") if path is None else path.cast("string"))


def mask_secrets(text: Column) -> Column:
    """``text`` with a star for every other character of each place that any pattern of the table finds.

    All patterns are one alternation without regard to case: the leftmost match
    wins, of those at one place the first pattern's, and matches don't overlap.
    Patterns for certain paths take part as well.  Characters are code points.
    """
    return _masked(text.cast("string"))
