"""Whether a search pattern is safe to run: its length and its nested repetitions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest pattern that is accepted, and what is said of others.
MOST_CHARS = 1000
TOO_LONG = "Pattern too long (max 1000 characters)"
NESTED = "Nested quantifiers detected (potential ReDoS). Simplify the pattern."


def repetition_marks(pattern: Column) -> Column:
    """What matters of a pattern: ``(`` and ``)``, ``Q`` for a repetition and ``R`` for a group's end with one.

    Escaped characters and character classes repeat nothing themselves.  A
    question mark that begins a group's options counts as a repetition.
    """
    plain = F.regexp_replace(pattern, r"(?s)\\.?", "x")
    plain = F.regexp_replace(plain, r"\[[^\]]*\]?", "x")
    plain = F.regexp_replace(plain, r"(?:[+*?]|\{[0-9]+,?[0-9]*\})[?+]?", "\u0001")
    plain = F.regexp_replace(plain, "\\)\u0001", "\u0002")
    return F.translate(F.regexp_replace(plain, "[^()\u0001\u0002]", ""), "\u0001\u0002", "QR")


def is_nested(pattern: Column) -> Column:
    """Whether something repeated holds a repetition.

    The marks are read once.  What is remembered is a digit for each open
    group: 1 where it holds a repetition.  ``!`` stands for a nested one.
    """

    def closed(groups: Column, marks: Column) -> Column:
        rest = F.substr(groups, F.lit(1), F.char_length(groups) - 1)
        return F.when(marks & (rest != ""), F.concat(F.substr(rest, F.lit(1), F.char_length(rest) - 1), F.lit("1"))).otherwise(rest)

    def step(groups: Column, mark: Column) -> Column:
        inner = F.endswith(groups, F.lit("1"))
        return (
            F.when(groups.startswith("!"), groups)
            .when(mark == "(", F.concat(groups, F.lit("0")))
            .when(mark == ")", closed(groups, inner))
            .when((mark == "R") & inner, "!")
            .when(mark == "R", closed(groups, F.lit(True)))
            .when(F.contains(groups, F.lit("1")), "!")
            .when(groups == "", groups)
            .otherwise(F.concat(F.substr(groups, F.lit(1), F.char_length(groups) - 1), F.lit("1")))
        )

    marks = repetition_marks(pattern)
    return F.when(marks == "", False).otherwise(F.aggregate(F.split(marks, ""), F.lit(""), step) == "!")


def unsafe_reason(pattern: Column) -> Column:
    """Why a pattern is refused; null for one that is safe, and for a null pattern."""
    return F.when(F.char_length(pattern) > MOST_CHARS, TOO_LONG).when(is_nested(pattern), NESTED)
