"""What any match of a pattern must hold, so that texts without it need no search."""

from __future__ import annotations

import functools
import itertools
import re
from re import _constants as C
from re import _parser

#: Alternatives that a guard may list; beyond, parts are not combined.
MOST_PARTS = 24
#: Shorter parts stand in nearly every text.
LEAST_CHARS = 2


def python_source(pattern: str) -> str:
    """The pattern as Python's parser reads it: characters by number and the very end are written otherwise."""
    return re.sub(r"\\x\{([0-9a-f]{1,4})\}", lambda m: "\\u" + m[1].zfill(4), pattern).replace(r"\z", r"\Z")


@functools.cache
def required_parts(pattern: str) -> tuple[str, ...]:
    """Lower-case strings one of which is in the lower-case text of any match; empty where none are known.

    The pattern is read with Python's own parser, which knows these patterns'
    constructs; what it can't read has no known parts and is always searched.
    """
    try:
        parsed = _parser.parse(python_source(pattern), re.ASCII)
    except (re.error, OverflowError):
        return ()
    found = best(runs(parsed))
    return tuple(sorted(found)) if min(map(len, found), default=0) >= LEAST_CHARS else ()


def best(sets: list[set[str]]) -> set[str]:
    """The set whose shortest string is longest; of equal ones the smallest."""
    return max((s for s in sets if s), key=lambda s: (min(map(len, s)), -len(s)), default=set())


def runs(parsed) -> list[set[str]]:
    """Sets of strings of which each match holds one: a set for each run of certain characters, and of what is repeated or chosen."""
    done, run = [], {""}
    for kind, value in parsed:
        fixed = exact(kind, value)
        if fixed is not None and len(run) * len(fixed) <= MOST_PARTS:
            run = {a + b for a, b in itertools.product(run, fixed)}
            continue
        if kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        done.append(run)
        run = {""}
        if kind is C.SUBPATTERN:
            done.append(best(runs(value[3])))
        elif kind is C.BRANCH:
            each = [best(runs(branch)) for branch in value[1]]
            together = set().union(*each)
            if all(each) and len(together) <= MOST_PARTS:
                done.append(together)
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
            done.append(best(runs(value[2])))
    return [s for s in [*done, run] if "" not in s]


def exact(kind, value) -> set[str] | None:
    """All strings that an item of a pattern matches, in lower case, if they are few."""
    if kind is C.LITERAL:
        return {chr(value).lower()}
    if kind is C.IN:
        if any(k is not C.LITERAL for k, _ in value):
            return None
        return {chr(v).lower() for _, v in value}
    if kind is C.SUBPATTERN:
        return product([exact(k, v) for k, v in value[3]])
    if kind is C.BRANCH:
        each = [product([exact(k, v) for k, v in branch]) for branch in value[1]]
        return None if any(x is None for x in each) else set().union(*each)
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] == value[1] <= 8:
        return product([exact(k, v) for k, v in value[2]] * value[0])
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT) and (value[0], value[1]) == (0, 1):
        own = product([exact(k, v) for k, v in value[2]])
        return None if own is None else own | {""}
    return None


def product(sets: list[set[str] | None]) -> set[str] | None:
    """All concatenations, if each set is known and they are few."""
    found = {""}
    for own in sets:
        if own is None or len(found) * len(own) > MOST_PARTS:
            return None
        found = {a + b for a, b in itertools.product(found, own)}
    return found
