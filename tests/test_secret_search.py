"""Every pattern of the table: made texts that match, three engines, and the search for all at once."""

import random
import re
from re import _constants as C
from re import _parser

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions.required_parts import python_source, required_parts
from loomwork.functions.secret_patterns import SECRET_PATTERNS
from loomwork.functions.secret_search import SecretSearch


def made(parsed, rng):
    """A string that the parsed pattern matches, but for bounds."""
    out = []
    for kind, value in parsed:
        if kind is C.LITERAL:
            out.append(chr(value))
        elif kind is C.NOT_LITERAL:
            out.append("x" if value != ord("x") else "y")
        elif kind is C.ANY:
            out.append("z")
        elif kind is C.IN:
            out.append(rng.choice(members(value)))
        elif kind is C.SUBPATTERN:
            out.append(made(value[3], rng))
        elif kind is C.BRANCH:
            out.append(made(rng.choice(value[1]), rng))
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            out += [made(inner, rng) for _ in range(rng.randint(low, min(high, low + 2)))]
    return "".join(out)


def members(value):
    pool = [chr(c) for c in range(33, 127)]
    if value[0][0] is C.NEGATE:
        taken = set(members(value[1:]))
        return [c for c in "abcdefgh0123" if c not in taken] or [c for c in pool if c not in taken]
    found = []
    for kind, own in value:
        if kind is C.LITERAL:
            found.append(chr(own))
        elif kind is C.RANGE:
            found += [chr(c) for c in range(own[0], min(own[1], own[0] + 25) + 1)]
        elif kind is C.CATEGORY:
            found += {C.CATEGORY_DIGIT: "0123456789", C.CATEGORY_WORD: "abcXYZ019_", C.CATEGORY_SPACE: " \t", C.CATEGORY_NOT_SPACE: "ab:/"}.get(own, "ab")
    return found


@pytest.fixture(scope="module")
def cases():
    rng, rows = random.Random(11), []
    for k, (_, pattern, _) in enumerate(SECRET_PATTERNS):
        source = python_source(pattern)
        tries = [f"{a}{made(_parser.parse(source, re.ASCII), rng)}{b}" for a, b in (("", ""), (" ", " "), ("x = \"", "\";"), ("é", "é\n"), ("a", ", "), ("\n", "-z"), ("a", "a"), (" ", "a"), ("=", "=")) * 8]
        hits = [t for t in tries if re.search(source, t, re.ASCII)]
        assert hits, SECRET_PATTERNS[k][0]
        rows += [(k, t) for t in hits[:3] + [t for t in tries if t not in hits][:2]]
    return rows


def test_parts_are_in_every_match(cases):
    finder = SecretSearch()
    assert sum(not required_parts(p) for _, p, _ in SECRET_PATTERNS) <= 7
    for k, text in cases:
        if finder.pattern(k).search(text):
            assert k in finder.candidates(text), SECRET_PATTERNS[k][0]


def test_engines_agree_on_each_pattern(spark, cases):
    finder, con = SecretSearch(), duckdb.connect()
    want = {(k, t): finder.pattern(k).sub("[!]", t) for k, t in cases}
    df = spark.createDataFrame(cases, "k int, t string")
    for k in range(0, len(SECRET_PATTERNS), 38):
        part = df.where(F.col("k").between(k, k + 37))
        table = F.array(*[F.lit(T.ascii_bounds(p)) for _, p, _ in SECRET_PATTERNS[k : k + 38]])
        done = F.regexp_replace("t", F.get(table, F.col("k") - k), F.lit("[!]"))
        assert {(r.k, r.t): r.out for r in part.select("k", "t", done.alias("out")).collect()} == {x: y for x, y in want.items() if k <= x[0] <= k + 37}
    for (k, t), out in want.items():
        pattern = SECRET_PATTERNS[k][1]
        if "{0,2000}" not in pattern:
            assert con.execute("select regexp_replace(?, ?, '[!]', 'g')", [t, pattern]).fetchone()[0] == out, SECRET_PATTERNS[k][0]


def one_by_one(text, path):
    n, names = 0, []
    for name, pattern, where in SECRET_PATTERNS:
        if where is None or (path is not None and re.search(where, path)):
            text, found = re.subn(python_source(pattern), f"[REDACTED-{name}]", text, flags=re.ASCII)
            n, names = n + found, names + [name] * bool(found)
    return text, n, names


def test_redaction_equals_one_pattern_after_the_other(spark, cases):
    rng = random.Random(5)
    texts = [" ".join(t for _, t in rng.sample(cases, 4)) for _ in range(120)] + ["", "no secrets here", None]
    rows = [(k, t, rng.choice([None, "a/wandb/postmark.env", "k8s/secret.yaml"])) for k, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "k int, t string, path string").select("k", T.redacted(F.col("t"), F.col("path")).alias("r")).collect()
    for r in got:
        _, t, path = rows[r.k]
        assert (r.r is None) if t is None else (r.r.text, r.r.n, r.r.names) == one_by_one(t, path)


def test_mask_equals_the_whole_union(spark, cases):
    rng = random.Random(6)
    union = re.compile("|".join(f"(?:{python_source(p).removeprefix('(?i)')})" for _, p, _ in SECRET_PATTERNS), re.ASCII | re.IGNORECASE)
    texts = [rng.choice((str, str.upper))(" ".join(t for _, t in rng.sample(cases, 2))) for _ in range(120)] + ["", "plain", None]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.mask_secrets(F.col("t")).alias("m")).collect()
    for r in got:
        t = texts[r.k]
        assert r.m == (None if t is None else union.sub(lambda m: "".join("*" if k % 2 == 0 else c for k, c in enumerate(m[0])), t))
    assert spark.range(1).select(T.mask_secrets(F.lit("id hf_" + "Ab" * 17)).alias("m")).first().m == "id *f*" + "A*" * 17
