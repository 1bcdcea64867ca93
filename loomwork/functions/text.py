"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.secret_search import TOO_LONG, mask_secrets, redacted  # noqa: F401

#: Patterns of redaction in the order in which they apply, each with what any match holds.
SECRETS = (
    ("TOKEN", r'token = "[0-9a-f]{40}"', 'token = "'),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@"),
    ("IPV4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "."),
)


def redact(text: Column) -> Column:
    """Each pattern in turn, over what the ones before left; texts without what a match holds are not searched."""
    def step(done: Column, entry: tuple[str, str, str]) -> Column:
        name, pattern, part = entry
        return F.when(F.contains(text, F.lit(part)), F.regexp_replace(done, pattern, f"[REDACTED-{name}]")).otherwise(done)

    return reduce(step, SECRETS, text)


def secret_count(text: Column) -> Column:
    """How many places of the original text the patterns find; null for a null text."""
    counts = (F.when(F.contains(text, F.lit(part)), F.regexp_count(text, F.lit(p))).when(text.isNotNull(), 0) for _, p, part in SECRETS)
    return reduce(lambda a, b: a + b, counts)


_BOUND = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def ascii_bounds(pattern: str) -> str:
    """The pattern for Java, with bounds of ASCII words."""
    pattern = re.sub(r"^((?:\(\?i\))?)\\b(?=\w(?![?*{]))", r"\1(?<!\\w)", pattern)  # a word character follows
    return pattern.replace(r"\b", _BOUND)


def masked(text: Column) -> Column:
    """Every other character, from the first, as a star."""
    return F.regexp_replace(text, r"(?s).(.?)", r"*$1")


def size_text(n: Column) -> Column:
    """Bytes with one decimal, halves upwards, and a unit of 1024."""

    def tenths(power: int) -> Column:
        return F.floor(n / 1024.0**power * 10 + 0.5) / 10

    out = F.format_string("%.1fTB", tenths(4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f{unit}", tenths(power))).otherwise(out)
    return out


def stripped(html: Column) -> Column:
    """Text of markup: scripts, styles and comments dropped, tags to blanks, basic entities decoded, space collapsed."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
