"""Source texts without comments and needless space, as column expressions.

Space means the ASCII space characters.  A null text gives null.  Comments are
found by pattern, so a mark inside a string literal counts as one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comments by family of languages, in the order in which they go, and how files of an ending are handled.
COMMENTS = {
    "c-style": (r"(?s)/\*.*?\*/", r"(?m)^\s*//.*$", r"(?m)\s+//.*$"),
    "hash": (r"(?m)^\s*#(?:[^!\n].*)?$", r"(?m)\s+#.*$"),
    "html": (r"(?s)<!--.*?-->",),
    "sql": (r"(?m)--.*$", r"(?s)/\*.*?\*/"),
    "lua": (r"(?m)^\s*--.*$", r"(?s)--\[\[.*?\]\]"),
    "template": (r"(?s)\{\{!--.*?--\}\}", r"(?s)\{\{!.*?\}\}", r"(?s)<%#.*?%>", r"(?s)\{#.*?#\}"),
    "haskell": (r"(?m)^\s*--.*$", r"(?m)\s+--.*$", r"(?s)\{-.*?-\}"),
}
CONSERVATIVE = {"c-style": ("ts", "tsx", "sass", "styl"), "hash": ("py", "yaml", "yml", "coffee", "nim", "haml", "slim")}
AGGRESSIVE = {"html": ("html", "htm", "xml", "svg"), "c-style": ("css", "less", "scss")}


def replaced(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def trimmed(text: Column) -> Column:
    return replaced(text, (r"^\s+|\s+\z", ""))


def without_comments(text: Column, *families: str) -> Column:
    return replaced(text, *[(pattern, "") for family in families for pattern in COMMENTS[family]])


def conservative(text: Column, *families: str) -> Column:
    """Lines stay; comments, blanks at their ends and more than one empty line in a row go."""
    return trimmed(replaced(without_comments(text, *families), (r"(?m)[ \t]+$", ""), (r"\n\s*\n\s*\n+", "\n\n")))


def aggressive(text: Column, *families: str) -> Column:
    """One line without space around braces, colons, semicolons and commas, and between tags."""
    return trimmed(replaced(without_comments(text, *families), (r"\s+", " "), (r"\s*([{}:;,])\s*", "$1"), (r">\s+<", "><")))


def general(text: Column) -> Column:
    return trimmed(replaced(text, (r"(?m)[ \t]+$", ""), (r"\r\n", "\n"), (r"\n\s*\n\s*\n+", "\n\n"), (r"[ \t]{3,}", " ")))


def markdown(text: Column) -> Column:
    """Markdown that means the same: no comments, even headings, lists and table bars, one empty line at most."""
    return trimmed(
        replaced(
            text, (r"(?s)<!--.*?-->", ""), (r"(?m)[ \t]+$", ""), (r"\r\n", "\n"), (r"\n\s*\n\s*\n+", "\n\n"), (r"([^\n])[ \t]{5,}([^\n])", "$1 $2"), (r"\s*\|\s*", " | "),
            (r"(?m)^(#{1,6})[ \t]+", "$1 "), (r"(?m)^(\s*)([-*+]|\d+\.)[ \t]+", "$1$2 "), (r"\n{3,}(```)", "\n\n$1"), (r"(```)\n{3,}", "$1\n\n"),
        )
    )


def json_text(text: Column) -> Column:
    """JSON without space outside of strings, keys in their order; with comments of C style removed where that makes it valid; else only trimmed."""
    bare = without_comments(text, "c-style")
    tight = lambda x: F.regexp_replace(x, r'("(?:[^"\\]|\\.)*")|\s+', "$1")
    return F.when(F.try_parse_json(text).isNotNull(), tight(text)).when(F.try_parse_json(bare).isNotNull(), tight(bare)).otherwise(trimmed(text))


def script(text: Column) -> Column:
    return trimmed(replaced(without_comments(text, "c-style"), (r"\s+", " "), (r"\s*([{}();,:])\s*", "$1")))


def by_extension(text: Column, extension: Column) -> Column:
    """A text handled as its file's ending asks; other endings as general text."""
    out = F.when(extension.isin("json", "jsonc"), json_text(text)).when(extension.isin("md", "markdown"), markdown(text)).when(extension.isin("js", "jsx", "mjs", "cjs"), script(text))
    for how, groups in ((conservative, CONSERVATIVE), (aggressive, AGGRESSIVE)):
        for family, endings in groups.items():
            out = out.when(extension.isin(*endings), how(text, family))
    return out.otherwise(general(text))
