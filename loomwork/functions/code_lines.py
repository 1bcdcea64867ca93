"""What a line of source code is, as column expressions.  A null line gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of definitions (NAME stands for the symbol), kinds of symbols in the order in which they are looked for, and imports.
DEFINITIONS = (
    r"^(export\s+)?(const|let|var|function|class|interface|type|enum)\s+NAME\b",
    r"^(export\s+)?async\s+function\s+NAME\b",
    r"^(export\s+)?default\s+(function|class)\s+NAME\b",
    r"^(public|private|protected|static|async|readonly)?\s*NAME\s*[(:=]",
    r"^(def|class|async\s+def)\s+NAME\b",
    r"^NAME\s*=",
    r"^func\s+(\([^)]+\)\s+)?NAME\b",
    r"^(var|const|type)\s+NAME\b",
    r"^(pub\s+)?(fn|struct|enum|trait|type|const|static)\s+NAME\b",
)
KINDS = (
    (r"\bclass\b", "class"), (r"\binterface\b", "interface"), (r"\b(type)\s+\w", "type"), (r"\benum\b", "enum"), (r"\bnamespace\b", "namespace"), (r"\bmodule\b", "module"),
    (r"^(?!.*(?:=>|function)).*\bconst\b", "constant"), (r"^(?!.*(?:=>|function)).*\b(?:let|var)\b", "variable"), (r"\bproperty\b|^\s*(public|private|protected|readonly)\s+\w+\s*[:;]", "property"),
)
IMPORT, DYNAMIC_IMPORT = r"""^(?:import|export)\s+.*\bfrom\b\s+['"]""", r"""(?<![.\w])import\s*\(\s*['"]"""
LINE_CHARS, NAME_CHARS = 1000, 255


def quoted(name: Column) -> Column:
    """A name as a pattern for itself."""
    return F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def is_definition(line: Column, name: Column) -> Column:
    """Whether a line looks like the definition of ``name``; overlong lines and names don't."""
    pattern = F.replace(F.lit("|".join(DEFINITIONS)), F.lit("NAME"), quoted(name))
    return (F.char_length(line) <= LINE_CHARS) & (F.char_length(name) <= NAME_CHARS) & F.rlike(F.trim(line), pattern)


def symbol_kind(line: Column) -> Column:
    kind = F.lit("function")
    for pattern, label in reversed(KINDS):
        kind = F.when(F.trim(line).rlike(pattern), label).otherwise(kind)
    return F.when(line.isNotNull(), kind)


def is_import(line: Column) -> Column:
    return F.trim(line).rlike(IMPORT)


def is_dynamic_import(line: Column) -> Column:
    return line.rlike(DYNAMIC_IMPORT)


def calls(line: Column, name: Column) -> Column:
    """Whether a line calls ``name``."""
    return F.rlike(line, F.concat(F.lit(r"\b"), quoted(name), F.lit(r"\s*\(")))
