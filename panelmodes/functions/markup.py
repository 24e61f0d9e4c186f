"""Plain text of lightly marked-up text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that many fonts lack, and what stands for them.
GLYPHS = (("₁", "1"), ("₂", "2"), ("₃", "3"), ("₄", "4"), ("₅", "5"), ("₆", "6"), ("₇", "7"), ("₈", "8"), ("₉", "9"), ("₀", "0"), ("₊", "+"), ("₋", "-"), ("∈", "in"))
# Patterns and what replaces them, in this order: images, links, heading signs at the start.
PATTERNS = ((r"!\[([^\]]*)\]\([^)]+\)", "[рис.: @1]"), (r"\[([^\]]+)\]\([^)]+\)", "@1"))
HEADING = r"^#+\s*"
# What is deleted or replaced as it is, before and after the heading signs.
MARKS = (("**", ""), ("__", ""), ("`", ""))
FORMULAS = (
    ("---", ""), ("\\(", ""), ("\\)", ""), ("\\[", ""), ("\\]", ""), ("\\mathrm{reg}", "reg"), ("\\mathrm", ""), ("\\approx", "≈"), ("\\lambda", "λ"), ("\\Sigma", "Σ"),
    ("\\mathbf{1}", "1"), ("\\bigl", ""), ("\\bigr", ""), ("\\,", " "), ("$", ""), ("&lt;", "<"), ("&gt;", ">"),
)


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def plain_text(text: Column) -> Column:
    """Text without images, links, emphasis, code and heading signs and simple formulas; whole texts, NULL stays NULL."""
    text = _replaced(text, GLYPHS)
    for pattern, new in PATTERNS:
        text = F.regexp_replace(text, pattern, new.replace("@", "$"))
    text = F.regexp_replace(_replaced(text, MARKS), HEADING, "")
    return _replaced(text, FORMULAS)


def table_cells(line: Column) -> Column:
    """ARRAY of the trimmed cells of a table's line; NULL for its ruling lines."""
    bare = F.regexp_replace(F.trim(line), r"^\|+|\|+$", "")
    return F.when(~line.rlike(r"^\|?\s*-+"), F.transform(F.split(bare, r"\|"), lambda c: F.trim(c)))
