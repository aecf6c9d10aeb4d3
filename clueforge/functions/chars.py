"""Width and blank handling as Column expressions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width ASCII block U+FF01..U+FF5E and the ideographic space, built from the block's rule.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  "


def narrow(c: Column) -> Column:
    """Full-width ASCII forms and wide blanks to their ASCII forms."""
    return F.translate(c, _WIDE, _NARROW)


def squeeze(c: Column) -> Column:
    """All runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_blank(c: Column) -> Column:
    """True for null, empty or white-space-only text."""
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def filled(c: Column) -> Column:
    """c, or null where it is blank."""
    return F.when(is_blank(c), F.lit(None).cast("string")).otherwise(c)
