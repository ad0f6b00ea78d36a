"""Text of cells: stripping, folding, emptiness. Blanks are Unicode white space throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Unicode's white space, and the four separators that count as such in text.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def fold(c: Column) -> Column:
    """Lower case, stripped, each run of white space one blank."""
    return F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " ")


def nonempty(c: Column) -> Column:
    """Stripped text, null if nothing is left."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def truthy(c: Column) -> Column:
    """Not null and not the empty string; blanks count."""
    return F.coalesce(c != "", F.lit(False))


def norm_cell_text(c: Column) -> Column:
    """Stripped lower-case text for comparisons; null is ''."""
    return F.coalesce(F.lower(strip(c.cast("string"))), F.lit(""))


def norm_header(c: Column) -> Column:
    """A header's text with all its lines folded into one and trailing `:.-` cut off."""
    return F.rtrim(fold(c), F.lit(":.-"))


def norm_header_first_line(c: Column) -> Column:
    """As norm_header, of the first line only."""
    return norm_header(F.substring_index(c, "\n", 1))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group of the first match captured; null without a match or if it captured nothing."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
