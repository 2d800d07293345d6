"""Keys under which spelled variants and formatting variants of a value meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, Unicode included.
OUTER_BLANKS = r"(?U)^\s+|\s+$"


def source_key(c: Column) -> Column:
    """Lower case without outer blanks; null stays null, blank becomes ''."""
    return F.lower(F.regexp_replace(c, OUTER_BLANKS, ""))


def filled_key(c: Column) -> Column:
    """As :func:`source_key`, with null for blank values."""
    key = source_key(c)
    return F.when(key != "", key)


def letters_digits(c: Column) -> Column:
    """The sequence of letters and digits, case ignored.

    Upper case comes first, so that letters with a longer upper case (sharp s) meet it; directly around it
    the optimizer would drop it.
    """
    return F.lower(F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]+", ""))


def word_line(c: Column) -> Column:
    """Words (maximal runs of letters and digits, lower case) joined by one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def once(c: Column) -> Column:
    """``c`` as the only output of a generator: computed once a row, as filters on it aren't pushed below and copied."""
    return F.explode(F.array(c))
