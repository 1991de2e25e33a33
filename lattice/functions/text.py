"""Numbers in text, read as loosely typed tables have them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BODY = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_BLANK = r"[ \t\n\r\x0B\f]*"
#: A whole text that is a number, blanks around it allowed; a number at a text's start.
NUMBER = rf"^{_BLANK}{_BODY}{_BLANK}$"
PREFIX = rf"^{_BLANK}({_BODY})"


def is_numeric(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMBER), F.lit(False))


def float_value(text: Column) -> Column:
    """The number at the text's start, else 0: '12abc' is 12, '', null and 'x' are 0."""
    found = F.nullif(F.regexp_extract(text, PREFIX, 1), F.lit(""))
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def is_missing(text: Column) -> Column:
    return text.isNull() | (text == "")
