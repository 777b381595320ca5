"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom import fixed


def trim_all(text: Column) -> Column:
    """Strips every Unicode blank at both ends, not only spaces."""
    return F.btrim(text, F.lit(fixed.TRIM_CHARACTERS))


def is_blank(text: Column) -> Column:
    """True where a text is null or holds blanks only."""
    return F.coalesce(trim_all(text), F.lit("")) == F.lit("")


def not_empty(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluates `value` once and hands it to `body` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)
