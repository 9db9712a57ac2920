"""Scalar text helpers: Python-like truth, white space, joins and identifiers as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space and the four separators that Python counts as such.
_SPACE = "(?U)[\\s\\x1c-\\x1f]+"
_EDGES = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"


def usable(c: Column) -> Column:
    """Null for the empty string: 'usable' means neither."""
    return F.nullif(c, F.lit(""))


def present(c: Column) -> Column:
    """Not null; an empty string counts as present."""
    return c.isNotNull()


def first_usable(*columns: Column) -> Column:
    """The first usable value; the last one as it is."""
    return F.coalesce(*[usable(c) for c in columns[:-1]], columns[-1])


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def squeeze(c: Column) -> Column:
    """Each run of white space to one space, none at the ends."""
    return strip(F.regexp_replace(c, _SPACE, " "))


def join_list(c: Column, separator: str) -> Column:
    """Null elements join as empty strings; a null list stays null."""
    return F.array_join(c, separator, "")


def flag(c: Column, value: str) -> Column:
    """1 where c equals value, else 0, also for null."""
    return c.eqNullSafe(F.lit(value)).cast("int")


def url_of(prefix: str, c: Column, suffix: str = "") -> Column:
    """prefix + c + suffix where c is usable, else null."""
    return F.when(usable(c).isNotNull(), F.concat(F.lit(prefix), c, F.lit(suffix)))


def head_of(c: Column, separator: str = ",") -> Column:
    return F.substring_index(c, separator, 1)


def label_missing(c: Column, label: str = "None") -> Column:
    """For display only, after grouping: null and empty are different groups."""
    return F.coalesce(usable(c), F.lit(label))
