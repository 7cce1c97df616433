"""Column functions over strings and pipe-joined values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: str | Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(col(c), F.lit(""))


def has_value(c: str | Column) -> Column:
    """Neither null, empty nor zero."""
    text = col(c).cast("string")
    return text.isNotNull() & ~text.isin("", "0")


def values(c: str | Column) -> Column:
    """The values of a pipe-joined string, without empty ones."""
    return F.array_remove(F.split(filled(c), "\\|"), "")


def joined(c: str | Column) -> Column:
    return F.array_join(col(c), "|")


def merge_values(first: str | Column, second: str | Column) -> Column:
    """Values of two arrays, the first's order first; case-insensitive copies of the second go."""
    first, second = col(first), col(second)
    return F.concat(first, F.filter(second, lambda x: ~F.array_contains(F.transform(first, F.lower), F.lower(x))))


def valid_part(c: str | Column) -> Column:
    """A string up to its first invalid byte; a valid one is left as it is."""
    text = filled(c)
    mended = F.make_valid_utf8(text)
    return F.when(F.is_valid_utf8(text), text).otherwise(F.substring_index(mended, "\ufffd", 1))


def repair(c: str | Column, most: int = 2000) -> Column:
    """A string fit for a tab-separated row: cut at invalid bytes, no backslash or control character, tabs and line feeds as spaces, cut at ``most``."""
    text = F.regexp_replace(F.translate(valid_part(c), "\t\n", "  "), "[\\\\\\x00-\\x08\\x0b-\\x1f\\x7f]", "")
    return F.left(text, F.lit(most))


def flag(c: str | Column) -> Column:
    """A stored flag (``'true'`` or empty) as boolean; 1 and ``'1'`` count as well."""
    return F.lower(filled(col(c).cast("string"))).isin("true", "1")


def slug(c: str | Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def humanize(c: str | Column) -> Column:
    """A slug as words in capitals."""
    return F.initcap(F.lower(F.regexp_replace(col(c), "-+", " ")))


def csv_field(c: str | Column) -> Column:
    """A value as one field of a CSV line; quoted where it must be."""
    text = filled(col(c).cast("string"))
    return F.when(text.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
