"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of a valid e-mail address, and the money type.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
MONEY = "decimal(14,2)"
TOTAL = "decimal(28,2)"


def blank_to_null(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def surrogate_key(*cols: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 16)


def row_hash(cols: list[str]) -> Column:
    """A hash of the columns' values; null counts as a value of its own."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols]), 256)


def email_valid(c: str) -> Column:
    return F.coalesce(F.rlike(c, F.lit(EMAIL)), F.lit(False))


def mask_name(c: str) -> Column:
    return F.concat(F.left(c, F.lit(1)), F.lit("***"))


def mask_email(c: str) -> Column:
    """The domain stays."""
    return F.concat(F.lit("***@"), F.split_part(c, F.lit("@"), F.lit(2)))


def total(c: str | Column, name: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(TOTAL).alias(name)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole as a rounded double; null where whole is 0 or null."""
    return F.round(F.try_divide(100.0 * part.cast("double"), whole.cast("double")), digits)


def seconds_between(start: str, end: str) -> Column:
    """Whole seconds; also between timestamps without a time zone."""
    return F.timestamp_diff("SECOND", F.col(start), F.col(end))


def all_or(column: str, value: str) -> Column:
    """A filter that the value 'all' switches off."""
    return F.lit(value == "all") | (F.col(column) == value)
