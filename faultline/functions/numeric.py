"""Numbers that arrive as text, and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = r"^[-+.0-9eE]+$"
_GROUPED = r"(?i)^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$"
_INFINITE = r"(?i)^\+?inf(inity)?$"


def to_double(value: Column) -> Column:
    """Number in a text, null when it is none; "nan" is none as well.

    Plain numbers take one cheap test; the rare forms with digit groups and
    infinity are looked at only when that fails.
    """
    text = F.trim(value.cast("string"))
    return (
        F.when(text.rlike(_PLAIN), text.try_cast("double"))
        .when(text.rlike(_GROUPED), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
        .when(text.rlike(_INFINITE), F.lit(float("inf")))
    )


def positive(value: Column) -> Column:
    """The number when it is above zero, else null."""
    number = to_double(value)
    return F.when(number > 0, number)


def positive_or_zero(value: Column) -> Column:
    return F.coalesce(positive(value), F.lit(0.0))


def positive_whole_or_zero(value: Column) -> Column:
    """Whole part of a positive number, 0 for anything else."""
    whole = F.floor(positive(value)).try_cast("bigint")
    return F.coalesce(whole, F.lit(0).cast("bigint"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is zero or null."""
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)
