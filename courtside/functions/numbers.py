"""Coercions, guarded ratios and gaps."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtside.schemas import ODDS

# A plain decimal literal: a cast alone would also take forms such as "1d".
_NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_id(text: Column) -> Column:
    """Whole number from feed text, ``'2382.0'`` included; anything else is null."""
    # Most texts are plain: only the others pay for decimals.
    plain = F.when(text.rlike(r"^[+-]?[0-9]+\.0*$"), F.substring_index(text, ".", 1).try_cast("bigint"))
    number = text.try_cast("decimal(38,6)")
    whole = F.when(number == F.floor(number), number.try_cast("bigint"))
    return F.coalesce(text.try_cast("bigint"), plain, whole)


def to_odds(text: Column) -> Column:
    """A price from feed text; what is no number is null. A number that the table would cut
    or overflow fails the load."""
    plain = text.rlike(r"^[0-9]{1,14}(\.[0-9]{1,10})?$")  # fits whatever its digits
    exact = text.try_cast("decimal(38,18)")
    stored = text.try_cast(ODDS)
    fits = F.coalesce(exact == stored, F.lit(False))
    refuse = F.raise_error(F.concat(F.lit("price does not fit: "), text)).cast(ODDS)
    return F.when(plain, stored).when(fits, stored).when(F.trim(text).rlike(_NUMERIC_TEXT), refuse)


def to_number(value: Column) -> Column:
    """Lenient number for the dashboard; bad is null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(_NUMERIC_TEXT), text.try_cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def share(part: Column, rest: Column, digits: int) -> Column:
    """part / (part + rest) of two counts, rounded half-up; null when the sum is 0.

    Exact: the last digit is found in whole numbers, which is also much faster than a
    decimal division.
    """
    whole = F.nullif(part + rest, F.lit(0))
    units = F.call_function("div", part * (2 * 10**digits) + whole, whole * 2)
    return (units.cast("decimal(9,0)") * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal({digits + 1},{digits})")


def gap(left: Column, right: Column) -> Column:
    return F.abs(to_number(left) - to_number(right))


def plot_size(value: Column) -> Column:
    """Never null, never negative."""
    return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))
