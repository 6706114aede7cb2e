"""Display text. Numbers are rounded as doubles, half-even on their binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtside.functions.labels import lenient_day
from courtside.functions.numbers import to_number

NULL_MARK = "-"


def _spanish(number: Column, digits: int = 2) -> Column:
    return F.translate(F.format_number(number, digits), ",.", ".,")


def _or_as_it_was(formatted: Column, value: Column) -> Column:
    return F.coalesce(formatted, value.cast("string"))


def spanish_number(value: Column) -> Column:
    """1234.5 -> ``1.234,50``; what is no number stays as it was."""
    return _or_as_it_was(_spanish(to_number(value)), value)


def spanish_percent(value: Column) -> Column:
    """0.2857 -> ``28,57%``; what is no number stays as it was."""
    return _or_as_it_was(F.concat(_spanish(to_number(value) * 100), F.lit("%")), value)


def spanish_date(value: Column) -> Column:
    """``dd/MM/yyyy``; what is no date stays as it was."""
    return _or_as_it_was(F.date_format(lenient_day(value.cast("string")), "dd/MM/yyyy"), value)


def percent_or_mark(value: Column) -> Column:
    """Spanish percent for a copied row, ``-`` when it is no number."""
    return F.coalesce(F.concat(_spanish(to_number(value) * 100), F.lit("%")), F.lit(NULL_MARK))


def odds_or_mark(value: Column) -> Column:
    """Two digits, comma, no thousands separator; ``-`` when it is no number."""
    return F.coalesce(F.translate(F.format_number(to_number(value), 2), ".,", ","), F.lit(NULL_MARK))


def short_percent(value: Column) -> Column:
    """0.2857 -> ``28.6%``; ``-`` when it is no number."""
    tenths = F.translate(F.format_number(to_number(value) * 100, 1), ",", "")
    return F.coalesce(F.concat(tenths, F.lit("%")), F.lit(NULL_MARK))


def fixed_or_mark(number: Column, suffix: str = "") -> Column:
    """A floating-point value with two digits and a suffix; ``-`` when null."""
    text = F.translate(F.format_number(number.cast("double"), 2), ",", "")
    return F.coalesce(F.concat(text, F.lit(suffix)), F.lit(NULL_MARK))


def text_or_mark(value: Column, suffix: str = "") -> Column:
    """Any other value as it is, with a suffix; ``-`` when null."""
    return F.coalesce(F.concat(value.cast("string"), F.lit(suffix)), F.lit(NULL_MARK))
