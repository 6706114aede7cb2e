"""When to refresh, and which days to load. The clock is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REFRESH_HOUR_UTC = 8

# Days relative to the run day, (first, last).
FIXTURE_DAYS = (-1, 2)
MANUAL_HISTORY_DAYS = (-2, -1)
ODDS_DAYS = (-1, 5)


def days_from(as_of: dt.date, span: tuple[int, int]) -> tuple[dt.date, dt.date]:
    return as_of + dt.timedelta(days=span[0]), as_of + dt.timedelta(days=span[1])


def load_ranges(high_water: DataFrame, as_of: dt.date, utc_hour: int) -> DataFrame:
    """One row: whether to refresh, the days to load per table, and whether dimensions
    are due, from a one-row frame with ``max_event_date``."""
    yesterday = as_of - dt.timedelta(days=1)
    reached = F.col("max_event_date").try_cast("date")
    fixtures, odds = days_from(as_of, FIXTURE_DAYS), days_from(as_of, ODDS_DAYS)
    return high_water.select(
        (F.lit(utc_hour >= REFRESH_HOUR_UTC) & (reached.isNull() | (reached < F.lit(yesterday)))).alias("needs_refresh"),
        F.coalesce(reached, F.lit(yesterday)).alias("history_start"),
        F.lit(yesterday).alias("history_stop"),
        F.lit(fixtures[0]).alias("fixtures_start"), F.lit(fixtures[1]).alias("fixtures_stop"),
        F.lit(odds[0]).alias("odds_start"), F.lit(odds[1]).alias("odds_stop"),
        F.lit(as_of.weekday() == 0).alias("refresh_dimensions"),
    )
