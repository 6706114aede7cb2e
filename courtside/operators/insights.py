"""KPIs, grouped counts, gaps and short lists over the per-match table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import formats, numbers
from courtside.operators import filters


def kpi_summary(matches: DataFrame) -> DataFrame:
    """One row: matches, days, tournaments and surfaces (nulls not counted), last load."""
    df = filters.with_event_day(matches)
    return df.agg(
        F.count(F.lit(1)).alias("fixtures"),
        F.count_distinct("event_date_only").alias("days"),
        F.count_distinct("tournament_name").alias("tournaments"),
        F.count_distinct("tournament_sourface").alias("surfaces"),
        F.max("load_timestamp").alias("last_refresh"),
    )


def fixture_counts(matches: DataFrame, *columns: str) -> DataFrame:
    """Matches per group; a null is a group of its own."""
    return matches.groupBy(*columns).agg(F.count(F.lit(1)).alias("fixtures"))


def counts_by_day_and_status(matches: DataFrame) -> DataFrame:
    counts = fixture_counts(filters.with_event_day(matches), "event_date_only", "event_status")
    return counts.orderBy(F.asc_nulls_last("event_date_only"), F.asc_nulls_last("event_status"))


def top_tournaments(matches: DataFrame, n: int = 12) -> DataFrame:
    """Tournaments with most matches; equal counts go by name."""
    counts = fixture_counts(matches, "tournament_name")
    return counts.orderBy(F.desc("fixtures"), F.asc_nulls_last("tournament_name")).limit(n)


def with_gaps(matches: DataFrame) -> DataFrame:
    """Absolute differences of points and odds, and the first as a plot size."""
    added: dict[str, Column] = {}
    if {"p1_points", "p2_points"} <= set(matches.columns):
        added["points_gap"] = numbers.gap(F.col("p1_points"), F.col("p2_points"))
        added["points_gap_plot"] = numbers.plot_size(added["points_gap"])
    if {"p1_odds", "p2_odds"} <= set(matches.columns):
        added["odds_gap"] = numbers.gap(F.col("p1_odds"), F.col("p2_odds"))
    return matches.withColumns(added) if added else matches


def start_time(matches: DataFrame) -> Column:
    """Date and time texts as a timestamp; null when either cannot be read."""
    return F.concat(filters.labels.lenient_day(F.col("event_date")).cast("string"), F.lit(" "), "event_time").try_cast(
        "timestamp_ntz"
    )


def with_start(matches: DataFrame) -> DataFrame:
    return matches.withColumn("start_time", start_time(matches))


def first_by_start(timed: DataFrame, n: int | None) -> DataFrame:
    keys = filters.present(timed, ["start_time", "event_key", "first_player_key", "second_player_key"])
    ordered = timed.orderBy(*[F.asc_nulls_last(c) for c in keys])
    return ordered if n is None else ordered.limit(n)


def any_start(timed: DataFrame) -> bool:
    """Asked of the data; stops at the first readable start time."""
    return not timed.filter(F.col("start_time").isNotNull()).isEmpty()


def upcoming(matches: DataFrame, n: int | None = 10) -> DataFrame:
    """Matches by start time, unreadable last, the first ``n`` of them (``None``: all).

    Should no start time be readable, the rows come unsorted and whole. That is asked
    of the data first; the question stops at the first readable row, so the matches should
    be cheap to compute: labelled fixtures, not the mart.
    """
    timed = with_start(matches)
    return first_by_start(timed, n) if any_start(timed) else timed


def not_started(matches: DataFrame) -> DataFrame:
    """The default list: men's singles that have not started."""
    return filters.filter_in(matches, event_type=["Singles"], event_status=["Not yet started"], event_gender=["Men"])


def next_matches(mart: DataFrame, n: int = 10) -> DataFrame:
    return upcoming(not_started(mart), n)


def first_present(df: DataFrame, candidates: Sequence[str]) -> Column:
    """First non-null of the candidate columns the table has."""
    found = filters.present(df, candidates)
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def upcoming_lines(matches: DataFrame) -> DataFrame:
    """Display texts of the upcoming list: headline, head-to-head and standings per side."""
    day = F.coalesce(filters.labels.lenient_day(F.col("event_date")).cast("string"), F.lit(formats.NULL_MARK))
    tail = F.coalesce(F.concat(F.lit(" | "), "tournament_name"), F.lit(""))
    shown = {"headline": F.concat(day, F.coalesce(F.concat(F.lit(" "), "event_time"), F.lit("")), tail)}
    for side in ("p1", "p2"):
        rank = first_present(matches, [f"{side}_{c}" for c in ("rank", "ranking", "position", "points")])
        shown[f"{side}_h2h_wins"] = formats.text_or_mark(F.col(f"{side}_wins_h2h"))
        shown[f"{side}_h2h_share"] = formats.short_percent(F.col(f"{side}_perc_h2h"))
        shown[f"{side}_standing"] = formats.text_or_mark(rank)
    return matches.withColumns(shown)
