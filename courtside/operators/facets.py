"""Sorted choices of a column, each level seeing only the rows the levels before let through."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.operators import filters


def options(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values, nulls left out."""
    return df.select(column).dropna().distinct().orderBy(column)


def day_options(df: DataFrame) -> DataFrame:
    return options(filters.with_event_day(df), "event_date_only")


def match_facets(df: DataFrame, event_types: Sequence = (), statuses: Sequence = (), days: Sequence = (),
                 genders: Sequence = (), tournaments: Sequence = ()) -> dict[str, DataFrame]:
    """Choices of the per-match view. Days, types and genders come from all rows,
    tournaments from those filters, surfaces from those and the chosen tournaments."""
    df = filters.with_event_day(df)
    first = filters.filter_in(
        df, event_type=event_types, event_status=statuses, event_date_only=days, event_gender=genders
    )
    second = filters.filter_in(first, tournament_name=tournaments)
    return {
        "event_date_only": options(df, "event_date_only"),
        "event_type": options(df, "event_type"),
        "event_gender": options(df, "event_gender"),
        "tournament_name": options(first, "tournament_name"),
        "tournament_sourface": options(second, "tournament_sourface"),
    }


def analysis_facets(df: DataFrame, event_day=filters.ALL, event_type: str = filters.ALL,
                    event_status: str = filters.ALL, flag: str = filters.ALL,
                    bets: str = "Con apuesta") -> dict[str, DataFrame]:
    """Choices of the analysis view, in the order its filters are chained."""
    df = filters.with_event_day(df)
    of_day = filters.filter_equals(df, "event_date_only", event_day)
    of_type = filters.filter_equals(of_day, "event_type", event_type)
    of_status = filters.filter_equals(of_type, "event_status", event_status)
    of_bets = filters.filter_bets(filters.filter_flag(of_status, flag), bets)
    levels = {
        "event_date_only": df, "event_type": of_day, "event_status": of_type, "tournament_name": of_bets,
    }
    return {c: options(frame, c) for c, frame in levels.items() if c in frame.columns}


def _choices(df: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """``facet``, ``choice`` (as text) and ``place`` (within the facet, by value) of all lists.
    ``levels``: for each column whether a row lets its value through.

    One aggregation over the rows: every combination of values once, with the levels that some
    row of it passes. Combined before the shuffle, it leaves little to be unfolded into lists.
    """
    passes = {c: F.max(F.coalesce(mask, F.lit(False))).alias(f"_{c}") for c, mask in levels.items()}
    combos = df.groupBy(*levels).agg(*passes.values())
    entry = lambda c: F.when(F.col(f"_{c}") & F.col(c).isNotNull(), F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("choice")))
    listed = combos.select(F.explode(F.array_compact(F.array(*map(entry, levels)))).alias("x")).select("x.*").distinct()
    # Days are ISO texts here, so text order is their order. A list is short: choices, not rows.
    place = F.row_number().over(Window.partitionBy("facet").orderBy("choice"))
    return listed.withColumn("place", place)


def _in(column: str, values: Sequence) -> Column:
    return F.col(column).isin(list(values)) if values else F.lit(True)


def match_choices(df: DataFrame, event_types: Sequence = (), statuses: Sequence = (), days: Sequence = (),
                  genders: Sequence = (), tournaments: Sequence = ()) -> DataFrame:
    """All lists of ``match_facets`` in one scan of the rows."""
    first = _in("event_type", event_types) & _in("event_status", statuses) & _in("event_date_only", days) & _in("event_gender", genders)
    every = F.lit(True)
    return _choices(filters.with_event_day(df), {
        "event_date_only": every, "event_type": every, "event_gender": every, "tournament_name": first,
        "tournament_sourface": first & _in("tournament_name", tournaments)})


def analysis_choices(df: DataFrame, event_day=filters.ALL, event_type: str = filters.ALL, event_status: str = filters.ALL,
                     flag: str = filters.ALL, bets: str = "Con apuesta") -> DataFrame:
    """All lists of ``analysis_facets`` in one scan of the rows."""
    df = filters.with_event_day(df)
    is_ = lambda c, v: F.lit(True) if v == filters.ALL or c not in df.columns else F.col(c) == F.lit(v)
    of_day = is_("event_date_only", event_day)
    of_type = of_day & is_("event_type", event_type)
    of_status = of_type & is_("event_status", event_status)
    of_bets = of_status & filters.flag_mask(df, flag) & filters.bets_mask(df, bets)
    levels = {"event_date_only": F.lit(True), "event_type": of_day, "event_status": of_type, "tournament_name": of_bets}
    return _choices(df, {c: mask for c, mask in levels.items() if c in df.columns})
