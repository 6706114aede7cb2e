"""Player universe, pairs to look up, and one row per player of a match."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions import labels
from courtside.operators.dedup import keep_one
from courtside.operators.skew import shard


def player_universe(fixtures: DataFrame) -> DataFrame:
    """Distinct players on either side of the fixtures (a null key stays a value)."""
    both = F.array("first_player_key", "second_player_key")
    listed = fixtures.select(F.explode(both).alias("player_id"))
    return listed.select("player_id", shard("player_id")).distinct().select("player_id")


def player_pairs(fixtures: DataFrame) -> DataFrame:
    """Distinct ordered pairs to look up; pairs with a null side are left out."""
    return fixtures.select("first_player_key", "second_player_key").dropna().distinct()


def countable_matches(
    results: DataFrame, players: DataFrame, as_of: dt.date, days: int = 365, keep: str = "first"
) -> DataFrame:
    """Finished, non-exhibition matches of the trailing window with a player of the
    universe, one download per event.

    The filters and the membership test run before the dedup on purpose: the earliest
    row is chosen among those that pass. Membership is carried as one flag per side, so
    the player join is not needed again afterwards; a player listed twice does no harm,
    as the dedup removes the repeats. Spark broadcasts the universe when its size allows and
    sort-merges it otherwise, where hot players are split.
    """
    recent = results.filter(
        labels.within_trailing_days(labels.match_day(results), as_of, days)
        & labels.is_finished(F.col("event_status"))
        & labels.not_exhibition(F.col("event_type_type"))
    ).select(
        "event_key", "download_time", "first_player_key", "second_player_key",
        "event_winner", "tournament_key",
    )
    return first_downloads(recent, players, keep)


def first_downloads(matches: DataFrame, players: DataFrame, keep: str = "first") -> DataFrame:
    """One download per event among those with a player of the universe."""
    known = players.select("player_id").dropna()
    first = known.select(F.col("player_id").alias("first_player_key"), F.lit(True).alias("first_known"))
    second = known.select(F.col("player_id").alias("second_player_key"), F.lit(True).alias("second_known"))
    member = (
        matches.join(first, "first_player_key", "left")
        .join(second, "second_player_key", "left")
        .filter(F.col("first_known") | F.col("second_known"))
    )
    ties = ["first_player_key", "second_player_key", "event_winner", "tournament_key"]
    return keep_one(member, ["event_key"], "download_time", ties, keep)


def player_match_rows(matches: DataFrame, *more: str) -> DataFrame:
    """One row per universe player of a counted match, with ``more`` columns of it; a match of
    a player with themselves gives one row."""
    first, second = F.col("first_player_key"), F.col("second_player_key")
    sides = F.array_distinct(
        F.array_compact(F.array(F.when(F.col("first_known"), first), F.when(F.col("second_known"), second)))
    )
    rows = matches.select(
        "event_key", "first_player_key", "second_player_key", "event_winner", "tournament_key", *more,
        F.explode(sides).alias("player_id"),
    )
    return rows.select(
        "player_id", "event_key", "first_player_key", "second_player_key", "event_winner", "tournament_key",
        labels.player_position(F.col("player_id"), first, second).alias("player_position"),
        labels.winner_key(F.col("event_winner"), first, second).alias("winner_key"), *more,
    )
