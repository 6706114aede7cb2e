"""Head-to-head totals, one row per direction of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import labels
from courtside.functions.numbers import share
from courtside.operators.dedup import keep_one


def oriented_matches(matches: DataFrame) -> DataFrame:
    """Lower key first, with the win flag of each side.

    Written with comparisons, not least/greatest: a null side takes the other branch.
    """
    first, second = F.col("first_player_key"), F.col("second_player_key")
    first_won = F.when(F.col("event_winner") == "First Player", 1).otherwise(0)
    second_won = F.when(F.col("event_winner") == "Second Player", 1).otherwise(0)
    kept = matches.filter(labels.not_exhibition(F.col("event_type_type")))
    return kept.select(
        F.when(first < second, first).otherwise(second).alias("low_key"),
        F.when(first < second, first_won).otherwise(second_won).alias("low_won"),
        F.when(first > second, first).otherwise(second).alias("high_key"),
        F.when(first > second, first_won).otherwise(second_won).alias("high_won"),
    )


def _direction(key: str, wins: str, other_key: str, other_wins: str) -> Column:
    return F.struct(
        F.col(key).alias("first_player_key"), F.col(wins).alias("total_first_player_key"),
        F.col(other_key).alias("second_player_key"), F.col(other_wins).alias("total_second_player_key"),
    )


def h2h_pairs(matches: DataFrame, dedup: bool = False) -> DataFrame:
    """Totals and shares for both directions of every pair.

    A pair pulled in both directions repeats its matches and doubles the totals;
    ``dedup=True`` counts every event once. One aggregation serves both directions.
    """
    if dedup:
        ties = ["first_player_key", "second_player_key", "event_winner", "event_type_type"]
        matches = keep_one(matches, ["event_key"], "download_time", ties)
    totals = oriented_matches(matches).groupBy("low_key", "high_key").agg(
        F.sum("low_won").alias("low_wins"), F.sum("high_won").alias("high_wins")
    )
    both = F.array(
        _direction("low_key", "low_wins", "high_key", "high_wins"),
        _direction("high_key", "high_wins", "low_key", "low_wins"),
    )
    won, lost = F.col("total_first_player_key"), F.col("total_second_player_key")
    return totals.select(F.inline(both)).select(
        "*", share(won, lost, 4).alias("p1_perc_h2h"), share(lost, won, 4).alias("p2_perc_h2h")
    )
