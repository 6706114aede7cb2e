"""Win/loss records per player."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import labels


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def player_totals(player_rows: DataFrame, *more: str) -> DataFrame:
    """Counts per player and tournament (and ``more`` columns). Both records are sums of these, so the dedup
    and the big aggregation happen once and the plan reuses their exchange."""
    won = F.col("winner_key") == F.col("player_id")
    return player_rows.groupBy("player_id", "tournament_key", *more).agg(
        F.count(F.lit(1)).alias("games"),
        _count_if(won).alias("wins"),
        _count_if(~won).alias("losses"),
        _count_if(F.col("winner_key").isNull()).alias("other"),
    )


def _sums(suffix: str) -> list[Column]:
    names = {
        "games": f"total_games_{suffix}", "wins": f"wins_{suffix}",
        "losses": f"losses_{suffix}", "other": f"draws_or_other_{suffix}",
    }
    return [F.sum(source).alias(name) for source, name in names.items()]


def tournament_surfaces(tournaments: DataFrame) -> DataFrame:
    """Normalised surface per tournament. A repeated key stays repeated and multiplies
    the rows it joins, as in a plain join."""
    return tournaments.select(
        "tournament_key", labels.surface_label(F.col("tournament_sourface")).alias("tournament_sourface")
    )


def records_by_surface(totals: DataFrame, tournaments: DataFrame, as_of: dt.date) -> DataFrame:
    surface = F.coalesce("tournament_sourface", F.lit(labels.UNKNOWN)).alias("tournament_sourface")
    return (
        totals.join(tournament_surfaces(tournaments), "tournament_key", "left")
        .groupBy("player_id", surface)
        .agg(*_sums("sourface"))
        .select(F.lit(as_of).alias("run_date"), "*")
    )


def records_all(totals: DataFrame, as_of: dt.date) -> DataFrame:
    return totals.groupBy("player_id").agg(*_sums("all")).select(F.lit(as_of).alias("run_date"), "*")
