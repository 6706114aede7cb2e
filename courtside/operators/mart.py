"""The wide per-match table."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import labels
from courtside.functions.numbers import share
from courtside.operators.records import tournament_surfaces
from courtside.schemas import MART_COLUMNS

DEFAULT_LOGO = "player_default.jpg"


def with_surface(fixtures: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Fixtures with the normalised surface of their tournament, as columns else raw."""
    surface = F.coalesce("tournament_sourface", F.lit(labels.UNKNOWN)).alias("tournament_sourface")
    joined = fixtures.join(tournament_surfaces(tournaments), "tournament_key", "left")
    return joined.select(
        "event_key", "event_date", "event_time",
        "event_first_player", "first_player_key", "event_second_player", "second_player_key",
        "event_first_player_logo", "event_second_player_logo",
        "event_status", "event_winner", "tournament_name", "event_type_type", surface,
    )


def _label_columns(default_logo: str) -> dict[str, Column]:
    kind = F.col("event_type_type")
    return {
        "event_first_player_logo": F.coalesce("event_first_player_logo", F.lit(default_logo)),
        "event_second_player_logo": F.coalesce("event_second_player_logo", F.lit(default_logo)),
        "event_status": labels.status_label(F.col("event_status")),
        "event_winner": labels.winner_label(F.col("event_winner")),
        "event_type": labels.event_kind(kind),
        "event_type_2": labels.event_subtype(kind),
        "event_type_3": labels.event_family(kind),
        "event_gender": labels.gender_label(kind),
    }


def match_labels(fixtures: DataFrame, tournaments: DataFrame, default_logo: str = DEFAULT_LOGO) -> DataFrame:
    """Cleaned labels of every fixture."""
    return with_surface(fixtures, tournaments).withColumns(_label_columns(default_logo))


def _or_zero(count: Column) -> Column:
    return F.coalesce(count, F.lit(0))


def _or_no_share(value: Column) -> Column:
    return F.coalesce(value, F.lit(Decimal("0.0")))


def player_cards(by_surface: DataFrame, overall: DataFrame, standings: DataFrame) -> DataFrame:
    """Everything the mart needs of a player in one row: overall record, a record per
    surface (one map entry for each court surface played on), ranking points.

    The wide match rows then meet players once per side, by player key alone, instead
    of three times per side. A player listed twice in the standings has two cards and
    doubles their matches, as joining the standings would.
    """
    surfaces = by_surface.groupBy("player_id").agg(
        F.map_from_entries(F.collect_list(F.struct(
            "tournament_sourface", F.struct(F.col("wins_sourface").alias("wins"), F.col("losses_sourface").alias("losses"))
        ))).alias("surfaces")
    )
    records = overall.select("player_id", "wins_all", "losses_all").join(surfaces, "player_id", "left")
    # A standing without a key meets no match; left in, all of them would meet in one task.
    ranked = standings.filter("player_key is not null").select(F.col("player_key").alias("player_id"), "points")
    return records.join(ranked, "player_id", "full")


def _add_player(matches: DataFrame, side: str, key: str, cards: DataFrame) -> DataFrame:
    """Records, win shares and ranking points of one side."""
    on_surface = F.try_element_at("surfaces", "tournament_sourface")
    ws, ls = _or_zero(on_surface["wins"]), _or_zero(on_surface["losses"])
    wa, la = _or_zero(F.col("wins_all")), _or_zero(F.col("losses_all"))
    added = {
        f"{side}_wins_sourface": ws, f"{side}_losses_sourface": ls,
        f"{side}_wins_all": wa, f"{side}_losses_all": la,
        f"{side}_rend_all": _or_no_share(share(wa, la, 3)),
        f"{side}_rend_sup": _or_no_share(share(ws, ls, 3)),
        f"{side}_points": F.coalesce("points", F.lit("0")),
    }
    joined = matches.join(cards.withColumnRenamed("player_id", key), key, "left")
    return joined.select(*matches.columns, *[value.alias(name) for name, value in added.items()])


def match_mart(fixtures: DataFrame, tournaments: DataFrame, by_surface: DataFrame, overall: DataFrame,
               standings: DataFrame, h2h: DataFrame, odds: DataFrame, loaded_at: Column | None = None,
               default_logo: str = DEFAULT_LOGO) -> DataFrame:
    """One row per fixture with labels, both players' records, points, head-to-head and odds.

    ``odds`` comes from ``odds_consensus``. All joins are left equi-joins without hints:
    Spark broadcasts what is small by its own size estimate and merges the rest. Each has
    its own shuffle key, so that a hot player or pair can be split while running. Labels
    are worked out after the joins, which leaves them out of the shuffles.
    """
    cards = player_cards(by_surface, overall, standings)
    wide = _add_player(with_surface(fixtures, tournaments), "p1", "first_player_key", cards)
    wide = _add_player(wide, "p2", "second_player_key", cards)
    wide = wide.join(h2h, ["first_player_key", "second_player_key"], "left").join(odds, "event_key", "left")
    added = {
        **_label_columns(default_logo),
        "p1_wins_h2h": _or_zero(F.col("total_first_player_key")),
        "p1_perc_h2h": _or_no_share(F.col("p1_perc_h2h")),
        "p2_wins_h2h": _or_zero(F.col("total_second_player_key")),
        "p2_perc_h2h": _or_no_share(F.col("p2_perc_h2h")),
        "p1_odds": F.col("home_odds"), "p2_odds": F.col("away_odds"),
        "load_timestamp": F.current_timestamp() if loaded_at is None else loaded_at,
    }
    return wide.select(*[added[c].alias(c) if c in added else c for c in MART_COLUMNS])


#: Last sort keys: few dates and times are distinct, and a sort can only split where keys differ.
TIE_BREAKERS = ["event_key", "first_player_key", "second_player_key"]


def in_reading_order(mart: DataFrame) -> DataFrame:
    return mart.orderBy(*[F.asc_nulls_last(c) for c in ("event_date", "event_time", *TIE_BREAKERS)])
