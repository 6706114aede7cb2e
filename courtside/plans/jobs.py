"""Jobs composed of operators: from source tables to finished tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.operators import h2h, insights, mart, odds, players, records


@dataclass(frozen=True)
class MatchTables:
    """The source tables of a run."""

    results: DataFrame
    fixtures: DataFrame
    h2h: DataFrame
    tournaments: DataFrame
    standings: DataFrame
    odds: DataFrame


def player_totals(tables: MatchTables, as_of: dt.date, days: int = 365, keep: str = "first") -> DataFrame:
    universe = players.player_universe(tables.fixtures)
    matches = players.countable_matches(tables.results, universe, as_of, days, keep)
    return records.player_totals(players.player_match_rows(matches))


def player_records(tables: MatchTables, as_of: dt.date, days: int = 365, keep: str = "first") -> tuple[DataFrame, DataFrame]:
    """Records by surface and overall."""
    totals = player_totals(tables, as_of, days, keep)
    return records.records_by_surface(totals, tables.tournaments, as_of), records.records_all(totals, as_of)


def event_odds(tables: MatchTables) -> DataFrame:
    """Consensus odds per event."""
    return odds.odds_consensus(odds.odds_pivot(tables.odds))


def build_mart(tables: MatchTables, by_surface: DataFrame, overall: DataFrame, pairs: DataFrame,
               loaded_at: Column | None = None, default_logo: str = mart.DEFAULT_LOGO) -> DataFrame:
    return mart.match_mart(
        tables.fixtures, tables.tournaments, by_surface, overall, tables.standings, pairs, event_odds(tables),
        loaded_at, default_logo,
    )


def full_mart(tables: MatchTables, as_of: dt.date, loaded_at: Column | None = None) -> DataFrame:
    """The per-match table straight from the sources, in one plan."""
    by_surface, overall = player_records(tables, as_of)
    return build_mart(tables, by_surface, overall, h2h.h2h_pairs(tables.h2h), loaded_at)


def next_matches(tables: MatchTables, as_of: dt.date, n: int = 10, loaded_at: Column | None = None) -> DataFrame:
    """The rows of the mart for the next matches. They are chosen among the labelled
    fixtures, which need the tournaments only; records and mart are then built for these
    alone, so the joins meet a handful of fixtures and players. Left joins repeat rows at
    most, so sorting and cutting once more gives what sorting the whole mart would."""
    timed = insights.with_start(insights.not_started(mart.match_labels(tables.fixtures, tables.tournaments)))
    if not insights.any_start(timed):
        return insights.with_start(insights.not_started(full_mart(tables, as_of, loaded_at)))
    chosen = insights.first_by_start(timed, n).select("event_key", "first_player_key", "second_player_key").distinct()
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in chosen.columns]
    few = replace(tables, fixtures=tables.fixtures.alias("f").join(chosen.alias("c"), same[0] & same[1] & same[2], "left_semi"))
    return insights.first_by_start(insights.with_start(insights.not_started(full_mart(few, as_of, loaded_at))), n)
