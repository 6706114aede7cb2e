"""Filters and projections over the per-match table and the analysis.

Columns a table lacks are skipped, as the filters are shared by several tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import labels

ALL = "All"

# Column lists of the views.
REQUIRED_COLUMNS = ["event_type", "event_status", "tournament_name", "tournament_sourface"]
TABLE_COLUMNS = [
    "event_date", "event_time", "event_status", "event_winner", "event_first_player", "event_second_player",
    "tournament_sourface", "tournament_name", "event_type_3",
    "p1_wins_h2h", "p1_perc_h2h", "p2_wins_h2h", "p2_perc_h2h",
    "p1_rend_all", "p1_rend_sup", "p1_points", "p2_rend_all", "p2_rend_sup", "p2_points",
    "p1_odds", "p2_odds",
]
ROW_COLUMNS = [
    "tournament_name", "event_date", "event_first_player", "event_second_player", "tournament_sourface",
    "p1_wins_h2h", "p1_perc_h2h", "p2_wins_h2h", "p2_perc_h2h",
    "p1_rend_all", "p1_rend_sup", "p1_points", "p2_rend_all", "p2_rend_sup", "p2_points",
]
SUMMARY_COLUMNS = [
    "tournament_name", "event_date", "event_time", "event_first_player", "event_second_player", "event_winner",
    "tournament_sourface", "jugador_a_apostar_vb", "jugador_a_apostar_cons",
    "monto_apuesta_vb", "monto_apuesta_cons", "p1_odds", "p2_odds", "result_bet", "flag_low_bet_value",
]
FILTER_COLUMNS = [
    "event_type", "event_status", "event_date_only", "event_gender", "tournament_name", "tournament_sourface",
]


def require_columns(df: DataFrame, columns: Sequence[str] = tuple(REQUIRED_COLUMNS)) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return df


def with_event_day(df: DataFrame) -> DataFrame:
    """Adds the lenient day of the date text, when there is one."""
    if "event_date" not in df.columns:
        return df
    return df.withColumn("event_date_only", labels.lenient_day(F.col("event_date")))


def filter_in(df: DataFrame, **chosen: Sequence) -> DataFrame:
    """All given lists must match; an empty list filters nothing."""
    for column, values in chosen.items():
        if column not in FILTER_COLUMNS:
            raise ValueError(f"no filter on {column}")
        if values:
            df = df.filter(F.col(column).isin(list(values)))
    return df


def filter_equals(df: DataFrame, column: str, value: object) -> DataFrame:
    return df if column not in df.columns or value == ALL else df.filter(F.col(column) == F.lit(value))


def flag_mask(df: DataFrame, choice: str) -> Column:
    """Low (flag 1), Ok (flag 0) or All; a null flag is in neither of the first two."""
    wanted = {"Low": 1, "Ok": 0}.get(choice)
    if wanted is None or "flag_low_bet_value" not in df.columns:
        return F.lit(True)
    return labels.flag_to_binary(F.col("flag_low_bet_value")) == wanted


def filter_flag(df: DataFrame, choice: str) -> DataFrame:
    return df.filter(flag_mask(df, choice))


def bets_mask(df: DataFrame, choice: str) -> Column:
    """"Con apuesta": a pick in either model; "Sin apuesta": in none; else all rows.
    A null pick counts as a bet here."""
    picks = [c for c in ("jugador_a_apostar_cons", "jugador_a_apostar_vb") if c in df.columns]
    without = F.lit(True)
    for pick in picks:
        without = without & F.col(pick).eqNullSafe(labels.NO_BET)
    if choice == "Con apuesta":
        return ~without if picks else F.lit(False)
    return without if choice == "Sin apuesta" else F.lit(True)


def filter_bets(df: DataFrame, choice: str) -> DataFrame:
    return df.filter(bets_mask(df, choice))


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def row_columns(df: DataFrame, with_odds: bool = False) -> list[str]:
    """Columns of a copied row, with the odds right after the second player's points."""
    columns = present(df, ROW_COLUMNS)
    if with_odds:
        at = columns.index("p2_points") + 1 if "p2_points" in columns else 0
        columns[at:at] = present(df, ["p1_odds", "p2_odds"])
    return columns


def summary_table(df: DataFrame) -> DataFrame:
    """The summary's columns as far as the table has them; the flag as true or false, where
    null and unknown values are false."""
    shown = df.select(*present(df, SUMMARY_COLUMNS))
    if "flag_low_bet_value" not in shown.columns:
        return shown
    low = labels.flag_to_binary(F.col("flag_low_bet_value")) == 1
    return shown.withColumn("flag_low_bet_value", F.coalesce(low, F.lit(False)))


def filter_analysis(df: DataFrame, event_day=ALL, event_type: str = ALL, event_status: str = ALL,
                    flag: str = ALL, bets: str = "Con apuesta", tournaments: Sequence[str] = ()) -> DataFrame:
    """The analysis view's whole filter chain."""
    df = filter_equals(with_event_day(df), "event_date_only", event_day)
    df = filter_equals(df, "event_type", event_type)
    df = filter_equals(df, "event_status", event_status)
    df = filter_bets(filter_flag(df, flag), bets)
    return filter_in(df, tournament_name=tournaments) if "tournament_name" in df.columns else df
