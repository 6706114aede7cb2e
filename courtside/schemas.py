"""Table schemas. All fields are nullable and no key is unique: feeds repeat rows."""

from __future__ import annotations

from pyspark.sql import types as T

ODDS = T.DecimalType(24, 10)  # prices as landed


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _TEXT, _TIME = T.LongType(), T.StringType(), T.TimestampType()

# Names and order of fields, as the feeds send them.
MATCH_FIELDS = [
    "event_key", "event_date", "event_time",
    "event_first_player", "first_player_key", "event_second_player", "second_player_key",
    "event_final_result", "event_game_result", "event_serve", "event_winner", "event_status",
    "event_type_type", "tournament_name", "tournament_key", "tournament_round", "tournament_season",
]
LOGO_FIELDS = ["event_first_player_logo", "event_second_player_logo"]
MATCH_IDS = ["event_key", "first_player_key", "second_player_key", "tournament_key"]

TOURNAMENT_FIELDS = [
    "tournament_key", "tournament_name", "event_type_key", "event_type_type", "tournament_sourface",
]
TOURNAMENT_IDS = ["tournament_key", "event_type_key"]

STANDING_FIELDS = ["place", "player", "player_key", "league", "movement", "country", "points"]
STANDING_IDS = ["player_key"]


def _table(fields: list[str], ids: list[str]) -> T.StructType:
    kinds = {f: _LONG if f in ids else _TEXT for f in fields}
    return _struct(**kinds, download_time=_TIME)


FIXTURES_RESULTS = _table(MATCH_FIELDS, MATCH_IDS)
H2H_FOR_TODAY = FIXTURES_RESULTS
FIXTURES_FOR_TODAY = _table(MATCH_FIELDS[:7] + LOGO_FIELDS + MATCH_FIELDS[7:], MATCH_IDS)
TOURNAMENTS = _table(TOURNAMENT_FIELDS, TOURNAMENT_IDS)
STANDINGS = _table(STANDING_FIELDS + ["event_type"], STANDING_IDS)
ODDS_FOR_TODAY = _struct(
    event_key=_LONG, betting_house=_TEXT, home_odds=ODDS, away_odds=ODDS, event_date=_TEXT,
    download_time=_TIME,
)

RECORDS_BY_SURFACE = _struct(
    run_date=T.DateType(), player_id=_LONG, tournament_sourface=_TEXT, total_games_sourface=_LONG,
    wins_sourface=_LONG, losses_sourface=_LONG, draws_or_other_sourface=_LONG,
)
RECORDS_ALL = _struct(
    run_date=T.DateType(), player_id=_LONG, total_games_all=_LONG,
    wins_all=_LONG, losses_all=_LONG, draws_or_other_all=_LONG,
)

_SHORT, _REAL = T.ShortType(), T.FloatType()
CONSTANTS = _struct(
    nombre_constante=_TEXT, c_01=_SHORT, c_02=_SHORT, c_03=_SHORT, c_04=_SHORT, c_05=_REAL,
    p_01=_REAL, p_02=_REAL, p_03=_REAL, p_04=_REAL, pma_vb=_REAL, pma_cons=_REAL, pm=_SHORT,
    inserted_at=_TIME,
)

# Reading order of the wide per-match table.
MART_COLUMNS = [
    "event_key", "event_date", "event_time", "event_status", "event_winner",
    "event_first_player", "first_player_key", "event_second_player", "second_player_key",
    "tournament_sourface", "tournament_name",
    "event_type", "event_type_2", "event_type_3", "event_type_type", "event_gender",
    "p1_wins_sourface", "p1_losses_sourface", "p1_wins_all", "p1_losses_all",
    "p1_rend_all", "p1_rend_sup", "p1_points",
    "p2_wins_sourface", "p2_losses_sourface", "p2_wins_all", "p2_losses_all",
    "p2_rend_all", "p2_rend_sup", "p2_points",
    "p1_wins_h2h", "p1_perc_h2h", "p2_wins_h2h", "p2_perc_h2h",
    "p1_odds", "p2_odds",
    "event_first_player_logo", "event_second_player_logo", "load_timestamp",
]
