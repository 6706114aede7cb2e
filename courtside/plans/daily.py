"""The daily run: load what has landed, then rebuild records, head-to-head and mart.

Stages meet in stored tables, so each one plans with the real sizes of its inputs and
a lost executor costs its tasks, not the run.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from courtside import schemas
from courtside.operators import constants, h2h, history, players, records
from courtside.plans import jobs, rolling
from courtside.sources import landed, tables
from courtside.streaming import incremental


@dataclass(frozen=True)
class Step:
    name: str
    ok: bool
    rows: int | None = None
    message: str = ""
    skipped: int = 0


def attempt(name: str, work: Callable[[], int | tuple[int, int] | None]) -> Step:
    """Runs a step, which returns its rows, or rows and what was skipped. A failure is
    reported and does not stop the steps after it."""
    try:
        done = work()
        rows, skipped = done if isinstance(done, tuple) else (done, 0)
        return Step(name, True, rows, skipped=skipped)
    except Exception as error:  # the report carries it
        return Step(name, False, message=f"{type(error).__name__}: {error}")


class Warehouse:
    """Where the tables of a run live under one root."""

    SNAPSHOTS = {
        "fixtures_for_today": schemas.FIXTURES_FOR_TODAY,
        "h2h_for_today2": schemas.H2H_FOR_TODAY,
        "tournaments": schemas.TOURNAMENTS,
        "standings": schemas.STANDINGS,
        "odds_for_today": schemas.ODDS_FOR_TODAY,
        "stg_players_results_by_sourface": schemas.RECORDS_BY_SURFACE,
        "stg_players_results_all": schemas.RECORDS_ALL,
        "stg_h2h_for_today_processed": None,
        "main_todays_games_details": None,
        "main_todays_analysis": None,
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def snapshot(self, name: str) -> tables.VersionedTable:
        return tables.VersionedTable(self.spark, self.path(name), self.SNAPSHOTS[name])

    def results(self) -> DataFrame:
        return tables.read_days(self.spark, self.path("fixtures_results"), schemas.FIXTURES_RESULTS)

    def rolled_totals(self, as_of: dt.date) -> DataFrame:
        """Counts per player and tournament, from sums that are kept per day: only days of the
        history that are new or were replaced since the last run are read."""
        path = self.path("fixtures_results")
        kept = rolling.RolledRecords(self.spark, self.path("player_sums"))
        changed, source = tables.changed_days(self.spark, path, kept.state().source)
        kept.advance(self.results(), changed, as_of, source)
        return kept.player_totals(players.player_universe(self.snapshot("fixtures_for_today").read()))

    def high_water(self) -> DataFrame:
        return tables.high_water(self.spark, self.path("fixtures_results"), schemas.FIXTURES_RESULTS)

    def bet_history(self, schema) -> DataFrame:
        """The kept bets, with the columns of the analysis they came from."""
        return tables.read_days(self.spark, self.path("full_analysis_hist"), schema)

    def constants(self) -> DataFrame:
        """The log of constants, all profiles and times."""
        return tables.read_or_empty(self.spark, self.path("constants_main"), schemas.CONSTANTS)

    def append_constants(self, values: dict, at: dt.datetime | None = None) -> int:
        """Adds one row to the log."""
        return tables.append_rows(constants.constants_row(self.spark, values, at), self.path("constants_main"))

    def sources(self) -> jobs.MatchTables:
        read = lambda name: self.snapshot(name).read()
        return jobs.MatchTables(
            results=self.results(), fixtures=read("fixtures_for_today"), h2h=read("h2h_for_today2"),
            tournaments=read("tournaments"), standings=read("standings"), odds=read("odds_for_today"),
        )


def _stored(schema, rows: DataFrame, at: dt.datetime | None) -> DataFrame:
    stamped = landed.with_download_time(rows, tables.default_now(at))
    return stamped.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def load_results(house: Warehouse, rows: DataFrame, start: dt.date, stop: dt.date, at=None) -> int:
    """Replaces the days of the history that were asked for."""
    stored = _stored(schemas.FIXTURES_RESULTS, rows, at)
    return tables.replace_days(house.spark, house.path("fixtures_results"), stored, start, stop)


def load_snapshot(house: Warehouse, name: str, rows: DataFrame, at=None) -> int:
    """Full replace of a table; an empty pull leaves the old rows."""
    return house.snapshot(name).replace(_stored(house.SNAPSHOTS[name], rows, at), keep_if_empty=True)


def refresh_tables(house: Warehouse, as_of: dt.date, at: dt.datetime | None = None, rolled: bool = False) -> list[Step]:
    """Records, head-to-head, mart, in this order. ``rolled`` takes the records from sums kept
    per day; the rows are the same. The sources do not change in between, so they are opened
    (a history has a folder for every day) once."""
    sources = functools.cache(house.sources)

    def build_records() -> int:
        totals = house.rolled_totals(as_of) if rolled else jobs.player_totals(sources(), as_of)
        # Small, and summed twice by player: dealt by player, neither sum moves them again.
        totals = totals.repartition("player_id").persist()
        try:
            by_surface = records.records_by_surface(totals, sources().tournaments, as_of)
            rows = house.snapshot("stg_players_results_by_sourface").replace(by_surface)
            return rows + house.snapshot("stg_players_results_all").replace(records.records_all(totals, as_of))
        finally:
            totals.unpersist()

    def build_h2h() -> int:
        pairs = h2h.h2h_pairs(sources().h2h)
        return house.snapshot("stg_h2h_for_today_processed").replace(pairs)

    def build_mart() -> int:
        stored = {n: house.snapshot(n).read() for n in (
            "stg_players_results_by_sourface", "stg_players_results_all", "stg_h2h_for_today_processed")}
        wide = jobs.build_mart(
            sources(), stored["stg_players_results_by_sourface"], stored["stg_players_results_all"],
            stored["stg_h2h_for_today_processed"], tables.default_now(at),
        )
        return house.snapshot("main_todays_games_details").replace(wide)

    return [attempt("records", build_records), attempt("h2h", build_h2h), attempt("mart", build_mart)]


class Landing:
    """Landed responses, ``<root>/<table>/run_date=<day>/...``: only the pull of the run
    day is read. Standings lie one level deeper, by ``event_type=``."""

    def __init__(self, spark: SparkSession, root: str, run_date: dt.date, multiline: bool = False):
        self.spark, self.root, self.run_date, self.multiline = spark, root.rstrip("/"), run_date, multiline

    def read(self, table: str, on_bad: str = "fail") -> DataFrame:
        return landed.read_landed(self.spark, f"{self.root}/{table}/run_date={self.run_date}", self.multiline, on_bad)


def load_table(house: Warehouse, pulls: Landing, name: str, history: tuple[dt.date, dt.date],
               odds_start: dt.date, at: dt.datetime | None = None) -> int | tuple[int, int]:
    """Loads one source table from its landed pull. Of head-to-head pulls the pairs that
    cannot be used are skipped and counted; any other odd response fails the load."""
    # A large response is parsed by one task, its rows are written by many.
    spread = lambda rows: rows.hint("rebalance")
    if name == "h2h_for_today2":
        pull, seen = pulls.read(name, on_bad="skip"), Observation()
        pull = pull.observe(seen, F.count_if(landed.bad_pair(pull)).alias("skipped"))
        return load_snapshot(house, name, spread(landed.flatten_h2h(pull, on_bad="skip")), at), seen.get["skipped"]
    pull = pulls.read(name)
    if name == "fixtures_results":
        return load_results(house, landed.flatten_matches(pull), *history, at)
    flatten = {
        "fixtures_for_today": lambda: landed.flatten_matches(pull, logos=True),
        "odds_for_today": lambda: landed.flatten_odds(pull, F.lit(odds_start)),
        "tournaments": lambda: landed.flatten_tournaments(pull),
        "standings": lambda: landed.flatten_standings(pull),
    }
    return load_snapshot(house, name, spread(flatten[name]()), at)


DAILY_TABLES = ["fixtures_results", "fixtures_for_today", "h2h_for_today2", "odds_for_today"]
DIMENSIONS = ["tournaments", "standings"]


def run_daily(house: Warehouse, pulls: Landing, utc_hour: int, at: dt.datetime | None = None, rolled: bool = False) -> list[Step]:
    """The automatic refresh; does nothing when the data is up to date. Tournaments and
    standings are loaded on Mondays."""
    as_of = pulls.run_date
    due = incremental.load_ranges(house.high_water(), as_of, utc_hour).first()
    if not due.needs_refresh:
        return []
    history = (due.history_start, due.history_stop)
    names = DAILY_TABLES + (DIMENSIONS if due.refresh_dimensions else [])
    steps = [attempt(n, lambda n=n: load_table(house, pulls, n, history, due.odds_start, at)) for n in names]
    return steps + refresh_tables(house, as_of, at, rolled)


def run_manual(house: Warehouse, pulls: Landing, names: tuple[str, ...] = ("fixtures_for_today",),
               at: dt.datetime | None = None) -> list[Step]:
    """A refresh on demand of the chosen tables; history covers its two last days."""
    as_of = pulls.run_date
    history = incremental.days_from(as_of, incremental.MANUAL_HISTORY_DAYS)
    odds_start, _ = incremental.days_from(as_of, incremental.ODDS_DAYS)
    steps = [attempt(n, lambda n=n: load_table(house, pulls, n, history, odds_start, at)) for n in names]
    return steps + refresh_tables(house, as_of, at)


def merge_history_days(spark: SparkSession, path: str, analysis: DataFrame, as_of: dt.date,
                       per_model: bool = False) -> list[dt.date]:
    """Merges the analysis into a history table partitioned by day. Where there is no
    history yet, all bets of the analysis start it, those without a date under the null day.

    Every change falls on a day the analysis holds, so only those partitions are read
    and rewritten. The list of days is bounded by the calendar. Returns them.
    """
    dated = analysis.select(F.to_date("event_date").alias("day")).dropna().distinct()
    days = sorted(row.day for row in dated.collect())
    tables.publish_days(spark, path, analysis.schema)
    if tables.has_days(spark, path):
        stored = tables.read_days(spark, path, analysis.schema)
        touched = stored.filter(F.col(tables.DAY).isin(days)).select(*analysis.columns)
        merged = history.merge_history(touched, analysis, as_of, per_model)
    else:
        merged = history.initial_history(analysis)
    tables.overwrite_days(spark, path, merged, days)
    return days


def run_analysis(house: Warehouse, analysis: DataFrame, as_of: dt.date, per_model: bool = False) -> list[Step]:
    """The analysis run: replaces the stored analysis, then takes the stored rows into the
    bet history (its start, or a merge). The selection of bets itself is an input."""

    def keep() -> int:
        return house.snapshot("main_todays_analysis").replace(analysis)

    def remember() -> int:
        stored = house.snapshot("main_todays_analysis").read()
        return len(merge_history_days(house.spark, house.path("full_analysis_hist"), stored, as_of, per_model))

    steps = [attempt("analysis", keep)]
    return steps + [attempt("history", remember)] if steps[0].ok else steps
