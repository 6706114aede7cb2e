"""The registered queries: each takes (spark, sf_dir) and reads the whole given tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside import schemas
from courtside.functions import formats, labels, numbers
from courtside.operators import (
    constants, export, facets, filters, h2h, history, insights, mart, odds, players, ranking,
    records,
)
from courtside.plans import daily, jobs, rolling
from courtside.sources import derived, landed, tables
from courtside.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = derived.AS_OF
_star = derived.StarTables
QUERIES: dict[str, Query] = {}


def _register(query: Query) -> Query:
    def comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Decimals as doubles: the SQL side has no decimal division to compare with.
        df = query(spark, sf_dir)
        exact = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
        return df.withColumns({c: F.col(c).cast("double") for c in exact}) if exact else df

    QUERIES[query.__name__] = comparable
    return query


def _loaded_at() -> Column:
    return F.to_timestamp(F.lit("1998-05-14 09:00:00"))


def _mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.full_mart(_star(spark, sf_dir).match_tables(), AS_OF, _loaded_at())


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label columns only: what the counts and choices read."""
    star = _star(spark, sf_dir)
    return mart.match_labels(star.fixtures, star.tournaments)


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star(spark, sf_dir).analysis


def _countable(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = _star(spark, sf_dir)
    return players.countable_matches(star.results, players.player_universe(star.fixtures), AS_OF)


# Records


@_register
def player_universe(spark, sf_dir):
    return players.player_universe(_star(spark, sf_dir).fixtures)


@_register
def player_pairs(spark, sf_dir):
    return players.player_pairs(_star(spark, sf_dir).fixtures)


@_register
def fixtures_dedup_first(spark, sf_dir):
    return _countable(spark, sf_dir).select(
        "event_key", "first_player_key", "second_player_key", "event_winner", "tournament_key"
    )


@_register
def player_match_rows(spark, sf_dir):
    return players.player_match_rows(_countable(spark, sf_dir))


@_register
def records_by_surface(spark, sf_dir):
    return jobs.player_records(_star(spark, sf_dir).match_tables(), AS_OF)[0]


@_register
def records_all(spark, sf_dir):
    return jobs.player_records(_star(spark, sf_dir).match_tables(), AS_OF)[1]


@_register
def h2h_pairs(spark, sf_dir):
    return h2h.h2h_pairs(_star(spark, sf_dir).h2h)


# Odds and mart


@_register
def odds_pivot(spark, sf_dir):
    return odds.odds_pivot(_star(spark, sf_dir).odds)


@_register
def odds_consensus(spark, sf_dir):
    pivot = odds.odds_pivot(_star(spark, sf_dir).odds)
    return odds.odds_consensus(pivot).select("event_key", "home_odds", "away_odds")


@_register
def fixture_labels(spark, sf_dir):
    return _labelled(spark, sf_dir)


@_register
def match_mart(spark, sf_dir):
    return _mart(spark, sf_dir).drop("load_timestamp")


@_register
def mart_in_order(spark, sf_dir):
    """The rows in order, each with its place within its day."""
    wide = _mart(spark, sf_dir).select("event_date", "event_time", *mart.TIE_BREAKERS, "p1_odds", "p2_odds")
    rows = ranking.in_order(wide, "event_date", ["event_time", *mart.TIE_BREAKERS])
    return rows.select("event_key", "event_date", "event_time", "p1_odds", "p2_odds", "place")


@_register
def mart_filtered(spark, sf_dir):
    chosen = filters.filter_in(
        filters.require_columns(filters.with_event_day(_mart(spark, sf_dir))),
        event_type=["Singles"], event_status=["Finished", "Not yet started"], event_gender=["Men"],
        tournament_sourface=["Hard", "Clay"],
    )
    return chosen.select("event_date_only", *filters.present(chosen, filters.TABLE_COLUMNS))


# Choices, KPIs, counts, short lists


@_register
def facet_days(spark, sf_dir):
    """Each day with its place in the list."""
    days = facets.day_options(_labelled(spark, sf_dir))
    return days.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


@_register
def facet_tournaments(spark, sf_dir):
    chosen = facets.match_facets(_labelled(spark, sf_dir), event_types=["Singles"], genders=["Men"])
    return chosen["tournament_name"]


@_register
def facet_surfaces(spark, sf_dir):
    chosen = facets.match_facets(
        _labelled(spark, sf_dir), event_types=["Singles"], genders=["Men"],
        tournaments=["Tournament#1", "Tournament#2", "Tournament#26"],
    )
    return chosen["tournament_sourface"]


@_register
def analysis_facet_tournaments(spark, sf_dir):
    return facets.analysis_facets(_analysis(spark, sf_dir), flag="Low")["tournament_name"]


@_register
def facet_lists(spark, sf_dir):
    """All choices of the per-match view at once, each with its place in its list."""
    return facets.match_choices(
        _labelled(spark, sf_dir), event_types=["Singles"], genders=["Men"], tournaments=["Tournament#1", "Tournament#2", "Tournament#26"])


@_register
def analysis_facet_lists(spark, sf_dir):
    return facets.analysis_choices(_analysis(spark, sf_dir), event_type="Singles", flag="Low")


@_register
def kpi_summary(spark, sf_dir):
    """Every row has a load time of its own."""
    loaded = F.timestamp_seconds(F.lit(895000000) + F.col("event_key") % 1000)
    rows = _labelled(spark, sf_dir).withColumn("load_timestamp", loaded)
    return insights.kpi_summary(rows).withColumn(
        "last_refresh", F.date_format("last_refresh", "yyyy-MM-dd HH:mm:ss")
    )


@_register
def fixtures_by_day_status(spark, sf_dir):
    """With each row's place in the result: a row per day and status."""
    counts = insights.counts_by_day_and_status(_labelled(spark, sf_dir))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


@_register
def fixtures_by_status(spark, sf_dir):
    return insights.fixture_counts(_labelled(spark, sf_dir), "event_status")


@_register
def fixtures_by_surface(spark, sf_dir):
    return insights.fixture_counts(_labelled(spark, sf_dir), "tournament_sourface")


@_register
def top_tournaments(spark, sf_dir):
    return insights.top_tournaments(_labelled(spark, sf_dir))


@_register
def upcoming_next10(spark, sf_dir):
    shown = ["event_key", "event_date", "event_time", "event_first_player", "event_second_player", "p1_wins_h2h",
             "p1_perc_h2h", "p1_points", "p2_points"]
    return jobs.next_matches(_star(spark, sf_dir).match_tables(), AS_OF, loaded_at=_loaded_at()).select(*shown)


@_register
def upcoming_lines(spark, sf_dir):
    return insights.upcoming_lines(_mart(spark, sf_dir)).select(
        "event_key", "headline", "p1_h2h_wins", "p1_h2h_share", "p1_standing",
        "p2_h2h_wins", "p2_h2h_share", "p2_standing",
    )


@_register
def gaps(spark, sf_dir):
    return insights.with_gaps(_mart(spark, sf_dir)).select("event_key", "points_gap", "points_gap_plot", "odds_gap")


# Analysis filters and bet history


@_register
def bet_filter_with(spark, sf_dir):
    return filters.filter_bets(_analysis(spark, sf_dir), "Con apuesta").select("event_key", "event_date")


@_register
def bet_filter_without(spark, sf_dir):
    return filters.filter_bets(_analysis(spark, sf_dir), "Sin apuesta").select("event_key", "event_date")


@_register
def flag_filter(spark, sf_dir):
    rows = filters.filter_flag(_analysis(spark, sf_dir), "Low")
    return rows.select("event_key", "flag_low_bet_value")


@_register
def flag_values(spark, sf_dir):
    flag = F.col("flag_low_bet_value")
    return _analysis(spark, sf_dir).select("event_key", labels.flag_to_binary(flag).alias("flag"))


@_register
def analysis_filtered(spark, sf_dir):
    rows = filters.filter_analysis(
        _analysis(spark, sf_dir), flag="Ok", tournaments=["Tournament#1", "Tournament#2", "Tournament#3"]
    )
    return rows.select("event_key", *filters.present(rows, filters.SUMMARY_COLUMNS))


@_register
def analysis_by_type_status(spark, sf_dir):
    """Equality filters on a type and a status."""
    rows = filters.filter_analysis(_analysis(spark, sf_dir), event_type="Singles", event_status="Finished", bets=filters.ALL)
    return rows.select("event_key", "event_type", "event_status")


@_register
def analysis_summary(spark, sf_dir):
    """The summary table, its flag as true or false."""
    rows = _analysis(spark, sf_dir)
    return filters.summary_table(rows).withColumn("flag_low_bet_value", F.col("flag_low_bet_value").cast("int"))


@_register
def bet_result(spark, sf_dir):
    return history.with_bet_outcome(_analysis(spark, sf_dir)).select("event_key", "event_date", "result_bet")


@_register
def bet_profit(spark, sf_dir):
    return history.with_bet_outcome(_analysis(spark, sf_dir)).select(
        "event_key", "event_date", "profit_loss_vb", "profit_loss_cons"
    )


@_register
def bet_profit_per_model(spark, sf_dir):
    return history.with_bet_outcome(_analysis(spark, sf_dir), per_model=True).select(
        "event_key", "event_date", "profit_loss_vb", "profit_loss_cons"
    )


@_register
def history_update(spark, sf_dir):
    star = _star(spark, sf_dir)
    return history.update_history(star.history, star.analysis, AS_OF)


@_register
def history_delete(spark, sf_dir):
    star = _star(spark, sf_dir)
    return history.drop_replaced_dates(star.history, star.analysis, AS_OF)


@_register
def history_insert(spark, sf_dir):
    return history.new_bets(_analysis(spark, sf_dir), AS_OF)


@_register
def history_initial(spark, sf_dir):
    return history.initial_history(_analysis(spark, sf_dir))


@_register
def history_merged(spark, sf_dir):
    star = _star(spark, sf_dir)
    return history.merge_history(star.history, star.analysis, AS_OF)


# Loads


@_register
def max_event_date(spark, sf_dir):
    return tables.max_event_date(_star(spark, sf_dir).results)


@_register
def load_ranges(spark, sf_dir):
    high_water = tables.max_event_date(_star(spark, sf_dir).results)
    return incremental.load_ranges(high_water, AS_OF, utc_hour=9)


@_register
def load_ranges_monday(spark, sf_dir):
    """A run day after all data, on a Monday: everything is due."""
    high_water = tables.max_event_date(_star(spark, sf_dir).results)
    return incremental.load_ranges(high_water, dt.date(2002, 1, 7), utc_hour=8)


def _month_anew(spark, sf_dir):
    """The month up to the run day comes anew, with retired matches only: what the load is."""
    current = _star(spark, sf_dir).results
    start = AS_OF - dt.timedelta(days=30)
    pulled = current.filter(F.col("event_day").between(F.lit(start), F.lit(AS_OF)) & (F.col("event_status") == "Retired"))
    return current, pulled, start


@_register
def range_replace(spark, sf_dir):
    merged = tables.replace_range(*_month_anew(spark, sf_dir), AS_OF)
    return merged.select("event_key", "event_date", "event_status", "event_winner")


# Loads, written to the session's warehouse and read back


def _stored_at(spark: SparkSession) -> str:
    """A folder of its own for every run."""
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/courtside_{uuid.uuid4().hex}"


def _full(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """With nulls for the fields of the table that the derived rows lack."""
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in rows.columns})


@_register
def range_replace_stored(spark, sf_dir):
    """K2: the day-partitioned table, filled, then a range of it replaced."""
    path = _stored_at(spark)
    current, pulled, start = _month_anew(spark, sf_dir)
    current, pulled = (x.drop("event_day") for x in (current, pulled))
    bounds = current.agg(F.to_date(F.min("event_date")), F.to_date(F.max("event_date"))).first()
    tables.replace_days(spark, path, current, *bounds)
    tables.replace_days(spark, path, pulled, start, AS_OF)
    return tables.read_days(spark, path, current.schema).select("event_key", "event_date", "event_status", "event_winner")


@_register
def snapshot_replace(spark, sf_dir):
    """K1, K5: replaced as a whole; an empty load afterwards leaves the rows."""
    rows = _star(spark, sf_dir).standings
    table = tables.VersionedTable(spark, _stored_at(spark), rows.schema)
    table.replace(rows.limit(1))
    table.replace(rows)
    table.replace(rows.filter(F.lit(False)), keep_if_empty=True)
    return table.read()


@_register
def rows_appended(spark, sf_dir):
    """K3: appended in two loads, NaN as null."""
    path = _stored_at(spark)
    price = F.when(F.col("l_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    rows = _star(spark, sf_dir).star("lineitem").select(F.col("l_orderkey").alias("event_key"), price.alias("price"))
    for part in (0, 1):
        tables.append_rows(rows.filter(F.col("event_key") % 2 == part), path)
    return spark.read.schema(rows.schema).parquet(path)


@_register
def history_first_run(spark, sf_dir):
    """H5, K7: the analysis run on a history that does not exist yet, read back."""
    house = daily.Warehouse(spark, _stored_at(spark))
    rows = _analysis(spark, sf_dir)
    daily.run_analysis(house, rows, AS_OF)
    return house.bet_history(rows.schema).select(*rows.columns)


@_register
def history_merged_stored(spark, sf_dir):
    """H4, K5: the stored history after an analysis run."""
    house, star = daily.Warehouse(spark, _stored_at(spark)), _star(spark, sf_dir)
    days = [r.day for r in star.history.select(F.to_date("event_date").alias("day")).distinct().collect()]
    tables.overwrite_days(spark, house.path("full_analysis_hist"), star.history, days)
    daily.run_analysis(house, star.analysis, AS_OF)
    return house.bet_history(star.history.schema).select(*star.history.columns)


def _rolled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Totals of AS_OF from kept sums of three days before: then the last ten days had only their
    first downloads, and every 20th event of the month before lay one day earlier."""
    star = _star(spark, sf_dir)
    earlier, week = AS_OF - dt.timedelta(days=3), AS_OF - dt.timedelta(days=10)
    day = F.col("event_day")
    shifted = (F.col("event_key") % 20 == 0) & (day > week - dt.timedelta(days=30)) & (day <= week)
    before = star.results.filter((day <= week) | (F.col("download_time") < F.timestamp_seconds(F.lit(895000000 + 2 * 86400))))
    before = before.withColumn("event_day", F.when(shifted, F.date_sub(day, 1)).otherwise(day))
    kept = rolling.RolledRecords(spark, _stored_at(spark))
    kept.advance(before, [], earlier)
    kept.advance(star.results, [AS_OF - dt.timedelta(days=i) for i in range(42)], AS_OF)
    return kept.player_totals(players.player_universe(star.fixtures)), star.tournaments


@_register
def records_rolled(spark, sf_dir):
    """A1 from sums that are kept per day and follow new, corrected and expired days."""
    return records.records_by_surface(*_rolled(spark, sf_dir), AS_OF)


@_register
def records_all_rolled(spark, sf_dir):
    """A2 from the same sums."""
    return records.records_all(_rolled(spark, sf_dir)[0], AS_OF)


@_register
def history_merged_bucketed(spark, sf_dir):
    """H1, J9, J10: history and analysis in tables bucketed by the event; the merge leaves the
    history's rows where they are."""
    star, name = _star(spark, sf_dir), f"courtside_{uuid.uuid4().hex}"
    hist = tables.write_bucketed(star.history, f"{name}_hist", history.KEYS, 8)
    analysis = tables.write_bucketed(star.analysis, f"{name}_analysis", history.KEYS, 8)
    return history.merge_in_place(hist, analysis, AS_OF)


@_register
def constants_log(spark, sf_dir):
    """K8: the stored log of all profiles after one more row, current values read back."""
    house = daily.Warehouse(spark, _stored_at(spark))
    tables.append_rows(_star(spark, sf_dir).constants, house.path("constants_main"))
    house.append_constants({"nombre_constante": "default", "c_01": 7, "p_01": 0.5}, dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc))
    return constants.latest_constants(house.constants()).select("nombre_constante", "c_01", "c_02", "p_01", "pm")


@_register
def daily_steps(spark, sf_dir):
    """I4: the steps of a refresh over stored tables, one that fails among them."""
    house, star = daily.Warehouse(spark, _stored_at(spark)), _star(spark, sf_dir)
    at = dt.datetime(1998, 5, 14, 9)
    bounds = star.results.agg(F.min("event_day"), F.max("event_day")).first()
    loads = {"fixtures_for_today": star.fixtures, "h2h_for_today2": star.h2h, "tournaments": star.tournaments,
             "standings": star.standings, "odds_for_today": star.odds}
    stored = lambda name, rows: daily.load_snapshot(house, name, _full(rows, house.SNAPSHOTS[name]), at)
    steps = [daily.attempt("fixtures_results", lambda: daily.load_results(house, _full(star.results, schemas.FIXTURES_RESULTS), *bounds, at))]
    steps += [daily.attempt(name, lambda name=name, rows=rows: stored(name, rows)) for name, rows in loads.items()]
    steps.append(daily.attempt("no_such_table", lambda: stored("no_such_table", star.odds)))
    steps += daily.refresh_tables(house, AS_OF, at)
    return spark.createDataFrame([(s.name, s.ok, s.rows) for s in steps], "step string, ok boolean, step_rows long")


@_register
def sql_file_with_params(spark, sf_dir):
    """S12: the statement comes from a file."""
    path = _stored_at(spark)
    text = "select event_status, count(*) as matches from courtside_matches where event_winner = ? group by event_status"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    _star(spark, sf_dir).matches.createOrReplaceTempView("courtside_matches")
    return tables.run_sql_file(spark, path, ["Second Player"])


@_register
def catalog_table(spark, sf_dir):
    """K4, K11: dropped and created from a query, under the catalog."""
    name = f"courtside_{uuid.uuid4().hex}"
    tables.ensure_table(spark, name, schemas.STANDINGS)
    tables.create_table_as(_star(spark, sf_dir).tournaments, name)
    return spark.table(name)


@_register
def constants_latest(spark, sf_dir):
    return constants.latest_constants(_star(spark, sf_dir).constants).drop("inserted_at")


@_register
def constants_profiles(spark, sf_dir):
    """In order of first use, each with its place in the list."""
    names = constants.profile_names(_star(spark, sf_dir).constants).select("nombre_constante")
    return names.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


@_register
def sql_with_params(spark, sf_dir):
    _star(spark, sf_dir).results.createOrReplaceTempView("courtside_fixtures_results")
    return tables.run_sql(
        spark,
        "select event_status, count(*) as downloads, max(event_date) as last_date "
        "from courtside_fixtures_results where event_date >= ? and event_winner = ? group by event_status",
        ["1997-01-01", "First Player"],
    )


# Exports


@_register
def export_spanish(spark, sf_dir):
    """With each row's place within its tournament."""
    wide = _mart(spark, sf_dir).select("event_key", "first_player_key", "second_player_key", *filters.TABLE_COLUMNS)
    rows = ranking.in_order(wide, "tournament_name", ["event_time", *mart.TIE_BREAKERS])
    return export.shown(rows, ["event_key", *filters.TABLE_COLUMNS, "place"])


@_register
def tsv_rows(spark, sf_dir):
    wide = _mart(spark, sf_dir)
    return wide.select(
        "event_key", export.tsv_line(wide, with_odds=True).alias("line"), export.match_label(wide).alias("label")
    )


@_register
def display_formats(spark, sf_dir):
    price = F.col("o_totalprice")
    return _star(spark, sf_dir).star("orders").select(
        "o_orderkey",
        formats.spanish_number(price).alias("spanish"),
        formats.spanish_percent(price / 1000).alias("spanish_share"),
        formats.spanish_date(F.col("o_orderdate").cast("date").cast("string")).alias("spanish_day"),
        formats.spanish_number(F.col("o_orderpriority")).alias("no_number"),
        formats.odds_or_mark(price).alias("odds"),
        formats.short_percent(price).alias("share"),
        formats.fixed_or_mark(price, " pts").alias("fixed"),
        formats.text_or_mark(F.col("o_custkey"), " pts").alias("plain"),
    )


# Landed JSON


def _texts(df: DataFrame, **changes: Column) -> Column:
    """A row's match fields as the feed sends them: texts, ids written as decimals."""
    fields = {c: changes.get(c, F.col(c).cast("string")) for c in df.columns}
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _feed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _star(spark, sf_dir).matches
    return rows.select(*filters.present(rows, schemas.MATCH_FIELDS + schemas.LOGO_FIELDS))


@_register
def fixtures_json_flatten(spark, sf_dir):
    rows = _feed_matches(spark, sf_dir)
    key = F.concat(F.col("event_key").cast("string"), F.lit(".0"))
    result = F.to_json(F.array(_texts(rows, event_key=key)))
    return landed.flatten_matches(rows.select(result.alias("result")), logos=True)


@_register
def h2h_json_flatten(spark, sf_dir):
    """One pair in nine has a meeting that is no object; it is skipped, the others load."""
    rows = _feed_matches(spark, sf_dir)
    meetings = F.array(_texts(rows))
    result = F.to_json(F.struct(meetings.alias("H2H"), meetings.alias("firstPlayerResults")))
    result = F.when(F.col("event_key") % 9 == 0, F.replace(result, F.lit('"H2H":['), F.lit('"H2H":[5,'))).otherwise(result)
    return landed.flatten_h2h(rows.select(result.alias("result")), on_bad="skip")


@_register
def tournaments_json_flatten(spark, sf_dir):
    rows = _star(spark, sf_dir).tournaments.withColumn("event_type_key", F.lit("n/a"))
    return landed.flatten_tournaments(rows.select(F.to_json(F.array(_texts(rows))).alias("result")))


@_register
def standings_union(spark, sf_dir):
    rows = _star(spark, sf_dir).star("customer").select(
        F.col("c_custkey").alias("place"), F.col("c_name").alias("player"),
        F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("player_key"),
        F.col("c_mktsegment").alias("league"), F.floor("c_acctbal").alias("points"),
    )
    tagged = rows.select(
        F.to_json(F.array(_texts(rows))).alias("result"),
        F.when(F.col("place") % 2 == 0, "ATP").otherwise("WTA").alias("event_type"),
    )
    return landed.flatten_standings(tagged)


@_register
def odds_json_flatten(spark, sf_dir):
    """A response per price, with two events: some lack the away side, some have it blank or
    zero, as number or as text; some prices are large or long; all carry another market of
    another shape."""
    rows = _star(spark, sf_dir).odds.withColumn("event_key", F.col("event_key").cast("string"))
    home = F.when(F.col("event_key").endswith("7"), "123456789").when(F.col("event_key").endswith("5"), "1.2345678901").otherwise(
        F.col("home_odds").cast("string"))
    price = F.col("away_odds").cast("string")
    away = (
        F.when(F.col("event_key").endswith("2"), "0")                       # the number: no price
        .when(F.col("event_key").endswith("3"), '"0"')                      # the text: a price
        .when(F.col("away_odds") > 1.05, F.concat(F.lit('"'), price, F.lit('"')))
        .when(F.col("home_odds") > 1.05, '""').otherwise("null")
    )
    event = F.format_string('{"Home/Away": {"Home": {"%s": "%s"}, "Away": {"%s": %s}}, "Set Betting": [1]}', "betting_house", home, "betting_house", away)
    result = F.format_string('{"%s": %s, "0%s": {"Home/Away": []}}', "event_key", event, "event_key")
    return landed.flatten_odds(rows.select(result.alias("result")), F.lit("1998-05-13"))


@_register
def id_coercion(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    text = (
        F.when(F.col("o_orderkey") % 6 == 0, key)
        .when(F.col("o_orderkey") % 6 == 1, F.concat(key, F.lit(".0")))
        .when(F.col("o_orderkey") % 6 == 2, F.concat(F.lit(" "), key, F.lit(" ")))
        .when(F.col("o_orderkey") % 6 == 3, F.concat(key, F.lit("x")))
        .when(F.col("o_orderkey") % 6 == 4, "")
    )
    rows = _star(spark, sf_dir).star("orders")
    return rows.select("o_orderkey", numbers.to_id(text).alias("id"))
