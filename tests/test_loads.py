import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import frames
from courtside import schemas
from courtside.plans import daily
from courtside.sources import landed, tables
from courtside.streaming import incremental
from frames import AS_OF, rows

D = dt.date


def land(path, *bodies, indent=None):
    path.mkdir(parents=True, exist_ok=True)
    for i, body in enumerate(bodies):
        (path / f"{i}.json").write_text(body if isinstance(body, str) else json.dumps(body, indent=indent))
    return str(path)


def feed_match(key, **changes):
    return {
        "event_key": key, "event_date": "2024-03-14", "event_time": "10:00", "event_first_player": "A",
        "first_player_key": "10", "event_second_player": "B", "second_player_key": "20.0", "event_winner": "First Player",
        "event_status": "Finished", "event_type_type": "Atp Singles", "tournament_name": "Open", "tournament_key": "7",
        "event_first_player_logo": "a.png", "ignored": {"x": [1]}, **changes,
    }


def test_matches(spark, tmp_path):
    path = land(tmp_path / "m", {"result": [feed_match(1), feed_match("2.0", tournament_key="x")]}, {"result": []},
                {"success": 1}, {"result": None})
    got = landed.flatten_matches(landed.read_landed(spark, path))
    assert got.columns == schemas.MATCH_FIELDS
    assert rows(got, "event_key", "first_player_key", "second_player_key", "tournament_key", "event_serve") == [
        (1, 10, 20, 7, None), (2, 10, 20, None, None)]
    logos = landed.flatten_matches(landed.read_landed(spark, path), logos=True)
    assert rows(logos, *schemas.LOGO_FIELDS) == [("a.png", None), ("a.png", None)]


def test_pretty_printed_files(spark, tmp_path):
    path = land(tmp_path / "m", {"result": [feed_match(1)]}, {"result": [feed_match(2)]}, indent=2)
    got = landed.flatten_matches(landed.read_landed(spark, path, multiline=True))
    assert rows(got, "event_key") == [(1,), (2,)]


def test_malformed_response_fails_the_pull(spark, tmp_path):
    path = land(tmp_path / "m", {"result": [feed_match(1)]}, '{"result": [')
    with pytest.raises(Exception, match="MALFORMED"):
        landed.flatten_matches(landed.read_landed(spark, path)).collect()


def test_tournaments(spark, tmp_path):
    path = land(tmp_path / "t", {"result": [
        {"tournament_key": 1, "tournament_name": "Open", "event_type_key": "265", "event_type_type": "Atp",
         "tournament_sourface": "clay"}, {"tournament_key": "2"}]})
    got = rows(landed.flatten_tournaments(landed.read_landed(spark, path)))
    assert got == [(1, "Open", 265, "Atp", "clay"), (2, None, None, None, None)]


def test_standings_are_tagged_and_empty_types_skipped(spark, tmp_path):
    land(tmp_path / "event_type=ATP", {"result": [{"place": "1", "player": "A", "player_key": "2382.0", "points": 900}]})
    land(tmp_path / "event_type=WTA", {"result": [{"place": "1", "player": "B", "player_key": 5}]})
    land(tmp_path / "event_type=ITF", {"result": []})
    got = landed.flatten_standings(landed.read_landed(spark, str(tmp_path)))
    assert got.columns == schemas.STANDING_FIELDS + ["event_type"]
    assert rows(got, "player_key", "points", "event_type") == [(2382, "900", "ATP"), (5, None, "WTA")]


def test_standings_fail_as_a_whole(spark, tmp_path):
    land(tmp_path / "event_type=ATP", {"result": [{"player_key": 1}]})
    land(tmp_path / "event_type=WTA", "<html>")
    with pytest.raises(Exception, match="MALFORMED"):
        landed.flatten_standings(landed.read_landed(spark, str(tmp_path))).collect()


def test_h2h_takes_meetings_only(spark, tmp_path):
    path = land(
        tmp_path / "h", {"result": {"H2H": [feed_match(1)], "firstPlayerResults": [feed_match(8)]}},
        {"result": {"H2H": [feed_match(2)]}}, {"result": {}}, {"result": []}, {"result": {"H2H": []}},
    )
    got = landed.flatten_h2h(landed.read_landed(spark, path))
    assert got.columns == schemas.MATCH_FIELDS and rows(got, "event_key") == [(1,), (2,)]


def test_odds(spark, tmp_path):
    market = lambda home, away: {"Home/Away": {"Home": home, "Away": away}, "Set Betting": {"2:0": {"Sbo": "3"}}}
    land(tmp_path / "date_start=2024-03-14", {"result": {
        "11": market({"Sbo": "1.533", "Pncl": 2, "10Bet": "9", "bad": "x"}, {"Sbo": "2.5", "Pncl": "", "bad": "4"}),
        "12": {"Home/Away": []}, "13": {"Over/Under": {}}, "14": [], "15.0": market({"Sbo": "1"}, {"Sbo": 2}),
        "16": market({}, {"Sbo": "1"}),
    }})
    land(tmp_path / "date_start=2024-03-15", {"result": []}, {"result": {"17": market({"Sbo": "7"}, {"Sbo": "8"})}})
    got = landed.flatten_odds(landed.read_landed(spark, str(tmp_path)))
    as_float = F.col("home_odds").cast("double"), F.col("away_odds").cast("double")
    assert rows(got, "event_key", "betting_house", *as_float, "event_date") == [
        (11, "Sbo", 1.533, 2.5, "2024-03-14"), (11, "bad", None, 4.0, "2024-03-14"),
        (15, "Sbo", 1.0, 2.0, "2024-03-14"), (17, "Sbo", 7.0, 8.0, "2024-03-15"),
    ]


def test_versions_switch_as_a_whole(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), frames.standings(spark, (1, "1")).schema)
    assert table.version() == 0 and table.read().count() == 0
    assert table.replace(frames.standings(spark, (1, "1"), (2, "2"))) == 2
    before = table.read()
    assert table.replace(table.read().filter("player_key = 1")) == 1   # reads what it replaces
    assert before.count() == 2 and rows(table.read()) == [(1, "1")]
    empty = table.read().limit(0)
    assert table.replace(empty, keep_if_empty=True) == 0 and rows(table.read()) == [(1, "1")]
    failing = table.read().withColumn("points", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        table.replace(failing)
    assert rows(table.read()) == [(1, "1")]
    assert table.replace(empty) == 0 and table.read().count() == 0
    with pytest.raises(ValueError):
        tables.VersionedTable(spark, str(tmp_path / "none")).read()


def days(spark, path):
    return rows(tables.read_days(spark, path, schemas.FIXTURES_RESULTS), "event_key", "event_date")


def test_range_replace_in_place(spark, tmp_path):
    path = str(tmp_path / "results")
    pull = lambda *data: frames.matches(spark, *[{"event_key": k, "event_date": d} for k, d in data])
    first = pull((1, "2024-03-01"), (2, "2024-03-02"), (3, "2024-03-03"), (4, None))
    assert tables.replace_days(spark, path, first, D(2024, 3, 1), D(2024, 3, 3)) == 4
    # the 2nd comes anew, the 3rd has no rows any more, and one row lies outside the range
    second = pull((5, "2024-03-02"), (6, "2024-03-01"), (7, None))
    assert tables.replace_days(spark, path, second, D(2024, 3, 2), D(2024, 3, 3)) == 3
    assert days(spark, path) == [(1, "2024-03-01"), (4, None), (5, "2024-03-02"), (6, "2024-03-01"), (7, None)]
    assert tables.replace_days(spark, path, pull(*[]), D(2024, 3, 1), D(2024, 3, 3)) == 0
    assert len(days(spark, path)) == 5
    assert tables.max_event_date(tables.read_days(spark, path, schemas.FIXTURES_RESULTS)).first()[0] == "2024-03-02"


def test_range_replace_as_a_frame(spark):
    current = frames.matches(spark, *[{"event_key": k, "event_date": d} for k, d in
                                      [(1, "2024-03-01"), (2, "2024-03-02"), (3, None)]])
    load = frames.matches(spark, {"event_key": 9, "event_date": "2024-03-03"})
    got = tables.replace_range(current, load, D(2024, 3, 2), D(2024, 3, 3))
    assert rows(got, "event_key") == [(1,), (3,), (9,)]
    assert tables.replace_range(current, load.limit(0), D(2024, 3, 2), D(2024, 3, 3)) is current


def test_day_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "results")
    tables.replace_days(spark, path, frames.matches(spark, {}, {"event_key": 2, "event_date": "2024-03-02"}),
                        D(2024, 3, 1), D(2024, 3, 2))
    from courtside.operators import players

    stored = tables.read_days(spark, path, schemas.FIXTURES_RESULTS)
    known = spark.createDataFrame([(10,)], "player_id bigint")
    plan = players.countable_matches(stored, known, AS_OF)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "event_day" in plan.split("PartitionFilters: [")[-1].split("PushedFilters")[0]
    assert "PushedFilters" in plan and "event_game_result" not in plan.split("ReadSchema")[-1]


def test_max_event_date_is_text_order(spark):
    df = frames.matches(spark, {"event_date": "2024-1-10"}, {"event_date": "2024-01-09"}, {"event_date": None})
    assert tables.max_event_date(df).first()[0] == "2024-1-10"


def ranges(spark, high, as_of=AS_OF, hour=8):
    return incremental.load_ranges(spark.createDataFrame([(high,)], "max_event_date string"), as_of, hour).first()


def test_load_ranges(spark):
    assert not ranges(spark, None, hour=7).needs_refresh
    assert ranges(spark, None).needs_refresh and ranges(spark, "2024-03-13").needs_refresh
    assert not ranges(spark, "2024-03-14").needs_refresh
    row = ranges(spark, "2024-03-10")
    assert (row.history_start, row.history_stop) == (D(2024, 3, 10), D(2024, 3, 14))
    assert (row.fixtures_start, row.fixtures_stop) == (D(2024, 3, 14), D(2024, 3, 17))
    assert (row.odds_start, row.odds_stop) == (D(2024, 3, 14), D(2024, 3, 20))
    assert ranges(spark, None).history_start == D(2024, 3, 14) and ranges(spark, "soon").needs_refresh
    assert not row.refresh_dimensions and ranges(spark, None, as_of=D(2024, 3, 18)).refresh_dimensions
    assert incremental.days_from(AS_OF, incremental.MANUAL_HISTORY_DAYS) == (D(2024, 3, 13), D(2024, 3, 14))


def test_catalog_tables(spark, tmp_path):
    spark.sql(f"create database courtside_test location '{tmp_path}/db'")
    try:
        name = "courtside_test.odds_for_today"
        assert tables.ensure_table(spark, name, schemas.ODDS_FOR_TODAY).schema == schemas.ODDS_FOR_TODAY
        tables.create_table_as(frames.standings(spark, (1, "1")), name)
        assert rows(tables.ensure_table(spark, name, schemas.ODDS_FOR_TODAY)) == [(1, "1")]
        tables.create_table_as(frames.standings(spark, (2, "2")), name)
        assert rows(spark.table(name)) == [(2, "2")]
    finally:
        spark.sql("drop database courtside_test cascade")


def test_sql(spark, tmp_path):
    assert tables.run_sql(spark, "select ? + 1 as x", [41]).first().x == 42
    (tmp_path / "q.sql").write_text("select 7\n  as x\n")
    assert tables.run_sql_file(spark, str(tmp_path / "q.sql")).first().x == 7
    with pytest.raises(ValueError):
        tables.run_sql(spark, "  ")


MONDAY = D(2024, 3, 18)
AT = dt.datetime(2024, 3, 18, 9)


def setup(spark, tmp_path):
    root = tmp_path / "landing"
    at = lambda table, *deeper: root.joinpath(table, f"run_date={MONDAY}", *deeper)
    land(at("fixtures_results"),
         {"result": [feed_match(1), feed_match(2, event_date="2024-03-17", event_winner="Second Player")]})
    land(at("fixtures_for_today"), {"result": [feed_match(3, event_date="2024-03-18", event_status="", event_winner=None)]})
    land(at("h2h_for_today2"), {"result": {"H2H": [feed_match(1), feed_match(2, event_winner="Second Player")]}})
    land(at("odds_for_today"), {"result": {"3": {"Home/Away": {"Home": {"bet365": "1.5"}, "Away": {"bet365": "2.6"}}}}})
    land(at("tournaments"), {"result": [{"tournament_key": 7, "tournament_name": "Open", "tournament_sourface": "clay"}]})
    land(at("standings", "event_type=ATP"), {"result": [{"player_key": 10, "points": "500"}]})
    land(root / "fixtures_for_today" / "run_date=2024-03-17", {"result": [feed_match(99)]})  # an older pull
    return daily.Warehouse(spark, str(tmp_path / "house")), daily.Landing(spark, str(root), MONDAY), at


def test_daily_run(spark, tmp_path):
    house, pulls, _ = setup(spark, tmp_path)
    assert daily.run_daily(house, pulls, utc_hour=7, at=AT) == []  # before the hour
    steps = daily.run_daily(house, pulls, utc_hour=9, at=AT)
    assert [(s.name, s.ok, s.rows) for s in steps] == [
        ("fixtures_results", True, 2), ("fixtures_for_today", True, 1), ("h2h_for_today2", True, 2),
        ("odds_for_today", True, 1), ("tournaments", True, 1), ("standings", True, 1),
        ("records", True, 4), ("h2h", True, 2), ("mart", True, 1),
    ]
    wide = house.snapshot("main_todays_games_details").read()
    assert wide.columns == schemas.MART_COLUMNS
    row = wide.first()
    assert (row.p1_wins_all, row.p1_losses_all, float(row.p1_rend_sup), row.p1_points, float(row.p2_odds), row.p1_wins_h2h,
            row.tournament_sourface, row.load_timestamp) == (1, 1, 0.5, "500", 2.6, 1, "Clay", AT)
    sources = house.sources()
    assert sources.odds.schema == schemas.ODDS_FOR_TODAY and sources.fixtures.columns == schemas.FIXTURES_FOR_TODAY.names
    assert sources.odds.first().event_date == "2024-03-17"
    assert daily.run_daily(house, pulls, utc_hour=9, at=AT) == []  # up to date now


def test_a_failed_step_is_reported_and_later_ones_run(spark, tmp_path):
    house, pulls, at = setup(spark, tmp_path)
    daily.run_daily(house, pulls, utc_hour=9, at=AT)
    land(at("odds_for_today"), "oops")
    land(at("fixtures_for_today"), {"result": []})
    chosen = ("fixtures_for_today", "odds_for_today", "fixtures_results")
    steps = {s.name: s for s in daily.run_manual(house, pulls, chosen, at=AT)}
    assert not steps["odds_for_today"].ok and "MALFORMED" in steps["odds_for_today"].message
    assert steps["fixtures_results"].rows == 2
    assert steps["fixtures_for_today"].rows == 0 and steps["mart"].rows == 1  # old rows survive
