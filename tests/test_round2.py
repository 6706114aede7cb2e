"""Feeds that lose nothing, the history's one switch, the analysis run, order and hot nulls."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import frames
from courtside import schemas
from courtside.operators import export, insights, mart
from courtside.plans import daily, jobs
from courtside.sources import landed, tables
from courtside.sources.derived import AS_OF as RUN_DAY
from courtside.sources.derived import StarTables
from frames import AS_OF, rows
from test_history import NONE, TODAY, bet, frame, sample
from test_loads import AT, D, days, feed_match, land, setup

MATCH = {"event_key": 1}


@pytest.mark.parametrize("result", [[MATCH, 5, MATCH], [MATCH, []], [MATCH, None], [[MATCH]], {"a": 1}, "none", 5, True])
def test_odd_lists_fail_the_load(spark, tmp_path, result):
    path = land(tmp_path / "m", {"result": [MATCH]}, {"result": result})
    with pytest.raises(Exception, match="unexpected"):
        landed.flatten_matches(landed.read_landed(spark, path)).collect()


@pytest.mark.parametrize("body", ["[1]", "7", '"text"', '{"result": [}', "<html>"])
def test_responses_that_are_no_object_fail(spark, tmp_path, body):
    with pytest.raises(Exception, match="MALFORMED"):
        landed.flatten_matches(landed.read_landed(spark, land(tmp_path / "m", body))).collect()


def test_empty_results_give_no_rows(spark, tmp_path):
    path = land(tmp_path / "m", {"result": []}, {"result": {}}, {"result": None}, {}, {"success": 1})
    for flatten in (landed.flatten_matches, landed.flatten_tournaments, landed.flatten_h2h):
        assert flatten(landed.read_landed(spark, path)).count() == 0


def odds_of(spark, tmp_path, home, away):
    market = {"Home/Away": {"Home": {"Sbo": home}, "Away": {"Sbo": away}}}
    path = land(tmp_path / "o", {"result": {"7": market, "8": {"Home/Away": []}}})
    return rows(landed.flatten_odds(landed.read_landed(spark, path), F.lit("2024-03-14")), "event_key", "home_odds", "away_odds")


@pytest.mark.parametrize("home, away, want", [
    ("1.5", 0, []), ("1.5", 0.0, []), ("1.5", "", []), ("1.5", None, []), ("1.5", False, []), ("1.5", [], []),
    ("1.5", "0", [(7, Decimal("1.5"), 0)]), (0, 2, [(7, 0, 2)]), ("123456789", "1.23456789", [(7, 123456789, Decimal("1.23456789"))]),
    ("x", "1.0123456789", [(7, None, Decimal("1.0123456789"))]),
])
def test_prices(spark, tmp_path, home, away, want):
    assert odds_of(spark, tmp_path, home, away) == want


@pytest.mark.parametrize("price", ["1.01234567891", "123456789012345678"])
def test_prices_that_do_not_fit_fail(spark, tmp_path, price):
    with pytest.raises(Exception, match="price does not fit"):
        odds_of(spark, tmp_path, price, "2")


@pytest.mark.parametrize("result", [[1], "x", {"1": [2]}, {"1": {"Home/Away": "x"}}, {"1": {"Home/Away": {"Home": "x", "Away": {}}}}])
def test_odd_odds_fail(spark, tmp_path, result):
    with pytest.raises(Exception, match="unexpected"):
        landed.flatten_odds(landed.read_landed(spark, land(tmp_path / "o", {"result": result})), F.lit("d")).collect()


def test_bad_pairs_are_skipped_and_counted(spark, tmp_path):
    house, pulls, at = setup(spark, tmp_path)
    good = {"result": {"H2H": [feed_match(1), feed_match(2)]}}
    land(at("h2h_for_today2"), good, "<html>", {"result": {"H2H": [feed_match(3), 5]}}, {"result": {"H2H": "x"}}, {"result": [1]}, {"result": []})
    steps = {s.name: s for s in daily.run_manual(house, pulls, ("h2h_for_today2",), at=AT)}
    assert (steps["h2h_for_today2"].ok, steps["h2h_for_today2"].rows, steps["h2h_for_today2"].skipped) == (True, 2, 4)
    with pytest.raises(Exception, match="unexpected"):
        landed.flatten_h2h(landed.read_landed(spark, land(tmp_path / "one", {"result": {"H2H": [5]}}))).collect()


def pull(spark, *data):
    return frames.matches(spark, *[{"event_key": k, "event_date": d} for k, d in data])


@pytest.mark.parametrize("at", ["before", "during"])
def test_a_stop_while_publishing_loses_nothing(spark, tmp_path, monkeypatch, at):
    path = str(tmp_path / "results")
    tables.replace_days(spark, path, pull(spark, (1, "2024-03-01"), (2, "2024-03-02"), (3, None)), D(2024, 3, 1), D(2024, 3, 2))

    def stop(*_):
        raise RuntimeError("lost")

    log = tables._log_stage
    with monkeypatch.context() as m:
        if at == "before":
            m.setattr(tables, "publish_days", lambda *a: stop() if tables._staged_versions(*a[:2])[0] > 1 else False)
        else:  # the table is written, its entry is not
            m.setattr(tables, "_log_stage", lambda s, p, v, published: stop() if published else log(s, p, v, published))
        with pytest.raises(RuntimeError):
            tables.replace_days(spark, path, pull(spark, (5, "2024-03-02"), (6, "2024-02-01")), D(2024, 3, 2), D(2024, 3, 2))
    want = [(1, "2024-03-01"), (3, None), (5, "2024-03-02"), (6, "2024-02-01")]
    assert days(spark, path) == want  # the staged days count already
    assert tables.publish_days(spark, path, schemas.FIXTURES_RESULTS) and days(spark, path) == want
    assert not tables.publish_days(spark, path, schemas.FIXTURES_RESULTS)
    tables.replace_days(spark, path, pull(spark, (7, "2024-03-01")), D(2024, 3, 1), D(2024, 3, 1))
    assert days(spark, path) == [(3, None), (5, "2024-03-02"), (6, "2024-02-01"), (7, "2024-03-01")]


def test_a_stop_while_staging_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "results")
    tables.replace_days(spark, path, pull(spark, (1, "2024-03-01")), D(2024, 3, 1), D(2024, 3, 1))
    bad = pull(spark, (2, "2024-03-01")).withColumn("event_winner", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.replace_days(spark, path, bad, D(2024, 3, 1), D(2024, 3, 1))
    assert days(spark, path) == [(1, "2024-03-01")]


def test_rows_outside_the_range_join_their_days(spark, tmp_path):
    path = str(tmp_path / "results")
    for load in (((1, "2024-03-01"), (2, "2024-02-01"), (3, None)), ((4, "2024-03-01"), (5, "2024-02-01"), (6, None))):
        tables.replace_days(spark, path, pull(spark, *load), D(2024, 3, 1), D(2024, 3, 1))
    assert [k for k, _ in days(spark, path)] == [2, 3, 4, 5, 6]


def test_expiry_keeps_the_newest(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), frames.standings(spark, (1, "1")).schema)
    for i in range(3):
        table.replace(frames.standings(spark, (i, "1")))
    table.replace(table.read().limit(0), keep_if_empty=True)
    table.replace(frames.standings(spark, (9, "9")))
    assert table.expire(4) == [] and table.expire(2) == [1, 2] and rows(table.read()) == [(9, "9")]
    with pytest.raises(ValueError):
        table.expire(0)


def test_high_water_reads_the_newest_day(spark, tmp_path):
    path = str(tmp_path / "results")
    load = pull(spark, (1, "2024-3-2"), (2, "2024-03-01"), (3, "2024-03-10"), (4, None))
    tables.replace_days(spark, path, load, D(2024, 3, 1), D(2024, 3, 10))
    high = tables.high_water(spark, path, schemas.FIXTURES_RESULTS)
    assert high.first()[0] == "2024-03-10"  # "2024-3-2" is later as text only
    plan = high._jdf.queryExecution().toString()
    assert "event_day" in plan.split("PartitionFilters: [")[-1].split("PushedFilters")[0]
    tables.replace_days(spark, path, pull(spark, (2, "2024-03-01")), D(2024, 3, 2), D(2024, 3, 10))
    assert tables.high_water(spark, path, schemas.FIXTURES_RESULTS).first()[0] == "2024-03-01"
    assert tables.high_water(spark, str(tmp_path / "none"), schemas.FIXTURES_RESULTS).first()[0] is None


def test_analysis_run(spark, tmp_path):
    house = daily.Warehouse(spark, str(tmp_path / "house"))
    _, analysis = sample(spark)
    stored = lambda: rows(house.bet_history(analysis.schema), "event_key", "result_bet")
    assert [(s.name, s.ok) for s in daily.run_analysis(house, analysis, AS_OF)] == [("analysis", True), ("history", True)]
    assert rows(house.snapshot("main_todays_analysis").read(), "event_key") == rows(analysis, "event_key")
    assert stored() == [(1, None), (5, None), (7, None)]
    later = frame(spark, bet(1, winner="P2"), bet(8, TODAY), bet(9, TODAY, cons=NONE, vb=NONE))
    for _ in range(2):  # a rerun changes nothing
        daily.run_analysis(house, later, AS_OF)
        assert stored() == [(1, "lost"), (7, None), (8, None)]


def test_constants_log_in_the_warehouse(spark, tmp_path):
    house = daily.Warehouse(spark, str(tmp_path / "house"))
    assert house.constants().count() == 0
    for i in (1, 2):
        assert house.append_constants({"nombre_constante": "x", "c_01": i, "c_05": float("nan")}, dt.datetime(2024, 1, i)) == 1
    assert rows(house.constants(), "c_01", "c_05") == [(1, None), (2, None)]


def test_sorted_results_come_in_order(spark):
    star = StarTables(spark, "/root/testdata/sf0.001")
    wide = jobs.full_mart(star.match_tables(), RUN_DAY, F.lit(AT))
    keys = [(r.event_date, r.event_time, r.event_key) for r in mart.in_reading_order(wide).collect()]
    assert keys == sorted(keys)
    shown = export.export_table(wide, ["tournament_name", "event_time", "event_key"], spanish=False).collect()
    assert [tuple(r) for r in shown] == sorted(tuple(r) for r in shown)


def test_next_matches_are_chosen_before_the_joins(spark):
    star = StarTables(spark, "/root/testdata/sf0.001")
    got = jobs.next_matches(star.match_tables(), RUN_DAY, loaded_at=F.lit(AT))
    whole = insights.next_matches(jobs.full_mart(star.match_tables(), RUN_DAY, F.lit(AT)))
    assert [r.event_key for r in got.collect()] == [r.event_key for r in whole.collect()] and got.columns == whole.columns
    assert rows(got) == rows(whole)
    unread = star.match_tables()
    unread = jobs.replace(unread, fixtures=unread.fixtures.withColumn("event_time", F.lit("soon")))
    assert jobs.next_matches(unread, RUN_DAY).count() > 10


def test_standings_without_a_key_stay_out_of_the_join(spark):
    standings = spark.range(20_000).selectExpr("if(id = 1, 10, null) as player_key", "string(id) as points")
    none = "player_id bigint, tournament_sourface string, wins_sourface bigint, losses_sourface bigint"
    cards = mart.player_cards(spark.createDataFrame([], none), spark.createDataFrame([(10, 1, 2)], "player_id bigint, wins_all bigint, losses_all bigint"),
                              standings)
    assert rows(cards, "player_id", "points") == [(10, "1")]
