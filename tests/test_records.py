import datetime as dt

import pytest
from pyspark.sql import functions as F

import frames
from courtside.operators import dedup, h2h, mart, odds, players, records
from courtside.plans import jobs
from frames import AS_OF, rows


def universe(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "player_id bigint")


def player_rows(spark, results, keys, **kw):
    return players.player_match_rows(players.countable_matches(results, universe(spark, *keys), AS_OF, **kw))


def test_universe_and_pairs(spark):
    df = frames.fixtures(spark, {}, {}, {"second_player_key": None}, {"first_player_key": 20, "second_player_key": 10})
    assert rows(players.player_universe(df)) == [(10,), (20,), (None,)]
    assert rows(players.player_pairs(df)) == [(10, 20), (20, 10)]


def test_filters_drop_old_unfinished_exhibition_and_untyped(spark):
    results = frames.matches(
        spark, {"event_key": 1}, {"event_key": 2, "event_date": "2023-03-15"}, {"event_key": 3, "event_date": "2023-03-16"},
        {"event_key": 4, "event_date": "2024-03-16"}, {"event_key": 5, "event_status": "Set 1"},
        {"event_key": 6, "event_type_type": "Exhibition Men"}, {"event_key": 7, "event_type_type": None},
        {"event_key": 8, "first_player_key": 1, "second_player_key": 2}, {"event_key": 9, "event_status": "Walk Over"},
        {"event_key": 10, "event_date": "2023-03-14"},
    )
    got = players.countable_matches(results, universe(spark, 20), AS_OF)
    assert rows(got, "event_key") == [(1,), (3,), (9,)]
    assert (AS_OF - dt.timedelta(days=365)).isoformat() == "2023-03-16"


def test_malformed_date_fails_the_job(spark):
    results = frames.matches(spark, {"event_date": "soon"})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        players.countable_matches(results, universe(spark, 10), AS_OF).collect()


def test_one_row_per_player_of_the_universe_and_one_for_a_self_pair(spark):
    results = frames.matches(
        spark, {"event_key": 1}, {"event_key": 2, "second_player_key": 99},
        {"event_key": 3, "second_player_key": 10}, {"event_key": 4, "first_player_key": None},
    )
    got = player_rows(spark, results, [10, 20])
    assert rows(got, "event_key", "player_id", "player_position", "winner_key") == [
        (1, 10, "first", 10), (1, 20, "second", 10), (2, 10, "first", 10), (3, 10, "first", 10), (4, 20, "second", None),
    ]


def test_same_rows_as_the_or_join(spark):
    keys = [1, 2, 3, 5]
    results = frames.matches(spark, *[
        {"event_key": i, "first_player_key": i % 7, "second_player_key": (i * 3) % 5} for i in range(60)
    ])
    got = player_rows(spark, results, keys).select("player_id", "event_key")
    known = universe(spark, *keys)
    plain = results.join(known, (F.col("first_player_key") == F.col("player_id"))
                         | (F.col("second_player_key") == F.col("player_id"))).select("player_id", "event_key")
    assert rows(got) == rows(plain)


def test_earliest_passing_download_wins(spark):
    early, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    results = frames.matches(
        spark,
        {"event_key": 1, "download_time": late, "event_winner": "Second Player"},
        {"event_key": 1, "download_time": early},
        # the first download names nobody of the universe, the second does
        {"event_key": 2, "download_time": early, "first_player_key": 1, "second_player_key": 2},
        {"event_key": 2, "download_time": late},
        {"event_key": 3, "download_time": None, "event_winner": "Second Player"}, {"event_key": 3, "download_time": late},
    )
    known = universe(spark, 10, 20)
    first = players.countable_matches(results, known, AS_OF)
    assert rows(first, "event_key", "event_winner") == [(1, "First Player"), (2, "First Player"), (3, "First Player")]
    last = players.countable_matches(results, known, AS_OF, keep="last")
    assert rows(last, "event_key", "event_winner") == [(1, "Second Player"), (2, "First Player"), (3, "First Player")]
    with pytest.raises(ValueError):
        dedup.keep_one(results, ["event_key"], "download_time", [], keep="any")


def test_ties_do_not_depend_on_row_order(spark):
    pair = [{"event_winner": "First Player"}, {"event_winner": "Second Player"}]
    got = [
        rows(players.countable_matches(frames.matches(spark, *order), universe(spark, 10), AS_OF), "event_winner")
        for order in (pair, pair[::-1])
    ]
    assert got[0] == got[1]


def sample_records(spark):
    results = frames.matches(
        spark, {"event_key": 1}, {"event_key": 2, "event_winner": "Second Player", "tournament_key": 8},
        {"event_key": 3, "event_winner": None}, {"event_key": 4, "tournament_key": None},
        {"event_key": 5, "tournament_key": 9, "event_winner": "Draw"},
    )
    totals = records.player_totals(player_rows(spark, results, [10]))
    dims = frames.tournaments(spark, (7, "clay"), (8, "Clay (Indoor)"), (9, ""))
    return records.records_by_surface(totals, dims, AS_OF), records.records_all(totals, AS_OF)


def test_records(spark):
    by_surface, overall = sample_records(spark)
    assert rows(by_surface) == [(AS_OF, 10, "Clay", 3, 1, 1, 1), (AS_OF, 10, "unkn", 2, 1, 0, 1)]
    assert rows(overall) == [(AS_OF, 10, 5, 2, 1, 2)]


def test_repeated_tournament_multiplies_surface_records_only(spark):
    totals = records.player_totals(player_rows(spark, frames.matches(spark, {}), [10]))
    twice = frames.tournaments(spark, (7, "Hard"), (7, "Hard"))
    assert rows(records.records_by_surface(totals, twice, AS_OF), "total_games_sourface") == [(2,)]
    assert rows(records.records_all(totals, AS_OF), "total_games_all") == [(1,)]


def test_h2h_sums_both_orders_and_mirrors(spark):
    df = frames.matches(
        spark, {"event_key": 1}, {"event_key": 2, "event_winner": None},
        {"event_key": 3, "first_player_key": 20, "second_player_key": 10},
        {"event_key": 4, "event_winner": "Second Player", "event_type_type": None},
        {"event_key": 5, "first_player_key": 30, "second_player_key": 40, "event_winner": None},
    )
    got = [tuple(None if v is None else float(v) for v in r) for r in rows(h2h.h2h_pairs(df))]
    assert got == [
        (10, 1, 20, 1, 0.5, 0.5), (20, 1, 10, 1, 0.5, 0.5), (30, 0, 40, 0, None, None), (40, 0, 30, 0, None, None),
    ]


def test_h2h_keeps_self_pairs_twice_and_null_sides(spark):
    df = frames.matches(
        spark, {"first_player_key": 5, "second_player_key": 5, "event_winner": "Second Player"},
        {"first_player_key": 6, "second_player_key": None}, {"first_player_key": None, "second_player_key": 7},
    )
    assert rows(h2h.h2h_pairs(df), "first_player_key", "total_first_player_key", "second_player_key") == [
        (5, 1, 5), (5, 1, 5), (7, 0, 7), (7, 0, 7), (None, 0, None), (None, 0, None),
    ]


def test_h2h_dedup_is_opt_in(spark):
    df = frames.matches(spark, {}, {})
    assert rows(h2h.h2h_pairs(df), "total_first_player_key") == [(0,), (2,)]
    assert rows(h2h.h2h_pairs(df, dedup=True), "total_first_player_key") == [(0,), (1,)]


def odds_frame(spark, *data):
    return spark.createDataFrame(list(data), "event_key bigint, betting_house string, home_odds string, away_odds string") \
        .select("event_key", "betting_house", F.col("home_odds").cast("decimal(18,6)").alias("home_odds"),
                F.col("away_odds").cast("decimal(18,6)").alias("away_odds"))


def test_odds(spark):
    df = odds_frame(
        spark, (1, "bet365", "1.50", None), (1, "Sbo", "9", "2"), (1, "Pncl", "9", "2.01"),
        (2, "Sbo", "1", None), (2, "Pncl", "1.01", None), (2, "Nobody", "50", "50"),
        (3, "Nobody", "2", "2"), (4, "10Bet", "2", "3"), (4, "10Bet", "4", "1"),
    )
    pivot = odds.odds_pivot(df)
    assert len(pivot.columns) == 27 and pivot.columns[1:3] == ["10bet_hm_odds", "10bet_aw_odds"]
    got = [tuple(None if v is None else float(v) for v in r)
           for r in rows(odds.odds_consensus(pivot), "event_key", "home_odds", "away_odds")]
    # 2.005 and 1.005 round half-up in exact decimals; a repeated house takes its highest price
    assert got == [(1, 1.5, 2.01), (2, 1.01, None), (3, None, None), (4, 4.0, 3.0)]


def build(spark, fixture_rows, standing_rows=((10, "500"),)):
    by_surface, overall = sample_records(spark)
    fixtures = frames.fixtures(spark, *fixture_rows)
    dims = frames.tournaments(spark, (7, "CLAY"), (8, "Hard"))
    pairs = h2h.h2h_pairs(frames.matches(spark, {}))
    tables = jobs.MatchTables(None, fixtures, None, dims, frames.standings(spark, *standing_rows),
                              odds_frame(spark, (1, "bet365", "1.5", "2.5")))
    return jobs.build_mart(tables, by_surface, overall, pairs, F.lit(dt.datetime(2024, 3, 15)))


def test_mart_row(spark):
    row = build(spark, [{"event_first_player_logo": "x.png", "event_status": "Set 2"}]).first().asDict()
    want = {
        "event_status": "In progress", "event_winner": "P1", "tournament_sourface": "Clay", "event_type": "Singles",
        "event_gender": "Men", "p1_wins_sourface": 1, "p1_losses_sourface": 1, "p1_wins_all": 2, "p1_losses_all": 1,
        "p1_points": "500", "p2_points": "0", "p2_wins_all": 0, "p1_wins_h2h": 1, "p2_wins_h2h": 0,
        "event_first_player_logo": "x.png", "event_second_player_logo": mart.DEFAULT_LOGO,
    }
    assert {k: row[k] for k in want} == want
    numbers = {k: float(row[k]) for k in ("p1_rend_all", "p1_rend_sup", "p2_rend_all", "p1_perc_h2h", "p1_odds", "p2_odds")}
    assert numbers == {"p1_rend_all": 0.667, "p1_rend_sup": 0.5, "p2_rend_all": 0.0, "p1_perc_h2h": 1.0,
                       "p1_odds": 1.5, "p2_odds": 2.5}


def test_mart_defaults_and_no_odds(spark):
    row = build(spark, [{"event_key": 2, "first_player_key": None, "tournament_key": 99}]).first()
    assert (row.p1_wins_all, row.p1_points, row.tournament_sourface, row.p1_wins_h2h, row.p1_odds) == (0, "0", "unkn", 0, None)


def test_mart_keeps_every_fixture_and_repeats_for_repeated_standings(spark):
    assert build(spark, [{}, {}, {"event_key": 2}]).count() == 3
    assert build(spark, [{}], [(10, "1"), (10, "2"), (20, "3")]).count() == 2


def test_self_pair_fans_out_on_h2h(spark):
    by_surface, overall = sample_records(spark)
    fixtures = frames.fixtures(spark, {"second_player_key": 10})
    pairs = h2h.h2h_pairs(frames.matches(spark, {"second_player_key": 10}))
    tables = jobs.MatchTables(None, fixtures, None, frames.tournaments(spark, (7, "Hard")),
                              frames.standings(spark, (1, "1")), odds_frame(spark, (9, "Sbo", "1", "1")))
    assert jobs.build_mart(tables, by_surface, overall, pairs).count() == 2


def test_properties_on_derived_tables(spark):
    from courtside.sources.derived import AS_OF as RUN_DAY, StarTables

    by_surface, overall = jobs.player_records(StarTables(spark, "/root/testdata/sf0.001").match_tables(), RUN_DAY)
    summed = by_surface.groupBy("player_id").agg(F.sum("total_games_sourface").alias("n"), F.sum("wins_sourface").alias("w"))
    both = overall.join(summed, "player_id", "full")
    assert both.filter("not (n <=> total_games_all and w <=> wins_all)").count() == 0
    assert overall.filter("wins_all + losses_all + draws_or_other_all <> total_games_all").count() == 0
    pairs = h2h.h2h_pairs(StarTables(spark, "/root/testdata/sf0.001").h2h)
    mirrored = pairs.selectExpr(
        "second_player_key as first_player_key", "total_second_player_key as total_first_player_key",
        "first_player_key as second_player_key", "total_first_player_key as total_second_player_key",
        "p2_perc_h2h as p1_perc_h2h", "p1_perc_h2h as p2_perc_h2h",
    )
    assert pairs.exceptAll(mirrored).count() == 0 and mirrored.exceptAll(pairs).count() == 0
