"""Records that roll from day to day against the plain computation over a year."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import frames
from courtside import schemas
from courtside.operators import players, records
from courtside.plans import daily, rolling
from courtside.sources import tables
from frames import AS_OF, rows

DAY = dt.timedelta(days=1)


def universe(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "player_id bigint")


def day_of(n):
    return (AS_OF + n * DAY).isoformat()


def plain(spark, results, keys, as_of, days=365):
    matches = players.countable_matches(results, universe(spark, *keys), as_of, days)
    return rows(records.records_all(records.player_totals(players.player_match_rows(matches)), as_of))


def kept_records(spark, kept, keys, as_of):
    return rows(records.records_all(kept.player_totals(universe(spark, *keys)), as_of))


def test_new_corrected_moved_and_expired_days(spark, tmp_path):
    kept = rolling.RolledRecords(spark, f"{tmp_path}/sums")
    first = [
        {"event_key": 1, "event_date": day_of(-365)},  # leaves the window with the next day
        {"event_key": 2, "event_date": day_of(-5)},
        {"event_key": 3, "event_date": day_of(-4), "event_status": "Set 2"},  # counts once corrected
        {"event_key": 4, "event_date": day_of(-3), "event_winner": None},
        {"event_key": 5, "event_date": day_of(-2), "second_player_key": 10},  # a player against themselves
        {"event_key": None, "event_date": day_of(-2)},
    ]
    results = frames.matches(spark, *first)
    assert len(kept.advance(results, [], AS_OF)) == 366
    assert kept_records(spark, kept, [10, 20], AS_OF) == plain(spark, results, [10, 20], AS_OF)
    later = [first[0], first[1], {**first[2], "event_status": "Finished"}, first[3], first[4], first[5],
             {"event_key": None, "event_date": day_of(-1)},
             {"event_key": 2, "event_date": day_of(1), "event_winner": "Second Player", "download_time": dt.datetime(2024, 2, 1)},
             {"event_key": 6, "event_date": day_of(1), "second_player_key": 30}]
    results = frames.matches(spark, *later)
    changed = [AS_OF - 4 * DAY, AS_OF - DAY]
    assert kept.advance(results, changed, AS_OF + DAY) == [*changed, AS_OF + DAY]
    for keys in ([10, 20], [20, 30]):
        assert kept_records(spark, kept, keys, AS_OF + DAY) == plain(spark, results, keys, AS_OF + DAY)
    # The event that lay on two days goes from one of them: the other day counts it again.
    results = frames.matches(spark, *[r for r in later if r["event_date"] != day_of(1)])
    kept.advance(results, [AS_OF + DAY], AS_OF + DAY)
    assert kept_records(spark, kept, [10, 20], AS_OF + DAY) == plain(spark, results, [10, 20], AS_OF + DAY)
    assert not kept.several(kept.total.version()).filter("event_key is not null").count()


@pytest.mark.parametrize("seed", [1])
def test_any_history(spark, tmp_path, seed):
    """Events that change day, players, winner and status between downloads, in a window of
    eight days that moves on, stands still and goes back."""
    draw, held = random.Random(seed), {}

    def some(day):
        return [{
            "event_key": draw.choice([None, *range(12)]), "event_date": day.isoformat(),
            "first_player_key": draw.choice([None, 1, 2, 3]), "second_player_key": draw.choice([None, 1, 2, 4]),
            "event_winner": draw.choice([None, "First Player", "Second Player", "Neither"]),
            "event_status": draw.choice(["Finished", "Retired", "Set 1"]), "tournament_key": draw.choice([None, 7, 8]),
            "event_type_type": draw.choice(["Atp Singles", "Atp Singles", "Exhibition Men", None]),
            "download_time": draw.choice([None, *(dt.datetime(2024, 3, n) for n in (1, 2, 3))]),
        } for _ in range(draw.randrange(5))]

    kept, as_of = rolling.RolledRecords(spark, f"{tmp_path}/sums", days=8), AS_OF
    for step in (0, 1, -2):
        as_of += step * DAY
        changed = [as_of - n * DAY for n in range(12) if not held or draw.random() < 0.3] + [as_of]
        held.update({d: some(d) for d in changed})
        results = frames.matches(spark, *[r for d in held.values() for r in d])
        kept.advance(results, changed, as_of)
        keys = draw.choice([[1, 2, 3, 4], [4], [2, None]])
        assert kept_records(spark, kept, keys, as_of) == plain(spark, results, keys, as_of, 8)


def test_nothing_to_do_and_expiry(spark, tmp_path):
    kept = rolling.RolledRecords(spark, f"{tmp_path}/sums", days=3)
    empty = frames.matches(spark).limit(0)
    assert kept.state() == rolling._State({}, {})
    assert len(kept.advance(empty, [], AS_OF)) == 4
    assert kept.advance(empty, [], AS_OF) == []
    assert kept_records(spark, kept, [10], AS_OF) == []
    results = frames.matches(spark, {"event_date": day_of(1)}, {"event_key": 2, "event_date": day_of(5)})
    for n in (1, 5):
        kept.advance(results, [], AS_OF + n * DAY)
    assert kept.expire() == [1, 2]  # every day of the window was read by the last run
    assert kept_records(spark, kept, [10], AS_OF + 5 * DAY) == plain(spark, results, [10], AS_OF + 5 * DAY, 3)


def test_only_days_that_were_replaced_are_read(spark, tmp_path):
    house = daily.Warehouse(spark, str(tmp_path))
    results = frames.matches(spark, *[{"event_key": n, "event_date": day_of(-n)} for n in range(30)])
    daily.load_results(house, results, AS_OF - 30 * DAY, AS_OF, dt.datetime(2024, 3, 15))
    fixtures = frames.fixtures(spark, {})
    daily.load_snapshot(house, "fixtures_for_today", fixtures, dt.datetime(2024, 3, 15))
    assert records.records_all(house.rolled_totals(AS_OF), AS_OF).collect()[0].total_games_all == 30
    later = frames.matches(spark, {"event_key": 7, "event_date": day_of(-7), "event_winner": "Second Player"})
    daily.load_results(house, later, AS_OF - 8 * DAY, AS_OF - 7 * DAY, dt.datetime(2024, 3, 16))
    changed, version = tables.changed_days(spark, house.path("fixtures_results"), 1)
    assert (changed, version) == ([AS_OF - 8 * DAY, AS_OF - 7 * DAY], 2)
    got = rows(records.records_all(house.rolled_totals(AS_OF), AS_OF), "player_id", "total_games_all", "wins_all", "losses_all")
    assert got == [(10, 29, 28, 1), (20, 29, 1, 28)]
    kept = rolling.RolledRecords(spark, house.path("player_sums"))
    state = kept.state()
    assert sorted(d for d, v in state.rows.items() if v == 2) == changed and state.source == 2
    plan = rolling.day_rows(house.results(), changed)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "PartitionFilters" in line][0]
    assert "event_day" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_run_with_rolled_records_gives_the_same_tables(spark, tmp_path):
    steps = {}
    for rolled in (False, True):
        house = daily.Warehouse(spark, f"{tmp_path}/{rolled}")
        results = frames.matches(spark, *[{"event_key": n, "event_date": day_of(-n), "first_player_key": 10 + n % 3} for n in range(12)])
        at = dt.datetime(2024, 3, 15)
        daily.load_results(house, results, AS_OF - 14 * DAY, AS_OF, at)
        daily.load_snapshot(house, "fixtures_for_today", frames.fixtures(spark, {}, {"first_player_key": 11}), at)
        for name, schema in (("h2h_for_today2", schemas.H2H_FOR_TODAY), ("tournaments", schemas.TOURNAMENTS),
                             ("standings", schemas.STANDINGS), ("odds_for_today", schemas.ODDS_FOR_TODAY)):
            house.snapshot(name).replace(spark.createDataFrame([], schema))
        done = daily.refresh_tables(house, AS_OF, at, rolled)
        assert [s.ok for s in done] == [True] * 3, done
        steps[rolled] = [rows(house.snapshot(n).read()) for n in ("stg_players_results_by_sourface", "stg_players_results_all")]
    assert steps[True] == steps[False] and steps[True][1]
