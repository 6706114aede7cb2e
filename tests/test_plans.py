"""Shapes of the plans, and the large-table paths: no broadcasts, hot keys."""

import contextlib

import pytest
from pyspark.sql import functions as F

import frames
from compare import differences, duck
from courtside.operators import h2h, players, records
from courtside.plans import jobs
from courtside.plans.oracle import ORACLE_SQL
from courtside.plans.registered import QUERIES
from courtside.sources.derived import AS_OF as RUN_DAY, StarTables
from frames import AS_OF, rows

SF_DIR = "/root/testdata/sf0.001"


def plan(df, extended=False):
    return df._jdf.queryExecution().toString() if extended else df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def settings(spark, **changes):
    names = {k.replace("__", "."): v for k, v in changes.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_and_no_python(spark, name):
    shown = plan(QUERIES[name](spark, SF_DIR))
    for word in ("NestedLoop", "Cartesian", "Python", "Pandas", "Arrow"):
        assert word not in shown


def test_dates_reach_the_scan_and_columns_are_pruned(spark):
    shown = plan(QUERIES["records_all"](spark, SF_DIR))
    scans = [line for line in shown.splitlines() if "FileScan" in line]
    assert scans and all("GreaterThanOrEqual(o_orderdate" in line for line in scans)
    assert all("o_totalprice" not in line for line in scans)


def test_dedup_trims_before_the_shuffle(spark):
    shown = plan(QUERIES["fixtures_dedup_first"](spark, SF_DIR))
    below_exchange = shown[shown.index("hashpartitioning(event_key"):]
    assert shown.count("WindowGroupLimit") == 2 and "WindowGroupLimit" in below_exchange


def test_one_shuffle_for_pivot_and_pairs(spark):
    for name in ("odds_consensus", "h2h_pairs"):
        assert plan(QUERIES[name](spark, SF_DIR)).count("Exchange hashpartitioning") == 1


def test_records_share_their_aggregation(spark):
    by_surface, overall = jobs.player_records(StarTables(spark, SF_DIR).match_tables(), RUN_DAY)
    both = by_surface.select("player_id").unionAll(overall.select("player_id"))
    both.collect()
    assert "ReusedExchange" in plan(both)


@pytest.mark.parametrize("name", ["match_mart", "records_by_surface", "history_merged", "fixtures_dedup_first", "tsv_rows"])
def test_same_rows_without_broadcasts(spark, name):
    with settings(spark, **NO_BROADCAST):
        df = QUERIES[name](spark, SF_DIR)
        assert "Broadcast" not in plan(df)
        assert differences(df, duck(SF_DIR), ORACLE_SQL[name]) is None


def hot_matches(spark, n=60_000):
    """A third of the matches are of player 1; a tenth of the rows are copies of one event."""
    key = F.when(F.col("id") % 10 == 0, 0).otherwise(F.col("id"))
    return spark.range(n).select(
        key.alias("event_key"), F.lit("2024-03-01").alias("event_date"),
        F.timestamp_seconds(F.col("id")).alias("download_time"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).alias("first_player_key"),
        (F.col("id") * 7 % 5000).alias("second_player_key"),
        F.when(F.col("id") % 2 == 0, "First Player").alias("event_winner"),
        F.lit("Finished").alias("event_status"), F.lit("Atp").alias("event_type_type"),
        (F.col("id") % 9).alias("tournament_key"),
    ).repartition(8)


def test_hot_player_is_split_and_counts_stay_whole(spark):
    results = hot_matches(spark)
    known = players.player_universe(
        spark.range(0, 5000, 2).select(F.col("id").alias("first_player_key"), F.lit(1).alias("second_player_key"))
    )
    small = {
        "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
        "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20KB",
    }
    with settings(spark, **NO_BROADCAST, **small):
        totals = records.player_totals(players.player_match_rows(players.countable_matches(results, known, AS_OF)))
        overall = records.records_all(totals, AS_OF)
        got = {r.player_id: (r.total_games_all, r.wins_all, r.losses_all) for r in overall.collect()}
        assert "skew=true" in plan(overall)
    want: dict = {}
    seen = set()
    for i in range(60_000):
        key = 0 if i % 10 == 0 else i
        first, second = 1 if i % 3 == 0 else i % 5000, i * 7 % 5000
        sides = [p for p in dict.fromkeys((first, second)) if p == 1 or p % 2 == 0]
        if not sides or key in seen:
            continue
        seen.add(key)
        for p in sides:
            won = i % 2 == 0 and first == p
            lost = i % 2 == 0 and first != p
            n, w, l = want.get(p, (0, 0, 0))
            want[p] = (n + 1, w + won, l + lost)
    assert got == want


def test_copies_of_one_event_do_not_reach_one_task(spark):
    kept = players.countable_matches(hot_matches(spark), spark.range(5000).toDF("player_id"), AS_OF)
    kept.collect()
    shown = plan(kept)
    assert shown.count("WindowGroupLimit") >= 2
    assert kept.filter("event_key = 0").count() == 1


def test_hot_pair_is_summed_before_the_shuffle(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("first_player_key"),
        F.when(F.col("id") % 3 == 0, 8).otherwise(F.col("id") + 1).alias("second_player_key"),
        F.lit("First Player").alias("event_winner"), F.lit("Atp").alias("event_type_type"),
    )
    pairs = h2h.h2h_pairs(df)
    assert "partial_sum" in plan(pairs)
    assert rows(pairs.filter("first_player_key = 7 and second_player_key = 8"), "total_first_player_key") == [(10_001,)]
