"""Places over tasks, choices in one scan, the newest day from the listing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from courtside import schemas
from courtside.operators import facets, filters, ranking
from courtside.sources import tables
from courtside.sources.derived import StarTables
from test_dashboard import NONE, mart
from test_round2 import pull

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sent_runs", [1 << 17, 2])
def test_places_in_order(spark, sent_runs):
    """A third of the rows in one group, null groups and keys, equal rows; both joins."""
    data = [(None if i % 7 == 0 else "hot" if i % 3 == 0 else f"g{i % 5}", None if i % 11 == 0 else i % 13, i // 2) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, k int, id int").repartition(5)
    got = [tuple(r) for r in ranking.in_order(df, "g", ["k", "id"], sent_runs=sent_runs).collect()]
    low = lambda x: (x is None, x if x is not None else 0)
    want = sorted(data, key=lambda r: ((r[0] is None, r[0] or ""), low(r[1]), r[2]))
    assert [r[:3] for r in got] == want
    places, seen = [], {}
    for g, *_ in want:
        seen[g] = seen.get(g, 0) + 1
        places.append(seen[g])
    assert [r[3] for r in got] == places
    assert ranking.in_order(df.limit(0), "g", ["k"]).count() == 0


def test_no_window_over_the_rows(spark):
    rows = spark.range(10_000).withColumn("g", F.lit("one"))
    plan = ranking.in_order(rows, "g", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_all_choices_equal_the_lists(spark):
    df = mart(
        spark, {"tournament_name": "B"}, {"tournament_name": "A", "tournament_sourface": "Clay"}, {"event_gender": None},
        {"tournament_name": None}, {"tournament_name": "C", "event_type": "Doubles", "event_date": "bad"}, {"event_date": "2024-03-14"},
    ).withColumn("jugador_a_apostar_cons", F.when(F.col("tournament_name") == "B", NONE).otherwise("A"))

    def same(choices, lists):
        got = {}
        for r in choices.orderBy("facet", "place").collect():
            got.setdefault(r.facet, []).append(r.choice)
        assert got == {c: [str(r[0]) for r in rows.collect()] for c, rows in lists.items() if not rows.isEmpty()}

    for asked in ({}, {"event_types": ["Singles"], "tournaments": ["A"]}, {"days": [dt.date(2024, 3, 15)]}, {"genders": ["Nobody"]}):
        same(facets.match_choices(df, **asked), facets.match_facets(df, **asked))
    for asked in ({}, {"event_day": dt.date(2024, 3, 15), "bets": "Sin apuesta"}, {"event_type": "Doubles", "bets": filters.ALL}):
        same(facets.analysis_choices(df, **asked), facets.analysis_facets(df, **asked))


def test_choices_read_the_rows_once(spark):
    plan = facets.match_choices(StarTables(spark, SF_DIR).analysis.withColumn("event_gender", F.lit("Men")).withColumn("tournament_sourface", F.lit("x")))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_newest_day_opens_no_file(spark, tmp_path):
    path = str(tmp_path / "results")
    assert tables.newest_day(spark, path, schemas.FIXTURES_RESULTS) is None
    load = pull(spark, (1, "2024-03-02"), (3, "2024-03-10"), (4, None))
    tables.replace_days(spark, path, load, dt.date(2024, 3, 1), dt.date(2024, 3, 10))
    for part in (tmp_path / "results" / "event_day=2024-03-10").iterdir():
        part.write_bytes(b"unreadable")
    assert tables.newest_day(spark, path, schemas.FIXTURES_RESULTS) == dt.date(2024, 3, 10)
