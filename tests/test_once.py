"""A refresh moves its rows no more often than it has to."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import frames
from courtside import schemas
from courtside.plans import daily
from courtside.sources import tables

D = dt.date


def pull(spark, *data):
    return frames.matches(spark, *[{"event_key": k, "event_date": d} for k, d in data])


def test_a_load_is_staged_once(spark, tmp_path):
    path = str(tmp_path / "results")
    tables.replace_days(spark, path, pull(spark, (1, "2024-03-01"), (2, "2024-02-01")), D(2024, 3, 1), D(2024, 3, 2))
    tables.replace_days(spark, path, pull(spark, (3, "2024-03-01"), (4, "2024-02-01"), (5, None)), D(2024, 3, 1), D(2024, 3, 2))
    assert sorted(p.name for p in Path(f"{path}_staged").iterdir()) == ["log", "version=1", "version=2"]
    staged = spark.read.parquet(f"{path}_staged/version=2")
    # The load, the kept row of a day it adds to, and a marker for each day of the range.
    assert sorted(r.event_key or 0 for r in staged.collect()) == [0, 0, 2, 3, 4, 5]
    stored = tables.read_days(spark, path, schemas.FIXTURES_RESULTS)
    assert sorted(r.event_key for r in stored.collect()) == [2, 3, 4, 5]
    assert tables.changed_days(spark, path, 1) == ([D(2024, 2, 1), D(2024, 3, 1), D(2024, 3, 2)], 2)


def test_an_empty_load_leaves_nothing_for_the_next(spark, tmp_path):
    path = str(tmp_path / "results")
    tables.replace_days(spark, path, pull(spark, (1, "2024-03-01")), D(2024, 3, 1), D(2024, 3, 1))
    assert tables.replace_days(spark, path, pull(spark), D(2024, 3, 1), D(2024, 3, 1)) == 0
    assert tables.replace_days(spark, path, pull(spark, (2, "2024-03-02")), D(2024, 3, 2), D(2024, 3, 2)) == 1
    assert sorted(r.event_key for r in tables.read_days(spark, path, schemas.FIXTURES_RESULTS).collect()) == [1, 2]


def test_sources_are_opened_once(spark, tmp_path, monkeypatch):
    opened = []
    house = daily.Warehouse(spark, str(tmp_path / "house"))
    results = daily.Warehouse.results
    monkeypatch.setattr(daily.Warehouse, "results", lambda self: opened.append(1) or results(self))
    steps = daily.refresh_tables(house, D(2024, 3, 1), dt.datetime(2024, 3, 1, 9))
    assert [s.ok for s in steps] == [True] * 3 and len(opened) == 1


def test_rows_of_many_tasks_are_not_dealt_anew(spark, tmp_path, monkeypatch):
    house = daily.Warehouse(spark, str(tmp_path / "house"))
    frames.matches(spark, *[{"event_key": i} for i in range(40)]).repartition(4).write.parquet(str(tmp_path / "in"))
    plans, replace = [], tables.VersionedTable.replace

    def noted(self, rows, keep_if_empty=False):
        plans.append(rows._jdf.queryExecution().toString())
        return replace(self, rows, keep_if_empty)

    monkeypatch.setattr(tables.VersionedTable, "replace", noted)
    assert daily.load_snapshot(house, "h2h_for_today2", spark.read.parquet(str(tmp_path / "in")), dt.datetime(2024, 3, 1, 9)) == 40
    assert "Exchange" not in plans[0]
