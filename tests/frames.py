"""Small hand-made frames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from courtside import schemas

AS_OF = dt.date(2024, 3, 15)
BASE = {
    "event_key": 1, "event_date": "2024-03-01", "event_time": "10:00",
    "event_first_player": "A", "first_player_key": 10, "event_second_player": "B", "second_player_key": 20,
    "event_winner": "First Player", "event_status": "Finished", "event_type_type": "Atp Singles",
    "tournament_name": "Open", "tournament_key": 7, "download_time": dt.datetime(2024, 3, 2),
}


def matches(spark, *rows, schema=schemas.FIXTURES_RESULTS):
    full = [{**BASE, **row} for row in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in full], schema)


def fixtures(spark, *rows):
    return matches(spark, *rows, schema=schemas.FIXTURES_FOR_TODAY)


def tournaments(spark, *rows):
    return spark.createDataFrame([(k, s) for k, s in rows], "tournament_key bigint, tournament_sourface string")


def standings(spark, *rows):
    return spark.createDataFrame(list(rows), "player_key bigint, points string")


def rows(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def one(spark, function, value, kind="string"):
    """What a column function makes of one value."""
    return spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x")).alias("y")).first().y
