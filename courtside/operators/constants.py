"""Profiles of model constants: an append-only log, read by its latest rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.schemas import CONSTANTS

NAME, TIME = "nombre_constante", "inserted_at"


def constants_row(spark: SparkSession, values: dict, inserted_at: dt.datetime | None = None) -> DataFrame:
    """One log row; constants that are not given are null."""
    unknown = set(values) - set(CONSTANTS.names)
    if unknown:
        raise ValueError("no such constants: " + ", ".join(sorted(unknown)))
    row = {**values, TIME: inserted_at or dt.datetime.now(dt.timezone.utc)}
    return spark.createDataFrame([tuple(row.get(name) for name in CONSTANTS.names)], CONSTANTS)


def latest_constants(log: DataFrame) -> DataFrame:
    """Current values per profile: its latest row (equal times go by the values).
    An aggregate, so that a profile with a long log is combined before the shuffle."""
    rest = [c for c in log.columns if c not in (NAME, TIME)]
    newest = log.groupBy(NAME).agg(F.max(F.struct(TIME, *rest)).alias("newest"))
    return newest.select(NAME, "newest.*").select(*log.columns)


def profile_names(log: DataFrame) -> DataFrame:
    """Distinct names as first logged, ``default`` leading."""
    seen = log.dropna(subset=[NAME]).groupBy(NAME).agg(F.min(TIME).alias("first_seen"))
    return seen.orderBy(F.col(NAME) != "default", F.asc_nulls_last("first_seen"), NAME)
