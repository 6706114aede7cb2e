"""Tables at rest: whole-table versions, day-partitioned history, append logs, SQL.

Parquet on shared storage. Nothing is deleted before its replacement is complete.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions.numbers import nan_to_null


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored table; no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Deletes a folder on whatever storage it lies; false if there was none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class VersionedTable:
    """A table replaced as a whole. Each load writes a directory of its own, then adds
    one row to a small commit log; readers follow the log, so they see the old table or
    the new one and a failed load changes nothing. One writer at a time."""

    _LOG = T.StructType([T.StructField("version", T.LongType()), T.StructField("rows", T.LongType())])

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _data(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def version(self) -> int:
        """Number of the committed version, 0 before the first."""
        log = read_or_empty(self.spark, f"{self.path}/commits", self._LOG)
        return log.agg(F.max("version")).first()[0] or 0

    def read(self) -> DataFrame:
        version = self.version()
        if version:
            reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
            return reader.parquet(self._data(version))
        if self.schema is None:
            raise ValueError(f"{self.path} has no version yet and no schema was given")
        return self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, keep_if_empty: bool = False) -> int:
        """Writes the rows as the new version and returns their number. With
        ``keep_if_empty`` an empty load is not committed: the old rows stay."""
        version = self.version() + 1
        rows.write.mode("overwrite").parquet(self._data(version))
        # From the file footers of what was written, not a second run of the job.
        count = self.spark.read.schema(rows.schema).parquet(self._data(version)).count()
        if count or not keep_if_empty:
            entry = self.spark.createDataFrame([(version, count)], self._LOG)
            entry.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return count

    def expire(self, keep: int) -> list[int]:
        """Deletes the folders below the newest ``keep`` committed versions, those of empty
        loads included, and returns their numbers. Never called by a load: readers may
        still hold an older version."""
        if keep < 1:
            raise ValueError("the newest version has to stay")
        log = read_or_empty(self.spark, f"{self.path}/commits", self._LOG)
        newest = [r.version for r in log.select("version").distinct().orderBy(F.desc("version")).limit(keep).collect()]
        old = range(1, min(newest)) if len(newest) == keep else range(0)
        return [v for v in old if drop_folder(self.spark, self._data(v))]


DAY = "event_day"


def _with_day(schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != DAY] + [T.StructField(DAY, T.DateType())])


def read_days(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A history table partitioned by ``event_day``, the day of ``event_date``. Filters
    on ``event_day`` prune partitions. The marker rows of emptied days are left out.

    Days that are staged but not yet published are read from their staged copy, so a
    change shows as a whole from the moment it is logged."""
    table = read_or_empty(spark, path, _with_day(schema))
    version, published = _staged_versions(spark, path)
    if version > published:
        staged = _staged(spark, path, version, schema)
        days = staged.select(F.col(DAY).alias("day")).distinct()
        table = table.join(days, F.col(DAY).eqNullSafe(F.col("day")), "left_anti").unionByName(staged)
    return table.filter(F.col(DAY).isNull() | F.col("event_date").isNotNull())


def has_days(spark: SparkSession, path: str) -> bool:
    """Whether anything was ever written there."""
    return _staged_versions(spark, path)[0] > 0


_STAGE_LOG = T.StructType([T.StructField("version", T.LongType()), T.StructField("published", T.BooleanType())])


def _staged_versions(spark: SparkSession, path: str) -> tuple[int, int]:
    """The newest staged version and the newest published one, 0 for none."""
    log = read_or_empty(spark, f"{path}_staged/log", _STAGE_LOG)
    row = log.agg(F.max("version").alias("staged"), F.max(F.when(F.col("published"), F.col("version"))).alias("published")).first()
    return row.staged or 0, row.published or 0


def changed_days(spark: SparkSession, path: str, since: int) -> tuple[list[dt.date], int]:
    """The days that were replaced after the given staged version, and the newest version: from the
    staged copies, which hold whole days and a marker for an emptied one. The list is bounded by the
    calendar; days of unusable dates are left out."""
    newest = _staged_versions(spark, path)[0]
    if newest <= since:
        return [], newest
    copies = [f"{path}_staged/version={v}" for v in range(since + 1, newest + 1)]
    days = spark.read.schema(f"{DAY} date").parquet(*copies).dropna().distinct().collect()
    return sorted(r[DAY] for r in days), newest


def _log_stage(spark: SparkSession, path: str, version: int, published: bool) -> None:
    entry = spark.createDataFrame([(version, published)], _STAGE_LOG)
    entry.coalesce(1).write.mode("append").parquet(f"{path}_staged/log")


def _staged(spark: SparkSession, path: str, version: int, schema: T.StructType) -> DataFrame:
    return spark.read.schema(_with_day(schema)).parquet(f"{path}_staged/version={version}")


def publish_days(spark: SparkSession, path: str, schema: T.StructType) -> bool:
    """Writes the logged but unpublished days, if any, into the table. Safe to repeat: the
    staged copy is complete and is not read from the table it replaces."""
    version, published = _staged_versions(spark, path)
    if version == published:
        return False
    rows = _staged(spark, path, version, schema)
    # Rebalancing by day gives few files per day and still splits a very large day.
    writer = rows.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    _log_stage(spark, path, version, True)
    return True


def _switch_days(spark: SparkSession, path: str, schema: T.StructType, version: int) -> None:
    """Replaces the days that a staged copy holds: logged (from here on readers see them), then
    published. A run that stops in between is completed by the next one."""
    _log_stage(spark, path, version, False)
    publish_days(spark, path, schema)


def _day_markers(spark: SparkSession, days: DataFrame, schema: T.StructType) -> DataFrame:
    """A row per day holding nothing but the day: overwriting partition by partition
    touches only days that have rows, and these make an emptied day one of them."""
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != DAY]
    return days.select(*blank, F.col("day").alias(DAY))


def replace_days(spark: SparkSession, path: str, rows: DataFrame, start: dt.date, stop: dt.date) -> int:
    """Replaces the days from start to stop by a load; other days are not touched.

    An empty load changes nothing. Rows the load has outside its own range are added to
    their days, as nothing of theirs was deleted; all of it shows at once. The load is
    computed and staged once; what the staged copy needs besides is added to it before it is
    logged, and until then nobody reads it. Returns its rows.
    """
    schema = rows.schema
    publish_days(spark, path, schema)
    version = _staged_versions(spark, path)[0] + 1
    copy = f"{path}_staged/version={version}"
    rows.withColumn(DAY, F.to_date("event_date")).write.mode("overwrite").parquet(copy)
    load = _staged(spark, path, version, schema)
    inside = F.coalesce(F.col(DAY).between(F.lit(start), F.lit(stop)), F.lit(False))
    counts = load.agg(F.count(F.lit(1)).alias("all"), F.count_if(~inside).alias("outside")).first()
    if not counts["all"]:
        return 0
    span = spark.range((stop - start).days + 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    added = _day_markers(spark, span.coalesce(1), load.schema)
    if counts["outside"]:
        others = load.filter(~inside).select(F.col(DAY).alias("day")).distinct()
        kept = read_days(spark, path, schema).join(others, F.col(DAY).eqNullSafe(F.col("day")), "left_semi")
        added = added.unionByName(kept)
    added.select(*load.columns).write.mode("append").parquet(copy)
    _switch_days(spark, path, schema, version)
    return counts["all"]


def overwrite_days(spark: SparkSession, path: str, rows: DataFrame, days: Sequence[dt.date]) -> None:
    """Replaces exactly the given days by the given rows of those days."""
    publish_days(spark, path, rows.schema)
    listed = spark.createDataFrame([(d,) for d in days], "day date")
    rows = rows.withColumn(DAY, F.to_date("event_date"))
    version = _staged_versions(spark, path)[0] + 1
    staged = rows.unionByName(_day_markers(spark, listed, rows.schema))
    staged.write.mode("overwrite").parquet(f"{path}_staged/version={version}")
    _switch_days(spark, path, staged.schema, version)


def replace_range(current: DataFrame, rows: DataFrame, start: dt.date, stop: dt.date) -> DataFrame:
    """The same policy as a plain DataFrame step: current rows outside the range plus
    the load; an empty load (asked of the data) leaves the current rows."""
    if rows.isEmpty():
        return current
    inside = F.to_date("event_date").between(F.lit(start), F.lit(stop))
    kept = current.filter(~F.coalesce(inside, F.lit(False)))
    return kept.unionByName(rows.select(*current.columns))


def _without_nan(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def append_rows(rows: DataFrame, path: str) -> int:
    """Appends in one job commit, NaN as null. Returns the rows, counted on the way."""
    seen = Observation()
    _without_nan(rows).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return seen.get["rows"]


def ensure_table(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """The catalog table, created empty when there is none."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name)
    return spark.table(name)


def create_table_as(rows: DataFrame, name: str) -> None:
    """Drops and creates a catalog table."""
    rows.write.mode("overwrite").saveAsTable(name)


def write_bucketed(rows: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A catalog table with its rows dealt and sorted by the keys, so that joins and groupings by
    them need no shuffle. Tables that are to be joined take the same number of buckets: about
    as many as the larger one fills with files of a few hundred MB. The rows move once, here."""
    dealt = rows.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return rows.sparkSession.table(name)


def max_event_date(matches: DataFrame) -> DataFrame:
    """Highest date text, in text order."""
    return matches.agg(F.max("event_date").alias("max_event_date"))


def newest_day(spark: SparkSession, path: str, schema: T.StructType) -> dt.date | None:
    """The newest day that a stored history has a folder for: from the listing of its files,
    no file is opened. Days staged but not yet published count."""
    version, published = _staged_versions(spark, path)
    found = re.findall(rf"/{DAY}=(\d+-\d\d-\d\d)/", "\n".join(read_or_empty(spark, path, _with_day(schema)).inputFiles()))
    days = [dt.date.fromisoformat(max(found))] if found else []
    if version > published:
        days += [d for d in _staged(spark, path, version, schema).agg(F.max(DAY)).first() if d]
    return max(days, default=None)


def high_water(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The highest date text of a stored history, read from its newest day and the rows
    without a day alone. Days rule: of texts that name other days than their order
    suggests (unpadded ones) those of the newest day count. Should the newest day be
    empty, all days are read."""
    newest = newest_day(spark, path, schema)
    table = read_days(spark, path, schema)
    top = max_event_date(table.filter(F.col(DAY).isNull() | (F.col(DAY) == F.lit(newest))))
    emptied = newest is None or table.filter(F.col(DAY) == F.lit(newest)).isEmpty()
    return max_event_date(table) if emptied else top


def run_sql(spark: SparkSession, text: str, params: Sequence | None = None) -> DataFrame:
    """One statement with positional ``?`` parameters."""
    if text.isspace() or not text:
        raise ValueError("no statement to run")
    return spark.sql(text, args=list(params) if params else None)


def run_sql_file(spark: SparkSession, path: str, params: Sequence | None = None) -> DataFrame:
    """The statement of a SQL file, read through Spark so that any storage works."""
    return run_sql(spark, spark.read.text(path, wholetext=True).first()[0], params)


def default_now(at: dt.datetime | None) -> Column:
    return F.current_timestamp() if at is None else F.lit(at)
