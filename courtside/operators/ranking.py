"""Places of rows in an order, without a window over a group.

A window that numbers the rows of a day or a tournament brings each group into one task, so a
group with a third of the rows is one task's work. Here the rows are sorted once, over all
tasks, and only counts per task and group are added up.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs (a group's rows in one task) that are sent to all tasks; more of them are joined instead.
SENT_RUNS = 1 << 17


def _checkpoints(spark: SparkSession) -> None:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one in the warehouse, which
    is shared as well, where none is named."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def _written(df: DataFrame) -> DataFrame:
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, group: str, order: Sequence[str], column: str = "place", sent_runs: int = SENT_RUNS) -> DataFrame:
    """The rows sorted by ``group`` and then ``order`` (nulls last), with each row's place within
    its group, from 1 on. Nulls are a group; equal rows get places of their own. Ends the order
    with unique keys, or a group of equal rows cannot be split.

    The rows are written first, so that the sampling of the sort does not compute them twice. One
    range exchange; the sorted rows are checkpointed, since an exchange computed anew may cut
    elsewhere. A row's place is its number in its task, less that of its group's first
    row there, plus the group's rows in earlier tasks.
    """
    _checkpoints(df.sparkSession)
    df = _written(df)
    keys = [F.asc_nulls_last(c) for c in (group, *order)]
    # The number of the row's task is in the upper bits, that within the task in the lower 33.
    rows = df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=False)
    task = F.shiftright("_at", 33).cast("int")
    runs = rows.groupBy(task.alias("_task"), F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_task", "_group", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    known = runs.limit(sent_runs + 1).collect()  # this job also keeps the sorted rows
    few = len(known) <= sent_runs
    runs = df.sparkSession.createDataFrame(known, runs.schema) if few else runs
    joined = rows.withColumn("_of", task).join(
        F.broadcast(runs) if few else runs, (F.col("_of") == F.col("_task")) & F.col(group).eqNullSafe(F.col("_group")))
    placed = joined.withColumn(column, (F.col("_at") + F.col("_shift")).cast("int"))
    placed = placed if few else placed.orderBy("_at")  # a shuffled join loses the order
    return placed.select(*df.columns, column)
