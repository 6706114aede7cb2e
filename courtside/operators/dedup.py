"""Keep one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_one(
    df: DataFrame, keys: list[str], by: str, ties: list[str], keep: str = "first"
) -> DataFrame:
    """The first (or last) row per key in the order of ``by``, nulls last.

    ``ties`` makes the choice the same on every run. It should hold just the columns
    the caller uses: every column named here has to be read and shuffled.
    Spark trims each key to one row before the shuffle (``WindowGroupLimit``), so a
    key with many copies does not pile up in one task.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    lead = F.col(by).asc_nulls_last() if keep == "first" else F.col(by).desc_nulls_last()
    order = Window.partitionBy(*keys).orderBy(lead, *[F.col(c).asc_nulls_last() for c in ties])
    return df.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
