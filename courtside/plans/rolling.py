"""Player records that follow the history day by day instead of reading a year on every run.

Kept on storage: the countable matches of each day of the window in narrow form, sums per
player, tournament and day, and the sums over the window. A run reads days of the history
only where they are new to the window or have changed, and moves the window's sums by the
difference. Everything is integer counts, so nothing drifts.

Sums per day hold only events with one row in the whole window. Of the others (downloads that
lie on several days, or name other players) the row that counts depends on the players asked
for and on the window; these are kept as rows and go through the plain computation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions import labels
from courtside.operators import players, records
from courtside.operators.dedup import keep_one
from courtside.sources.tables import DAY, VersionedTable, drop_folder, read_or_empty

_ROW = "event_key long, download_time timestamp, first_player_key long, second_player_key long, event_winner string, tournament_key long"
_SUM = "player_id long, tournament_key long, games long, wins long, losses long, other long"
_COUNTS = ["games", "wins", "losses", "other"]
_DAYS = f"{DAY} date, rows_version long, sums_version long, as_of date, source long"


def _schema(fields: str, *more: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join([fields, *more]))


def _on(days: Iterable[dt.date]):
    """A filter for these days, as a range where they are one."""
    days = sorted(days)
    if days and (days[-1] - days[0]).days == len(days) - 1:
        return F.col(DAY).between(F.lit(days[0]), F.lit(days[-1]))
    return F.col(DAY).isin(days)


def day_rows(results: DataFrame, days: Iterable[dt.date]) -> DataFrame:
    """The countable matches of the given days: of each event and pair of players the first
    download of a day, which is all that a later choice among downloads can ask for."""
    dated = results if DAY in results.columns else results.withColumn(DAY, labels.match_day(results))
    countable = dated.filter(
        _on(days) & labels.is_finished(F.col("event_status")) & labels.not_exhibition(F.col("event_type_type"))
    ).select(DAY, *[F.col(f.name).cast(f.dataType) for f in _schema(_ROW)])
    keys = [DAY, "event_key", "first_player_key", "second_player_key"]
    return keep_one(countable, keys, "download_time", ["event_winner", "tournament_key"])


def split_events(rows: DataFrame, elsewhere: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of events that have no other row, here or ``elsewhere``, and all the other rows.
    A null event counts with the latter; it takes part in no join."""
    named = rows.filter(F.col("event_key").isNotNull())
    counts = named.groupBy("event_key").agg(F.count(F.lit(1)).alias("n"))
    known = elsewhere.select("event_key").join(counts.select("event_key"), "event_key", "left_semi")
    several = counts.filter("n > 1").select("event_key").unionByName(known).distinct()
    single = named.join(several, "event_key", "left_anti")
    return single, named.join(several, "event_key", "left_semi").unionByName(rows.filter(F.col("event_key").isNull()))


def day_sums(single: DataFrame) -> DataFrame:
    """Counts per day, player and tournament, of all players."""
    known = single.withColumns({
        "first_known": F.col("first_player_key").isNotNull(), "second_known": F.col("second_player_key").isNotNull()})
    return records.player_totals(players.player_match_rows(known, DAY), DAY)


def moved_sums(total: DataFrame, added: DataFrame, dropped: DataFrame) -> DataFrame:
    """The window's sums after some days' sums were added and others dropped."""
    taken = dropped.withColumns({c: -F.col(c) for c in _COUNTS})
    change = added.unionByName(taken).select(*total.columns)
    summed = total.unionByName(change).groupBy("player_id", "tournament_key").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return summed.filter("games <> 0")


@dataclass(frozen=True)
class _State:
    """Which run wrote what is kept of each day of the window."""

    rows: Mapping[dt.date, int]
    sums: Mapping[dt.date, int]
    as_of: dt.date | None = None
    source: int = 0


class RolledRecords:
    """The kept sums under one folder. A run writes what it changes under its own number and
    commits it by the window's sums, written last; until then readers see the state before,
    and a run that failed is simply run again. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, days: int = 365):
        self.spark, self.root, self.span = spark, root.rstrip("/"), days
        self.total = VersionedTable(spark, f"{self.root}/total", _schema(_SUM))

    def _path(self, part: str, version: int) -> str:
        return f"{self.root}/{part}/version={version}"

    def state(self) -> _State:
        """Read from one row per day of the window."""
        version = self.total.version()
        if not version:
            return _State({}, {})
        kept = self.spark.read.schema(_schema(_DAYS)).parquet(self._path("days", version)).collect()
        rows, sums = {r[DAY]: r.rows_version for r in kept}, {r[DAY]: r.sums_version for r in kept}
        return _State(rows, sums, kept[0].as_of, kept[0].source)

    def _kept(self, part: str, fields: str, versions: Mapping[dt.date, int]) -> DataFrame:
        """The given days, each as its run wrote it. Only folders of these runs are opened, and
        only row groups that hold such days."""
        schema = _schema(fields, f"{DAY} date", "version long")
        by_run: dict[int, list[dt.date]] = {}
        for day, version in versions.items():
            by_run.setdefault(version, []).append(day)
        wanted = F.lit(False)
        for version, days in by_run.items():
            wanted = wanted | ((F.col("version") == version) & _on(days))
        return read_or_empty(self.spark, f"{self.root}/{part}", schema).filter(wanted).drop("version")

    def _write_days(self, part: str, rows: DataFrame, version: int) -> None:
        # Sorted files instead of a folder per day: a first run would write a file for each.
        dealt = rows.hint("rebalance", DAY).sortWithinPartitions(DAY)
        dealt.write.mode("overwrite").parquet(self._path(part, version))

    def advance(self, results: DataFrame, changed: Iterable[dt.date], as_of: dt.date, source: int = 0) -> list[dt.date]:
        """Brings the sums to the window that ends at ``as_of``, given the days of ``results`` whose
        rows may differ from the last run's. Days that enter the window are read as well.
        ``source`` is kept for the caller. Returns the days that were read from ``results``.

        The day lists are bounded by the window. Of the other days the run scans one column,
        the kept event keys, to find days that share an event with a day that was read.
        """
        old, version = self.state(), self.total.version() + 1
        window = {as_of - dt.timedelta(days=i) for i in range(self.span + 1)}
        fresh = (window & set(changed)) | (window - old.rows.keys())
        if not fresh and as_of == old.as_of and source == old.source:
            return []
        self._write_days("rows", day_rows(results, fresh), version)
        read = self._kept("rows", _ROW, dict.fromkeys(fresh, version))

        rest = {d: v for d, v in old.rows.items() if d in window - fresh}
        replaced = self._kept("rows", _ROW, {d: v for d, v in old.rows.items() if d in fresh})
        events = read.select("event_key").unionByName(replaced.select("event_key")).dropna().distinct()
        shared = self._kept("rows", _ROW, rest).join(events, "event_key", "left_semi").select(DAY).distinct() if rest else None
        again = {r[DAY] for r in shared.collect()} if shared is not None else set()

        touched = fresh | again
        untouched = {d: v for d, v in rest.items() if d not in again}
        rows = read.unionByName(self._kept("rows", _ROW, {d: rest[d] for d in again}))
        single, several = split_events(rows, self._kept("rows", _ROW, untouched))
        self._write_days("sums", day_sums(single), version)
        several = several.unionByName(self.several(self.total.version()).filter(_on(untouched)))
        several.select(*_schema(_ROW, f"{DAY} date").names).write.mode("overwrite").parquet(self._path("several", version))

        gone = {d: v for d, v in old.sums.items() if d in touched or d not in window}
        sums = {**{d: old.sums[d] for d in untouched}, **dict.fromkeys(touched, version)}
        listed = [(d, rest.get(d, version), sums[d], as_of, source) for d in sorted(window)]
        days = self.spark.createDataFrame(listed, _schema(_DAYS))
        days.coalesce(1).write.mode("overwrite").parquet(self._path("days", version))
        self.total.replace(moved_sums(
            self.total.read(), self._kept("sums", _SUM, dict.fromkeys(touched, version)), self._kept("sums", _SUM, gone)))
        return sorted(fresh)

    def several(self, version: int) -> DataFrame:
        """Rows of events that the sums leave out."""
        schema = _schema(_ROW, f"{DAY} date")
        return read_or_empty(self.spark, self._path("several", version), schema)

    def player_totals(self, universe: DataFrame) -> DataFrame:
        """Counts per player and tournament for the players of the universe: what
        ``jobs.player_totals`` computes from a year of history. A player's counts of a tournament
        may come in two rows, of which the records are sums."""
        known = universe.select("player_id").dropna().distinct()
        summed = self.total.read().join(known, "player_id", "left_semi")
        chosen = players.first_downloads(self.several(self.total.version()), universe)
        return summed.unionByName(records.player_totals(players.player_match_rows(chosen)))

    def expire(self) -> list[int]:
        """Deletes what no day of the window refers to any more, and returns the numbers of the
        runs whose kept rows went. Readers may not hold an older state then."""
        state, newest = self.state(), self.total.version()
        dropped = []
        for version in range(1, newest):
            for part, used in (("rows", state.rows), ("sums", state.sums), ("days", {}), ("several", {})):
                if version not in used.values() and drop_folder(self.spark, self._path(part, version)) and part == "rows":
                    dropped.append(version)
        self.total.expire(1)
        return dropped
