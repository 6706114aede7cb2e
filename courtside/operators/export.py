"""Formatted exports of the per-match table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import formats
from courtside.operators import filters
from courtside.operators.mart import TIE_BREAKERS

# Which columns take which format.
PERCENT_COLUMNS = ["p1_perc_h2h", "p2_perc_h2h", "p1_rend_all", "p1_rend_sup", "p2_rend_all", "p2_rend_sup"]
ODDS_COLUMNS = ["p1_odds", "p2_odds"]
DATE_COLUMNS = ["event_date", "event_date_only"]
EXPORT_ORDER = ["tournament_name", "event_time"]


def _formatted(df: DataFrame, by_columns: list[tuple[Sequence[str], object]]) -> DataFrame:
    changes = {c: change(F.col(c)) for columns, change in by_columns for c in filters.present(df, columns)}
    return df.withColumns(changes) if changes else df


def spanish_table(df: DataFrame) -> DataFrame:
    """Dates, percentages and odds as Spanish text."""
    return _formatted(df, [
        (DATE_COLUMNS, formats.spanish_date),
        (PERCENT_COLUMNS, formats.spanish_percent),
        (ODDS_COLUMNS, formats.spanish_number),
    ])


def export_table(df: DataFrame, columns: Sequence[str] = tuple(filters.TABLE_COLUMNS), spanish: bool = True) -> DataFrame:
    """Rows by tournament and time, which need not be among the columns shown."""
    keys = filters.present(df, EXPORT_ORDER)
    ordered = df.orderBy(*[F.asc_nulls_last(c) for c in keys + filters.present(df, TIE_BREAKERS)]) if keys else df
    return shown(ordered, columns, spanish)


def shown(df: DataFrame, columns: Sequence[str] = tuple(filters.TABLE_COLUMNS), spanish: bool = True) -> DataFrame:
    """The columns of the export in the rows' given order."""
    kept = df.select(*filters.present(df, columns))
    return spanish_table(kept) if spanish else kept


def write_csv(table: DataFrame, path: str) -> None:
    """Quoted CSV with a header, UTF-8, one part file per sorted range."""
    writer = table.write.mode("overwrite").option("header", True)
    writer.option("quoteAll", True).option("escape", '"').csv(path)


def tsv_line(df: DataFrame, with_odds: bool = False) -> Column:
    """A row as tab-joined text; nulls show as ``-`` so that columns stay in place."""
    formatters = {c: formats.percent_or_mark for c in PERCENT_COLUMNS}
    formatters.update({c: formats.odds_or_mark for c in ODDS_COLUMNS})
    formatters["event_date"] = lambda c: formats.text_or_mark(formats.spanish_date(c))
    columns = filters.row_columns(df, with_odds)
    return F.concat_ws("\t", *[formatters.get(c, formats.text_or_mark)(F.col(c)) for c in columns])


def match_label(df: DataFrame) -> Column:
    """``date | first vs second | tournament``."""
    date, first, second, tournament = (
        formats.text_or_mark(F.col(c))
        for c in ("event_date", "event_first_player", "event_second_player", "tournament_name")
    )
    bar = F.lit(" | ")
    return F.concat(date, bar, first, F.lit(" vs "), second, bar, tournament)
