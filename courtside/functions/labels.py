"""Text labels and predicates over match columns. Column in, Column out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.numbers import to_number

# Fixed values.
FINISHED_STATUSES = ["Finished", "Retired", "Awarded", "Walk Over"]
NO_BET = "Sin apuesta"
UNKNOWN = "unkn"
TRUE_WORDS = ["1", "true", "t", "yes", "y"]
FALSE_WORDS = ["0", "false", "f", "no", "n"]


def match_day(matches: DataFrame) -> Column:
    """Day of a match: the stored ``event_day`` when the table has one, so that the
    scan can prune on it, else the date text. A malformed text fails the job."""
    return F.col("event_day") if "event_day" in matches.columns else F.to_date("event_date")


def lenient_day(date_text: Column) -> Column:
    """Dashboard reading of a date text: malformed is null."""
    return date_text.try_cast("date")


def is_finished(status: Column) -> Column:
    return status.isin(FINISHED_STATUSES)


def not_exhibition(event_type: Column) -> Column:
    """A null type gives null, so a filter drops the row."""
    return ~F.lower(event_type).contains("exhibition")


def within_trailing_days(day: Column, as_of: dt.date, days: int = 365) -> Column:
    """Both ends included."""
    return day.between(F.lit(as_of - dt.timedelta(days=days)), F.lit(as_of))


def winner_key(winner: Column, first_key: Column, second_key: Column) -> Column:
    return F.when(winner == "First Player", first_key).when(winner == "Second Player", second_key)


def player_position(player: Column, first_key: Column, second_key: Column) -> Column:
    return F.when(first_key == player, "first").when(second_key == player, "second")


def status_label(status: Column) -> Column:
    return (
        F.when(is_finished(status), "Finished")
        .when(status.startswith("Set"), "In progress")
        .when(status.isin("Cancelled", "Interrupted"), status)
        .otherwise("Not yet started")
    )


def winner_label(winner: Column) -> Column:
    return F.when(winner == "First Player", "P1").when(winner == "Second Player", "P2").otherwise(winner)


def event_kind(event_type: Column) -> Column:
    return (
        F.when(event_type.contains("Singles"), "Singles")
        .when(event_type.contains("Doubles"), "Doubles")
        .otherwise(UNKNOWN)
    )


def _without(text: Column, *parts: str) -> Column:
    for part in parts:
        text = F.replace(text, F.lit(part), F.lit(""))
    return F.trim(text)


def event_subtype(event_type: Column) -> Column:
    return _without(event_type, " Singles", " Doubles", "-")


def event_family(event_type: Column) -> Column:
    return _without(event_type, " Singles", " Doubles", "-", "Men", "Women")


def gender_label(event_type: Column) -> Column:
    return (
        F.when(event_type.contains("Men") | event_type.contains("Atp"), "Men")
        .when(event_type.contains("Women") | event_type.contains("Wta"), "Women")
        .otherwise(UNKNOWN)
    )


def capitalize_words(text: Column) -> Column:
    """Capital after every character that is neither letter nor digit (Spark's own
    ``initcap`` only looks at blanks). Meant for dimension tables."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), w.substr(F.lit(2), F.length(w)))),
        "",
    )


def surface_label(surface: Column) -> Column:
    plain = capitalize_words(F.replace(surface, F.lit(" (Indoor)"), F.lit("")))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit(UNKNOWN))


def flag_to_binary(flag: Column) -> Column:
    """1, 0 or null for flags of any type. A number counts by its whole part (1.9 is 1);
    words count by list; anything else, NaN and infinity included, is null."""
    text = F.lower(F.trim(flag.cast("string")))
    number = to_number(flag)
    return (
        F.when(F.abs(number) < float("inf"), F.when((number >= 1) & (number < 2), 1).otherwise(0))
        .when(text.isin(TRUE_WORDS), 1)
        .when(text.isin(FALSE_WORDS), 0)
    )
