import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from courtside.functions import formats, labels, numbers
from frames import one


@pytest.mark.parametrize("value, want", [
    ("2382", 2382), ("2382.0", 2382), (" 7 ", 7), ("1e3", 1000), ("12.5", None), ("abc", None), ("", None),
    (None, None), ("-4", -4), ("99999999999999999999999", None),
])
def test_ids_from_text(spark, value, want):
    assert one(spark, numbers.to_id, value) == want


@pytest.mark.parametrize("value, want", [
    ("1.50", Decimal("1.50")), ("1.533", Decimal("1.533")), ("x", None), ("", None), (None, None),
])
def test_odds_from_text(spark, value, want):
    assert one(spark, numbers.to_odds, value) == want


@pytest.mark.parametrize("value, want", [
    ("12", 12.0), (" 1.5 ", 1.5), (".5", 0.5), ("-2e3", -2000.0), ("1d", None), ("0x1", None), ("nan", None), (None, None),
])
def test_lenient_number(spark, value, want):
    assert one(spark, numbers.to_number, value) == want


@pytest.mark.parametrize("wins, losses, digits, want", [
    (1, 2, 4, "0.3333"), (2, 1, 3, "0.667"), (1, 31, 4, "0.0313"), (0, 5, 3, "0.000"), (0, 0, 4, None), (1, 15, 3, "0.063"),
])
def test_share_rounds_half_up_and_guards_zero(spark, wins, losses, digits, want):
    got = spark.range(1).select(
        numbers.share(F.lit(wins).cast("bigint"), F.lit(losses).cast("bigint"), digits).alias("y")
    ).first().y
    assert got == (None if want is None else Decimal(want))


def test_nan_to_null(spark):
    assert one(spark, numbers.nan_to_null, float("nan"), "double") is None
    assert one(spark, numbers.nan_to_null, 1.5, "double") == 1.5


@pytest.mark.parametrize("value, kind, want", [
    (True, "boolean", 1), (False, "boolean", 0), (None, "boolean", None),
    (1, "int", 1), (2, "int", 0), (1.9, "double", 1), (0.5, "double", 0), (-1.5, "double", 0),
    (float("nan"), "double", None), (float("inf"), "double", None),
    ("1.0", "string", 1), (" YES ", "string", 1), ("t", "string", 1), ("no", "string", 0), ("F", "string", 0),
    ("maybe", "string", None), ("", "string", None), ("1d", "string", None), ("2", "string", 0), ("nan", "string", None),
    (Decimal("1.00"), "decimal(5,2)", 1),
])
def test_flag_to_binary(spark, value, kind, want):
    assert one(spark, labels.flag_to_binary, value, kind) == want


@pytest.mark.parametrize("value, want", [
    ("Finished", "Finished"), ("Retired", "Finished"), ("Awarded", "Finished"), ("Walk Over", "Finished"),
    ("Set 3", "In progress"), ("Cancelled", "Cancelled"), ("Interrupted", "Interrupted"),
    ("", "Not yet started"), (None, "Not yet started"), ("set 1", "Not yet started"),
])
def test_status_label(spark, value, want):
    assert one(spark, labels.status_label, value) == want


@pytest.mark.parametrize("value, kind, second, third, gender", [
    ("Atp Singles", "Singles", "Atp", "Atp", "Men"),
    ("Challenger Women - Doubles", "Doubles", "Challenger Women", "Challenger", "Women"),
    ("Challenger Men Singles", "Singles", "Challenger Men", "Challenger", "Men"),
    ("Wta Doubles", "Doubles", "Wta", "Wta", "Women"),
    ("Boys", "unkn", "Boys", "Boys", "unkn"), ("atp singles", "unkn", "atp singles", "atp singles", "unkn"),
    (None, "unkn", None, None, "unkn"),
])
def test_event_labels(spark, value, kind, second, third, gender):
    assert one(spark, labels.event_kind, value) == kind
    assert one(spark, labels.event_subtype, value) == second
    assert one(spark, labels.event_family, value) == third
    assert one(spark, labels.gender_label, value) == gender


@pytest.mark.parametrize("value, want", [
    ("Hard", "Hard"), ("clay", "Clay"), ("Hard (Indoor)", "Hard"), ("CLAY (Indoor)", "Clay"), ("", "unkn"), (None, "unkn"),
    ("hard-court", "Hard-Court"), ("red clay", "Red Clay"), (" (Indoor)", "unkn"), ("tierra batida/été", "Tierra Batida/Été"),
])
def test_surface_label(spark, value, want):
    assert one(spark, labels.surface_label, value) == want


def test_exhibition_and_null_types_are_filtered_out(spark):
    df = spark.createDataFrame([("Exhibition Men",), ("EXHIBITION",), ("Atp",), (None,)], "x string")
    assert [r.x for r in df.filter(labels.not_exhibition(F.col("x"))).collect()] == ["Atp"]


def test_trailing_window_has_366_days(spark):
    as_of = dt.date(2024, 3, 15)
    days = spark.range(800).select(F.date_sub(F.lit(dt.date(2024, 6, 1)), F.col("id").cast("int")).alias("d"))
    kept = days.filter(labels.within_trailing_days(F.col("d"), as_of)).agg(F.count("*"), F.min("d"), F.max("d")).first()
    assert tuple(kept) == (366, as_of - dt.timedelta(days=365), as_of)


@pytest.mark.parametrize("value, want", [
    ("Second Player", "P2"), ("First Player", "P1"), ("Draw", "Draw"), (None, None),
])
def test_winner_label(spark, value, want):
    assert one(spark, labels.winner_label, value) == want


@pytest.mark.parametrize("value, want", [
    ("1234567.5", "1.234.567,50"), ("0.5", "0,50"), ("abc", "abc"), (None, None), ("-3", "-3,00"), ("1.535", "1,53"),
])
def test_spanish_number(spark, value, want):
    assert one(spark, formats.spanish_number, value) == want


def test_spanish_percent_and_date(spark):
    assert one(spark, formats.spanish_percent, 0.2857, "double") == "28,57%"
    assert one(spark, formats.spanish_percent, "n/a") == "n/a"
    assert one(spark, formats.spanish_date, "2024-02-29") == "29/02/2024"
    assert one(spark, formats.spanish_date, "soon") == "soon"
    assert one(spark, formats.spanish_date, dt.date(2024, 2, 9), "date") == "09/02/2024"
    assert one(spark, formats.spanish_date, None) is None


def test_marks(spark):
    assert one(spark, formats.odds_or_mark, Decimal("1234.50"), "decimal(10,2)") == "1234,50"
    assert one(spark, formats.odds_or_mark, None, "decimal(10,2)") == "-"
    assert one(spark, formats.percent_or_mark, "x") == "-"
    assert one(spark, formats.short_percent, 0.28571, "double") == "28.6%"
    assert one(spark, formats.short_percent, "x") == "-"
    assert one(spark, lambda c: formats.fixed_or_mark(c, "x"), 2.0, "double") == "2.00x"
    assert one(spark, lambda c: formats.text_or_mark(c, " w"), 3, "bigint") == "3 w"
    assert one(spark, formats.text_or_mark, None) == "-"
