import datetime as dt

import pytest
from pyspark.sql import functions as F

from courtside.operators import constants, export, facets, filters, insights
from frames import rows

NONE = "Sin apuesta"


def mart(spark, *data):
    base = {
        "event_key": 1, "event_date": "2024-03-15", "event_time": "10:00", "event_status": "Not yet started",
        "event_type": "Singles", "event_gender": "Men", "tournament_name": "Open", "tournament_sourface": "Hard",
        "event_first_player": "A", "event_second_player": "B", "p1_points": "100", "p2_points": "40",
        "p1_odds": 1.5, "p2_odds": 2.25, "p1_wins_h2h": 1, "p1_perc_h2h": 0.25, "p2_wins_h2h": 3, "p2_perc_h2h": 0.75,
        "load_timestamp": dt.datetime(2024, 3, 15, 9),
    }
    kinds = {"event_key": "bigint", "p1_odds": "double", "p2_odds": "double", "p1_wins_h2h": "bigint",
             "p2_wins_h2h": "bigint", "p1_perc_h2h": "double", "p2_perc_h2h": "double", "load_timestamp": "timestamp"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in base)
    return spark.createDataFrame([tuple({**base, **d}.values()) for d in data], schema)


def test_filter_in(spark):
    df = filters.with_event_day(mart(
        spark, {"event_key": 1}, {"event_key": 2, "event_status": "Finished"}, {"event_key": 3, "event_date": "soon"},
        {"event_key": 4, "tournament_name": None},
    ))
    assert filters.filter_in(df, event_type=[], event_status=[]).count() == 4
    assert rows(filters.filter_in(df, event_status=["Not yet started"], tournament_name=["Open"]), "event_key") == [(1,), (3,)]
    assert rows(filters.filter_in(df, event_date_only=[dt.date(2024, 3, 15)]), "event_key") == [(1,), (2,), (4,)]
    with pytest.raises(ValueError):
        filters.filter_in(df, event_key=[1])


def test_required_columns(spark):
    df = mart(spark, {})
    assert filters.require_columns(df) is df
    with pytest.raises(ValueError, match="event_type, tournament_name"):
        filters.require_columns(df.drop("event_type", "tournament_name"))


def test_filter_equals_tolerates_all_and_missing(spark):
    df = mart(spark, {}, {"event_type": "Doubles"})
    assert filters.filter_equals(df, "event_type", "All").count() == 2
    assert filters.filter_equals(df, "nowhere", "x").count() == 2
    assert filters.filter_equals(df, "event_type", "Doubles").count() == 1


def picks(spark):
    data = [(1, NONE, NONE), (2, "A", NONE), (3, None, NONE), (4, NONE, None), (5, "A", "B"), (6, None, None)]
    return spark.createDataFrame(data, "event_key bigint, jugador_a_apostar_cons string, jugador_a_apostar_vb string")


def test_bet_filter_counts_null_as_a_bet(spark):
    assert rows(filters.filter_bets(picks(spark), "Con apuesta"), "event_key") == [(2,), (3,), (4,), (5,), (6,)]
    assert rows(filters.filter_bets(picks(spark), "Sin apuesta"), "event_key") == [(1,)]
    assert filters.filter_bets(picks(spark), "All").count() == 6
    one_model = picks(spark).drop("jugador_a_apostar_vb")
    assert rows(filters.filter_bets(one_model, "Con apuesta"), "event_key") == [(2,), (3,), (5,), (6,)]
    neither = one_model.drop("jugador_a_apostar_cons")
    assert filters.filter_bets(neither, "Con apuesta").count() == 0
    assert filters.filter_bets(neither, "Sin apuesta").count() == 6


def test_flag_filter(spark):
    df = spark.createDataFrame([(1, "true"), (2, "0"), (3, None), (4, "1.0"), (5, "maybe")], "k int, flag_low_bet_value string")
    assert rows(filters.filter_flag(df, "Low"), "k") == [(1,), (4,)]
    assert rows(filters.filter_flag(df, "Ok"), "k") == [(2,)]
    assert filters.filter_flag(df, "All").count() == 5
    assert filters.filter_flag(df.drop("flag_low_bet_value"), "Low").count() == 5


def test_columns_of_a_row(spark):
    df = mart(spark, {})
    plain, with_odds = filters.row_columns(df), filters.row_columns(df, with_odds=True)
    assert plain[0] == "tournament_name" and "p1_odds" not in plain and "p1_rend_all" not in plain
    assert with_odds[with_odds.index("p2_points") + 1:] == ["p1_odds", "p2_odds"]
    assert filters.row_columns(df.drop("p2_points"), with_odds=True)[:2] == ["p1_odds", "p2_odds"]


def test_facets_depend_on_earlier_levels(spark):
    df = mart(
        spark, {"tournament_name": "B"}, {"tournament_name": "A", "tournament_sourface": "Clay"},
        {"tournament_name": None}, {"tournament_name": "C", "event_type": "Doubles", "event_date": "bad"},
    )
    got = facets.match_facets(df, event_types=["Singles"], tournaments=["A"])
    assert [r[0] for r in got["tournament_name"].collect()] == ["A", "B"]
    assert [r[0] for r in got["tournament_sourface"].collect()] == ["Clay"]
    assert [r[0] for r in got["event_type"].collect()] == ["Doubles", "Singles"]
    assert [r[0] for r in facets.day_options(df).collect()] == [dt.date(2024, 3, 15)]


def test_analysis_chain(spark):
    df = mart(
        spark, {"event_key": 1}, {"event_key": 2, "event_date": "2024-03-16"}, {"event_key": 3, "event_type": "Doubles"},
        {"event_key": 4, "tournament_name": "Cup"},
    ).withColumn("jugador_a_apostar_cons", F.when(F.col("event_key") == 4, NONE).otherwise("A"))
    day = dt.date(2024, 3, 15)
    assert rows(filters.filter_analysis(df, event_day=day, event_type="Singles"), "event_key") == [(1,)]
    assert rows(filters.filter_analysis(df, bets="All", tournaments=["Cup"]), "event_key") == [(4,)]
    got = facets.analysis_facets(df, event_day=day, bets="Sin apuesta")
    assert [r[0] for r in got["event_type"].collect()] == ["Doubles", "Singles"]
    assert [r[0] for r in got["tournament_name"].collect()] == ["Cup"]


def test_kpis_and_counts_with_nulls(spark):
    df = mart(spark, {}, {"tournament_name": None, "event_status": None}, {"event_date": "bad", "tournament_sourface": "Clay"})
    assert tuple(insights.kpi_summary(df).first()) == (3, 1, 1, 2, dt.datetime(2024, 3, 15, 9))
    assert rows(insights.fixture_counts(df, "event_status")) == [("Not yet started", 2), (None, 1)]
    by_day = [tuple(r) for r in insights.counts_by_day_and_status(df).collect()]
    day = dt.date(2024, 3, 15)
    assert by_day == [(day, "Not yet started", 1), (day, None, 1), (None, "Not yet started", 1)]


def test_top_tournaments_breaks_ties_by_name(spark):
    df = mart(spark, *[{"tournament_name": f"T{i:02}"} for i in range(14)], {"tournament_name": "T13"})
    got = [tuple(r) for r in insights.top_tournaments(df).collect()]
    assert got[0] == ("T13", 2) and [r[0] for r in got[1:]] == [f"T{i:02}" for i in range(11)]


def test_gaps(spark):
    df = mart(spark, {}, {"p1_points": "n/a", "p1_odds": None})
    got = insights.with_gaps(df).select("points_gap", "points_gap_plot", "odds_gap").collect()
    assert [tuple(r) for r in got] == [(60.0, 60.0, 0.75), (None, 0.0, None)]
    assert "odds_gap" not in insights.with_gaps(df.drop("p1_odds")).columns


def test_upcoming(spark):
    data = [{"event_key": i, "event_time": f"{20 - i}:00"} for i in range(1, 13)]
    df = mart(spark, *data, {"event_key": 50, "event_time": None}, {"event_key": 51, "event_status": "Finished"})
    got = [r.event_key for r in insights.next_matches(df).collect()]
    assert got == list(range(12, 2, -1))
    everything = [r.event_key for r in insights.upcoming(df, n=None).collect()]
    assert len(everything) == 14 and everything[-1] == 50


def test_upcoming_without_any_readable_time_is_not_cut(spark):
    df = mart(spark, *[{"event_key": i, "event_time": "late"} for i in range(15)])
    assert insights.next_matches(df).count() == 15


def test_upcoming_lines(spark):
    row = insights.upcoming_lines(mart(spark, {"tournament_name": None, "p2_points": None})).first()
    assert (row.headline, row.p1_h2h_wins, row.p1_h2h_share, row.p1_standing, row.p2_standing) == (
        "2024-03-15 10:00", "1", "25.0%", "100", "-")


def test_first_present(spark):
    df = spark.createDataFrame([(None, 2), (1, 3)], "a int, b int")
    assert rows(df.select(insights.first_present(df, ["zz", "a", "b"]))) == [(1,), (2,)]
    assert rows(df.select(insights.first_present(df, ["zz"]))) == [(None,), (None,)]


def test_export(spark, tmp_path):
    df = mart(
        spark, {"event_key": 1, "tournament_name": "B"}, {"event_key": 2, "tournament_name": "A", "event_time": "12:00"},
        {"event_key": 3, "tournament_name": "A", "event_time": "09:00", "p1_odds": None, "event_first_player": 'O"Hara, "X"'},
    )
    table = export.export_table(df, ["event_key", "event_date", "event_first_player", "p1_perc_h2h", "p1_odds", "nowhere"])
    assert [tuple(r) for r in table.collect()] == [
        (3, "15/03/2024", 'O"Hara, "X"', "25,00%", None), (2, "15/03/2024", "A", "25,00%", "1,50"),
        (1, "15/03/2024", "A", "25,00%", "1,50"),
    ]
    export.write_csv(table.coalesce(1), str(tmp_path / "csv"))
    [part] = (tmp_path / "csv").glob("part-*.csv")
    lines = part.read_text(encoding="utf-8").splitlines()
    assert lines[0] == '"event_key","event_date","event_first_player","p1_perc_h2h","p1_odds"'
    assert lines[1] == '"3","15/03/2024","O""Hara, ""X""","25,00%",""'
    plain = export.export_table(df, ["p1_perc_h2h"], spanish=False)
    assert plain.schema["p1_perc_h2h"].dataType.typeName() == "double"


def test_tsv_line_keeps_columns_in_place(spark):
    df = mart(spark, {"tournament_name": None, "p1_perc_h2h": None, "p1_odds": None, "p2_odds": 1234.5})
    line = df.select(export.tsv_line(df, with_odds=True)).first()[0]
    assert line.split("\t") == ["-", "15/03/2024", "A", "B", "Hard", "1", "-", "3", "75,00%", "100", "40", "-", "1234,50"]
    assert df.select(export.match_label(df)).first()[0] == "2024-03-15 | A vs B | -"


def test_constants_log(spark, tmp_path):
    from courtside.sources import tables

    path = str(tmp_path / "constants")
    for i, (name, value) in enumerate([("zeta", 1), ("default", 2), ("zeta", 3), ("alpha", 4)]):
        row = constants.constants_row(spark, {"nombre_constante": name, "c_01": value, "c_05": float("nan")},
                                      dt.datetime(2024, 1, 1 + i))
        assert tables.append_rows(row, path) == 1
    assert tables.append_rows(row.filter("c_01 < 0"), path) == 0 and tables.append_rows(row.limit(0), path) == 0
    log = spark.read.parquet(path)
    assert log.count() == 4 and log.filter("c_05 is not null").count() == 0
    assert rows(constants.latest_constants(log), "nombre_constante", "c_01") == [("alpha", 4), ("default", 2), ("zeta", 3)]
    assert [r[0] for r in constants.profile_names(log).collect()] == ["default", "zeta", "alpha"]
    with pytest.raises(ValueError):
        constants.constants_row(spark, {"c_99": 1})
