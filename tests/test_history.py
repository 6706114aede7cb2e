from decimal import Decimal

import pytest

from courtside.operators import history
from courtside.plans import daily
from courtside.sources import tables
from frames import AS_OF, rows

SCHEMA = (
    "event_key bigint, event_date string, event_first_player string, event_second_player string, event_winner string,"
    " p1_odds decimal(10,2), p2_odds decimal(10,2), jugador_a_apostar_cons string, jugador_a_apostar_vb string,"
    " monto_apuesta_cons decimal(10,2), monto_apuesta_vb decimal(10,2), result_bet string,"
    " profit_loss_vb decimal(12,2), profit_loss_cons decimal(12,2)"
)
NONE = "Sin apuesta"
PAST, TODAY, LATER = "2024-03-14", "2024-03-15", "2024-03-16"


def bet(key=1, date=PAST, winner=None, cons="A", vb="A", odds=("2", "3"), stakes=("10", "5"), result=None, profit=None):
    money = [Decimal(v) if v is not None else None for v in (*odds, *stakes)]
    return (key, date, "A", "B", winner, money[0], money[1], cons, vb, money[2], money[3], result,
            None if profit is None else Decimal(profit), None if profit is None else Decimal(profit))


def frame(spark, *bets):
    return spark.createDataFrame(list(bets), SCHEMA)


@pytest.mark.parametrize("cons, winner, want", [
    (NONE, "P1", None), (NONE, None, None), ("A", "P1", "won"), ("B", "P2", "won"), ("A", "P2", "lost"), ("B", "P1", "lost"),
    ("A", None, "unkn"), ("B", None, "unkn"), ("C", "P1", "check"), ("C", None, "check"), (None, "P1", "check"),
    (None, None, "check"), ("A", "Draw", "check"),
])
def test_bet_result(spark, cons, winner, want):
    got = history.with_bet_outcome(frame(spark, bet(winner=winner, cons=cons)))
    assert got.first().result_bet == want


@pytest.mark.parametrize("cons, vb, winner, per_model, cons_profit, vb_profit", [
    ("A", "A", "P1", False, 10, 5), ("B", "B", "P2", False, 20, 10), ("A", "A", "P2", False, -10, -5),
    ("A", "B", "P1", False, 10, 10),       # the other model's profit reads the conservative result
    ("A", "B", "P1", True, 10, -5),        # its own result
    (NONE, "A", "P1", False, None, None), (NONE, "A", "P1", True, None, 5),
    ("A", NONE, "P1", False, 10, None), ("A", None, "P2", False, -10, None), ("A", "A", None, False, None, None),
])
def test_profit(spark, cons, vb, winner, per_model, cons_profit, vb_profit):
    row = history.with_bet_outcome(frame(spark, bet(winner=winner, cons=cons, vb=vb)), per_model).first()
    assert (row.profit_loss_cons, row.profit_loss_vb) == (cons_profit, vb_profit)


def test_profit_rounds_half_up(spark):
    row = history.with_bet_outcome(frame(spark, bet(winner="P1", odds=("1.25", "1"), stakes=("0.90", "0.10")))).first()
    assert (row.profit_loss_cons, row.profit_loss_vb) == (Decimal("0.23"), Decimal("0.03"))


def test_update_touches_past_matches_only(spark):
    hist = frame(
        spark, bet(1, result="unkn"), bet(2, TODAY, result="kept"), bet(3, winner="P2", result="kept", profit="1"),
        bet(4, winner="P1", result="won", profit="7"), bet(5, "2024-3-14", result="kept"), bet(6, None, result="kept"),
    )
    analysis = frame(
        spark, bet(1, winner="P1", odds=("4", "5")), bet(2, TODAY, winner="P1"), bet(4, winner=None, odds=(None, None)),
        bet(5, PAST, winner="P1"),
    )
    got = {r.event_key: (r.event_winner, r.p1_odds, r.result_bet, r.profit_loss_cons)
           for r in history.update_history(hist, analysis, AS_OF).collect()}
    assert got == {
        1: ("P1", 4, "won", 30), 2: (None, 2, "kept", None), 3: ("P2", 2, "kept", 1),
        4: (None, None, "unkn", None),   # a matched row takes computed nulls
        5: (None, 2, "kept", None),      # dates compare as text
        6: (None, 2, "kept", None),
    }


def test_repeated_analysis_rows_update_once_and_the_same_way(spark):
    hist = frame(spark, bet(1), bet(1))
    twice = [bet(1, winner=None), bet(1, winner="P2"), bet(1, winner="P1")]
    for order in (twice, twice[::-1]):
        got = history.update_history(hist, frame(spark, *order), AS_OF)
        assert [r.event_winner for r in got.collect()] == ["P1", "P1"]


def test_delete_drops_whole_dates_and_keeps_nulls(spark):
    hist = frame(spark, bet(1), bet(2, TODAY), bet(3, LATER), bet(4, "2024-03-17"), bet(5, None))
    analysis = frame(spark, bet(8), bet(9, TODAY, cons=NONE, vb=NONE), bet(10, LATER))
    assert rows(history.drop_replaced_dates(hist, analysis, AS_OF), "event_key") == [(1,), (4,), (5,)]


def test_insert_takes_bets_from_today_on(spark):
    analysis = frame(
        spark, bet(1), bet(2, TODAY), bet(3, TODAY, cons=NONE, vb=NONE), bet(4, LATER, cons=NONE), bet(5, LATER, vb=NONE),
        bet(6, LATER, cons=None, vb=NONE), bet(7, LATER, cons=None, vb="B"),
    )
    assert rows(history.new_bets(analysis, AS_OF), "event_key") == [(2,), (4,), (5,), (7,)]
    assert rows(history.initial_history(analysis), "event_key") == [(1,), (2,), (4,), (5,), (7,)]


def sample(spark):
    hist = frame(spark, bet(1), bet(2, TODAY), bet(3, LATER), bet(4, "2024-01-01", winner="P1", result="won"))
    analysis = frame(spark, bet(1, winner="P2"), bet(5, TODAY), bet(6, LATER, cons=NONE, vb=NONE), bet(7, "2024-03-17"))
    return hist, analysis


def test_merge_and_merge_again(spark):
    hist, analysis = sample(spark)
    once = history.merge_history(hist, analysis, AS_OF)
    assert rows(once, "event_key", "result_bet") == [(1, "lost"), (4, "won"), (5, None), (7, None)]
    assert rows(history.merge_history(once, analysis, AS_OF)) == rows(once)


def test_merge_by_days_equals_the_whole_merge(spark, tmp_path):
    hist, analysis = sample(spark)
    path = str(tmp_path / "hist")
    days = sorted({r.d for r in hist.selectExpr("to_date(event_date) as d").collect()})
    tables.overwrite_days(spark, path, hist, days)
    touched = daily.merge_history_days(spark, path, analysis, AS_OF)
    assert [d.isoformat() for d in touched] == [PAST, TODAY, LATER, "2024-03-17"]
    stored = tables.read_days(spark, path, hist.schema).select(*hist.columns)
    assert rows(stored) == rows(history.merge_history(hist, analysis, AS_OF))


def test_merge_by_days_starts_an_empty_history(spark, tmp_path):
    _, analysis = sample(spark)
    daily.merge_history_days(spark, str(tmp_path / "h"), analysis, AS_OF)
    stored = tables.read_days(spark, str(tmp_path / "h"), analysis.schema)
    assert rows(stored, "event_key") == [(1,), (5,), (7,)]  # all bets, past ones too
