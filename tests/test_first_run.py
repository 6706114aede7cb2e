"""The first analysis run keeps every bet."""

from courtside.plans import daily
from frames import AS_OF, rows
from test_history import LATER, NONE, bet, frame


def test_first_analysis_run_keeps_bets_without_a_date(spark, tmp_path):
    house = daily.Warehouse(spark, str(tmp_path / "house"))
    analysis = frame(spark, bet(1, LATER), bet(2, None), bet(3, None, cons=NONE, vb=NONE))
    for _ in range(2):  # the second run merges
        assert all(s.ok for s in daily.run_analysis(house, analysis, AS_OF))
        assert rows(house.bet_history(analysis.schema), "event_key", "event_date") == [(1, LATER), (2, None)]
