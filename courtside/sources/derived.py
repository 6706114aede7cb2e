"""Match tables derived from the star-schema test tables (see FIXTURES.md).

Used by the registered queries. Every table covers its whole source; the derivations
keep the date as a plain column expression, so date filters reach the parquet scan.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from courtside.plans.jobs import MatchTables

AS_OF = dt.date(1998, 5, 14)

# Given up front, so that opening a table starts no job.
_STAR = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_discount double, l_tax double",
    "customer": "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_brand string, p_size int, p_retailprice double",
}

_MATCH = [
    "o_orderkey as event_key",
    "cast(o_orderdate as date) as event_day",
    "cast(cast(o_orderdate as date) as string) as event_date",
    "concat(lpad(cast(8 + o_orderkey % 12 as string), 2, '0'), ':00') as event_time",
    "concat('Player#', o_custkey) as event_first_player",
    "o_custkey as first_player_key",
    "concat('Player#', o_custkey ^ (o_orderkey % 8)) as event_second_player",
    "o_custkey ^ (o_orderkey % 8) as second_player_key",
    "if(o_orderkey % 4 <> 0, concat('http://img/', o_custkey), null) as event_first_player_logo",
    "if(o_orderkey % 5 <> 0, concat('http://img/', o_custkey ^ (o_orderkey % 8)), null) as event_second_player_logo",
    "concat(o_orderkey % 3, ' - ', o_orderkey % 2) as event_final_result",
    "case o_orderstatus when 'F' then 'First Player' when 'O' then 'Second Player' end as event_winner",
    """case o_orderpriority when '1-URGENT' then 'Finished' when '2-HIGH' then 'Retired' when '3-MEDIUM' then 'Set 2'
         when '4-NOT SPECIFIED' then 'Walk Over'
         else elt(cast(o_orderkey % 3 + 1 as int), 'Cancelled', 'Interrupted', '') end as event_status""",
    """case o_orderkey % 7 when 0 then 'Atp Singles' when 1 then 'Wta Singles' when 2 then 'Challenger Men Singles'
         when 3 then 'Challenger Women - Doubles' when 4 then 'Exhibition Men' when 5 then 'Itf Men Doubles' end
         as event_type_type""",
    "concat('Tournament#', o_orderkey % 27) as tournament_name",
    "o_orderkey % 27 as tournament_key",
    "cast(year(o_orderdate) as string) as tournament_season",
]


def _cons_pick(every: int) -> str:
    """No bet, a name in neither corner, or either player."""
    return (
        f"case when event_key % {every} = 0 then 'Sin apuesta' when event_key % 13 = 12 then 'Player#?'"
        f" when event_key % {every} = 1 then event_first_player else event_second_player end as jugador_a_apostar_cons"
    )


class StarTables:
    """The derived tables of one test-data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def star(self, table: str) -> DataFrame:
        return self.spark.read.schema(_STAR[table]).parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def matches(self) -> DataFrame:
        """One match per order; opponents come from the customer's block of eight."""
        return self.star("orders").selectExpr(*_MATCH)

    @cached_property
    def results(self) -> DataFrame:
        """All downloads, made in one pass over the orders. Retired matches come again
        with the winner corrected, running ones as finished."""
        copies = self.matches.selectExpr(
            "*", "explode(if(event_status in ('Retired', 'Set 2'), array(1, 2), array(1))) as copy"
        )
        replaced = {
            "event_winner": "if(copy = 1, event_winner,"
                            " if(event_winner = 'First Player', 'Second Player', 'First Player'))",
            "event_status": "if(copy = 2 and event_status = 'Set 2', 'Finished', event_status)",
        }
        return copies.selectExpr(
            *[f"{replaced[c]} as {c}" if c in replaced else c for c in self.matches.columns],
            "timestamp_seconds(895000000 + copy * 86400) as download_time",
        )

    @cached_property
    def fixtures(self) -> DataFrame:
        """Matches from the day before the run day on: the window that the table stands for."""
        return self.matches.filter(f"event_day >= date '{AS_OF - dt.timedelta(days=1)}'")

    @cached_property
    def h2h(self) -> DataFrame:
        return self.matches.selectExpr("*", "timestamp_seconds(895000000) as download_time")

    @cached_property
    def tournaments(self) -> DataFrame:
        return self.star("nation").selectExpr(
            "cast(n_nationkey as bigint) as tournament_key", "n_name as tournament_name",
            "case n_regionkey when 0 then 'Hard' when 1 then 'clay' when 2 then 'Hard (Indoor)' when 3 then '' end"
            " as tournament_sourface",
        )

    @cached_property
    def standings(self) -> DataFrame:
        """All customers. Some have no key in the feed, those with a balance below zero no points."""
        return self.star("customer").selectExpr(
            "if(c_custkey % 11 <> 0, c_custkey, null) as player_key",
            "if(c_acctbal >= 0, cast(floor(c_acctbal) as string), null) as points",
        )

    @cached_property
    def odds(self) -> DataFrame:
        """One price per line item; repeated houses per event and an unknown house occur."""
        return self.star("lineitem").selectExpr(
            "l_orderkey as event_key",
            "elt(cast(l_suppkey % 15 + 1 as int), '10Bet', '188bet', '1xBet', '888Sport', 'bet365', 'Betano', 'Betfair',"
            " 'Marathon', 'Pncl', 'Sbo', 'Superbet', 'Unibet', 'WilliamHill', 'OtherBook', 'bet365') as betting_house",
            "cast(1 + l_discount * 10 as decimal(10,2)) as home_odds",
            "cast(1 + l_tax * 10 as decimal(10,2)) as away_odds",
        )

    def match_tables(self) -> MatchTables:
        return MatchTables(self.results, self.fixtures, self.h2h, self.tournaments, self.standings, self.odds)

    def _bets(self, rows: DataFrame, cons_every: int, *replaced: str) -> DataFrame:
        return rows.selectExpr(
            "event_key", "event_date", "event_first_player", "event_second_player", replaced[0], "tournament_name", "event_status",
            "case when event_type_type like '%Singles%' then 'Singles' when event_type_type like '%Doubles%' then 'Doubles' end as event_type",
            *replaced[1:], _cons_pick(cons_every),
            "case when event_key % 5 = 0 then 'Sin apuesta' when event_key % 5 = 1 then event_second_player"
            " when event_key % 5 <> 2 then event_first_player end as jugador_a_apostar_vb",
            "cast(event_key % 20 as decimal(10,2)) as monto_apuesta_cons",
            "cast(event_key % 30 as decimal(10,2)) as monto_apuesta_vb",
            "cast(null as string) as result_bet", "cast(null as decimal(12,2)) as profit_loss_vb",
            "cast(null as decimal(12,2)) as profit_loss_cons",
            "case event_key % 12 when 0 then 'true' when 1 then 't' when 2 then '1' when 3 then '1.0' when 4 then ' YES '"
            " when 5 then 'false' when 6 then 'f' when 7 then '0' when 8 then '0.5' when 9 then 'no' when 10 then 'maybe'"
            " end as flag_low_bet_value",
        )

    @cached_property
    def analysis(self) -> DataFrame:
        return self._bets(
            self.fixtures, 3,
            "case event_winner when 'First Player' then 'P1' when 'Second Player' then 'P2' end as event_winner",
            "cast(event_key % 9 + 1 as decimal(10,2)) as p1_odds", "cast(event_key % 7 + 1 as decimal(10,2)) as p2_odds",
        )

    @cached_property
    def history(self) -> DataFrame:
        """Bets on all matches, none settled."""
        return self._bets(
            self.matches, 4, "cast(null as string) as event_winner",
            "cast(2 as decimal(10,2)) as p1_odds", "cast(2 as decimal(10,2)) as p2_odds",
        )

    @cached_property
    def constants(self) -> DataFrame:
        """One log row per part: profiles by brand, small parts under ``default``."""
        return self.star("part").selectExpr(
            "if(p_size < 5, 'default', p_brand) as nombre_constante",
            *[f"cast(p_size + {i} as smallint) as c_0{i}" for i in range(1, 5)],
            "cast(p_retailprice as float) as c_05",
            *[f"cast(p_retailprice / {i} as float) as p_0{i}" for i in range(1, 5)],
            "cast(p_retailprice / 8 as float) as pma_vb", "cast(p_retailprice / 16 as float) as pma_cons",
            "cast(if(p_size % 3 <> 0, p_size, null) as smallint) as pm",
            "timestamp_seconds(p_partkey * 60) as inserted_at",
        )
