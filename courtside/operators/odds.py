"""Odds per event: one column per house and side, and a consensus price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.operators.skew import shard

# The houses that count. Others are ignored.
HOUSES = [
    "10Bet", "188bet", "1xBet", "888Sport", "bet365", "Betano", "Betfair", "Marathon", "Pncl", "Sbo",
    "Superbet", "Unibet", "WilliamHill",
]
LEAD_HOUSE = "bet365"
SIDES = {"hm": "home_odds", "aw": "away_odds"}


def house_column(house: str, side: str) -> str:
    """Quoted: some names start with a digit."""
    return f"`{house.lower()}_{side}_odds`"


def odds_pivot(odds: DataFrame) -> DataFrame:
    """One row per event. Explicit max-if columns keep it to one shuffle, with rows
    combined per event before it; a repeated house takes its highest price."""
    prices = [
        F.expr(f"max(if(betting_house = '{house}', {price}, null)) as {house_column(house, side)}")
        for house in HOUSES
        for side, price in SIDES.items()
    ]
    return odds.groupBy("event_key", shard("event_key").alias("_shard")).agg(*prices).drop("_shard")


def _sum(terms: list[str]) -> str:
    """Added up in pairs: a decimal gains a digit per level, so that the sum of a dozen
    prices keeps to the short decimals, which are added as longs."""
    if len(terms) == 1:
        return terms[0]
    half = len(terms) // 2
    return f"({_sum(terms[:half])} + {_sum(terms[half:])})"


def _consensus(side: str) -> Column:
    others = [house_column(h, side) for h in HOUSES if h != LEAD_HOUSE]
    total = _sum([f"coalesce({price}, 0.0BD)" for price in others])
    count = _sum([f"if({price} is null, 0, 1)" for price in others])
    return F.expr(f"coalesce({house_column(LEAD_HOUSE, side)}, round(({total}) / nullif({count}, 0), 2))")


def odds_consensus(pivot: DataFrame) -> DataFrame:
    """Adds the lead house's price, else the mean of the other houses to 2 digits,
    else null. Exact decimals throughout."""
    return pivot.withColumns({price: _consensus(side) for side, price in SIDES.items()})
