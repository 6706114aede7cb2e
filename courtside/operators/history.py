"""Bet history: results of past bets, and replacement of today's and future bets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.labels import NO_BET
from courtside.operators.dedup import keep_one
from courtside.operators.skew import shard

KEYS = ["event_key", "event_date"]
REFRESHED = ["event_winner", "p1_odds", "p2_odds"]


def bet_result(pick: Column, first: Column, second: Column, winner: Column) -> Column:
    """won / lost / unkn (no winner yet) / check (anything odd); null without a bet."""
    on_first, on_second = pick == first, pick == second
    return (
        F.when(pick == NO_BET, F.lit(None).cast("string"))
        .when((on_first & (winner == "P1")) | (on_second & (winner == "P2")), "won")
        .when((on_first & (winner == "P2")) | (on_second & (winner == "P1")), "lost")
        .when((on_first | on_second) & winner.isNull(), "unkn")
        .otherwise("check")
    )


def bet_profit(pick: Column, first: Column, second: Column, result: Column, stake: Column,
               first_odds: Column, second_odds: Column) -> Column:
    """Gain of a won bet, minus the stake of a lost one, else null. Exact decimals."""
    won = result == "won"
    return (
        F.when((pick == first) & won, F.round(stake * (first_odds - 1), 2))
        .when((pick == second) & won, F.round(stake * (second_odds - 1), 2))
        .when(pick.isin(first, second) & (result == "lost"), F.round(-stake, 2))
    )


def with_bet_outcome(bets: DataFrame, per_model: bool = False) -> DataFrame:
    """Sets ``result_bet`` and both profits of rows that hold the match's winner and odds.

    As kept in the books, both profits read the result of the conservative pick.
    ``per_model=True`` gives the other model its own result instead.
    """
    first, second, winner = (F.col(c) for c in ("event_first_player", "event_second_player", "event_winner"))
    picks = {m: F.col(f"jugador_a_apostar_{m}") for m in ("cons", "vb")}
    results = {m: bet_result(pick, first, second, winner) for m, pick in picks.items()}
    if not per_model:
        results["vb"] = results["cons"]
    profits = {
        f"profit_loss_{m}": bet_profit(
            picks[m], first, second, results[m], F.col(f"monto_apuesta_{m}"), F.col("p1_odds"), F.col("p2_odds")
        ).cast(bets.schema[f"profit_loss_{m}"].dataType)
        for m in picks
    }
    return bets.withColumns({"result_bet": results["cons"], **profits})


def update_history(hist: DataFrame, analysis: DataFrame, as_of: dt.date, per_model: bool = False) -> DataFrame:
    """Past rows found in the analysis take its winner and odds and get their outcome
    (computed nulls included); all others keep what they hold.

    Should the analysis repeat a key, the row with a winner comes first, then the
    lowest odds, so that every run picks the same one.
    """
    past = analysis.filter(F.to_date("event_date") < F.lit(as_of)).select(*KEYS, *REFRESHED)
    sharded = past.withColumn("_shard", shard("event_key"))
    past = keep_one(sharded, [*KEYS, "_shard"], "event_winner", ["p1_odds", "p2_odds"])
    found = past.select(*KEYS, F.struct(*REFRESHED).alias("_new"))
    joined = hist.join(found, KEYS, "left")
    matched = F.col("_new").isNotNull()
    fresh = {
        c: F.when(matched, F.col(f"_new.{c}")).otherwise(F.col(c)).cast(hist.schema[c].dataType)
        for c in REFRESHED
    }
    outcome = ["result_bet", "profit_loss_vb", "profit_loss_cons"]
    kept = {f"_old_{c}": F.col(c) for c in outcome}
    updated = with_bet_outcome(joined.withColumns({**fresh, **kept}), per_model)
    settled = {c: F.when(matched, F.col(c)).otherwise(F.col(f"_old_{c}")) for c in outcome}
    return updated.withColumns(settled).select(*hist.columns)


def drop_replaced_dates(hist: DataFrame, analysis: DataFrame, as_of: dt.date) -> DataFrame:
    """Without the dates, compared as text, that the analysis holds from today on,
    whether or not it has bets there. Rows without a date stay.

    A day may hold much of the history. The dates are few, so Spark broadcasts them;
    should it merge instead, their own shuffle lets it split such a day.
    """
    coming = analysis.filter(F.to_date("event_date") >= F.lit(as_of))
    dates = coming.select("event_date", shard(F.xxhash64("event_date"))).distinct().select("event_date")
    return hist.join(dates, "event_date", "left_anti").select(*hist.columns)


def has_bet(bets: DataFrame) -> DataFrame:
    """A bet in either model; a null pick is no bet."""
    return bets.filter(
        (F.col("jugador_a_apostar_cons") != NO_BET) | (F.col("jugador_a_apostar_vb") != NO_BET)
    )


def new_bets(analysis: DataFrame, as_of: dt.date) -> DataFrame:
    return has_bet(analysis).filter(F.to_date("event_date") >= F.lit(as_of))


def initial_history(analysis: DataFrame) -> DataFrame:
    return has_bet(analysis)


def merge_history(hist: DataFrame, analysis: DataFrame, as_of: dt.date, per_model: bool = False) -> DataFrame:
    """Settle past bets, drop the dates that come anew, add their bets."""
    settled = update_history(hist, analysis, as_of, per_model)
    kept = drop_replaced_dates(settled, analysis, as_of)
    return kept.unionByName(new_bets(analysis, as_of).select(*hist.columns))


def merge_in_place(hist: DataFrame, analysis: DataFrame, as_of: dt.date, per_model: bool = False) -> DataFrame:
    """``merge_history`` for tables bucketed alike by the keys: no row of the history moves.

    The settling join finds both sides in their buckets. The dates that come anew are a list
    bounded by the calendar and become a plain filter, not a join. One key's rows stay in one
    bucket, so this suits keys that repeat little, as events do in the books.
    """
    settled = update_history(hist, analysis, as_of, per_model)
    coming = analysis.filter(F.to_date("event_date") >= F.lit(as_of)).select("event_date").distinct().collect()
    day = F.col("event_date")
    kept = settled.filter(day.isNull() | ~day.isin([r.event_date for r in coming])) if coming else settled
    return kept.unionByName(new_bets(analysis, as_of).select(*hist.columns))
