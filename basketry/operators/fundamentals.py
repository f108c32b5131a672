"""Fundamentals as they were known on a date.

A dated table has ``as_of``, the day on which a row became public, and may have ``period_end``, the period that its figures
describe (the same day without that column). On any day a field holds the figure of the latest period among the rows
public by then that state the field; a later row about the same period replaces the earlier one, and a late
restatement of an old period changes nothing where a newer period is known. Rows without symbol or ``as_of`` cannot be
placed and are left out; rows with the same symbol and both dates count as one, with the greater figure.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from basketry.functions.columns import ratio
from basketry.operators.calendar import as_of
from basketry.operators.factors import QUALITY_DOWN, QUALITY_UP, zscore_by_date
from basketry.sizing import Calendar, Schedule, small


def is_dated(fundamentals: DataFrame) -> bool:
    return "as_of" in fundamentals.columns


def known_intervals(fundamentals: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(symbol, known_from, known_until, *fields)``: the state of every field from each publication to the day before the next.

    ``known_until`` is null in a symbol's last interval. Rows are first reduced to one per symbol and day, so a window
    holds a symbol's publication days, not its rows.
    """
    period = F.coalesce("period_end", "as_of") if "period_end" in fundamentals.columns else F.col("as_of")
    stated = [F.max(F.when(F.col(f).isNotNull(), F.struct(period.alias("p"), F.col("as_of").alias("k"), F.col(f).alias("v")))).alias(f) for f in fields]
    days = fundamentals.where("symbol IS NOT NULL AND as_of IS NOT NULL").groupBy("symbol", "as_of").agg(*stated)
    ordered = W.partitionBy("symbol").orderBy("as_of")
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    return days.select(
        "symbol", F.col("as_of").alias("known_from"), F.date_sub(F.lead("as_of").over(ordered), 1).alias("known_until"),
        *[F.max(f).over(so_far)["v"].alias(f) for f in fields],
    )


def quality_fields(fundamentals: DataFrame) -> list[str]:
    return [c for c in (*QUALITY_UP, *QUALITY_DOWN) if c in fundamentals.columns]


def known_at_rebalances(fundamentals: DataFrame, fields: Sequence[str], schedule: Schedule) -> DataFrame:
    """``(rebalance_date, symbol, *fields)`` for every rebalance on or after a symbol's first publication.

    The schedule travels as one array and each interval takes its own dates from it, so no pair of rows is ever formed.
    """
    dates = schedule.rows.agg(F.array_sort(F.collect_set("rebalance_date")).alias("d"))  # bounded by the schedule
    inside = F.filter("_dates", lambda d: (d >= F.col("known_from")) & (F.col("known_until").isNull() | (d <= F.col("known_until"))))
    states = known_intervals(fundamentals, fields).withColumn("_dates", dates.scalar())
    return states.select(F.explode(inside).alias("rebalance_date"), "symbol", *fields)


def known_by_row(fundamentals: DataFrame, fields: Sequence[str], cal: Calendar) -> DataFrame:
    """``(symbol, pos, *fields)``: the state on every calendar row from a symbol's first publication on."""
    span = cal.rows.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    if span["first"] is None:
        return known_intervals(fundamentals, fields).select("symbol", F.lit(None).cast("bigint").alias("pos"), *fields).limit(0)
    dated = cal.rows.withColumn("_before", F.lag("date").over(W.orderBy("date")))  # one row per trading date
    # Every day of the calendar's span with the first row on or after it.
    days = dated.select("pos", F.explode(F.sequence(F.coalesce(F.date_add("_before", 1), "date"), "date")).alias("known_from"))
    states = known_intervals(fundamentals, fields).withColumn("known_from", F.greatest("known_from", F.lit(span["first"])))
    placed = states.join(small(days, (span["last"] - span["first"]).days + 1), "known_from")
    # Publications that reach the same row follow each other at once; the last of them counts.
    following = F.lead("pos").over(W.partitionBy("symbol").orderBy("pos", F.col("known_until").asc_nulls_last()))
    until = F.coalesce(following - 1, F.lit(cal.last).cast("bigint"))
    return (
        placed.withColumn("_until", until).where(F.col("_until") >= F.col("pos"))
        .select("symbol", F.explode(F.sequence("pos", "_until")).alias("pos"), *fields)
    )


def quality_by(rows: DataFrame, key: str, hint) -> DataFrame:
    """``(key, symbol, score)``: mean over available fields of population z-scores within each ``key``; leverage counts negatively."""
    fields = [(c, 1) for c in QUALITY_UP if c in rows.columns] + [(c, -1) for c in QUALITY_DOWN if c in rows.columns]
    if not fields:
        return rows.select(key, "symbol", F.lit(None).cast("double").alias("score"))
    moments = rows.groupBy(key).agg(*[F.avg(c).alias(f"_m_{c}") for c, _ in fields], *[F.stddev_pop(c).alias(f"_s_{c}") for c, _ in fields])
    z = [ratio(sign * (F.col(c) - F.col(f"_m_{c}")), f"_s_{c}") for c, sign in fields]
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in z])
    present = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in z])
    return rows.join(hint(moments), key).select(key, "symbol", ratio(total, present).alias("score"))


def quality_at_rebalances(fundamentals: DataFrame, schedule: Schedule) -> DataFrame:
    """``(rebalance_date, symbol, score)`` from the figures known on each rebalance date."""
    return quality_by(known_at_rebalances(fundamentals, quality_fields(fundamentals), schedule), "rebalance_date", schedule.hint)


def quality_panel(fundamentals: DataFrame, cal: Calendar) -> DataFrame:
    """``(symbol, pos, score)`` from the figures known on each trading date."""
    return quality_by(known_by_row(fundamentals, quality_fields(fundamentals), cal), "pos", cal.hint).where("score IS NOT NULL").select("symbol", "pos", "score")


def raw_value_known(prices: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Trailing earnings per share known on the day over price."""
    states = known_intervals(fundamentals, ["trailingEps"])
    eps = as_of(prices.select("symbol", "pos", "date", "close"), states, "date", "known_from", ["trailingEps"], by=["symbol"])
    return eps.select("symbol", "pos", ratio("trailingEps", "close").alias("raw")).where("raw IS NOT NULL")


def value_scores_known(prices: DataFrame, fundamentals: DataFrame, cal: Calendar) -> DataFrame:
    """The same, z-scored."""
    return zscore_by_date(raw_value_known(prices, fundamentals), cal)
