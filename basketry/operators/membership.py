"""Point-in-time index membership from a current list and an add/remove log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W, functions as F

from basketry.functions.columns import feed_symbol
from basketry.sizing import Schedule

LOG_START = dt.date(1976, 7, 1)


def change_events(changes: DataFrame, normalize: bool = True) -> DataFrame:
    """One row per (symbol, date): ``present_before`` is the state an undo of that day restores.

    Undoing a removal puts the symbol back, undoing an addition takes it out. When a
    symbol has both on one date the removal wins.
    """
    sym = feed_symbol if normalize else F.col
    added = changes.select("effective_date", sym("added_ticker").alias("symbol"), F.lit(False).alias("present_before"))
    removed = changes.select("effective_date", sym("removed_ticker").alias("symbol"), F.lit(True).alias("present_before"))
    return (
        added.unionByName(removed).where("symbol IS NOT NULL AND effective_date IS NOT NULL")
        .groupBy("symbol", "effective_date").agg(F.max("present_before").alias("present_before"))
    )


def membership_intervals(constituents: DataFrame, changes: DataFrame, normalize: bool = True) -> DataFrame:
    """Half-open ``[valid_from, valid_to)`` spans during which a symbol is a member; null = unbounded.

    A symbol's state at a date is what its earliest later event restores, or the
    current list when nothing follows.
    """
    sym = feed_symbol if normalize else F.col
    events = change_events(changes, normalize)
    before = W.partitionBy("symbol").orderBy("effective_date")
    past = (
        events.select(
            "symbol", F.lag("effective_date").over(before).alias("valid_from"),
            F.col("effective_date").alias("valid_to"), "present_before",
        ).where("present_before").drop("present_before")
    )
    last_event = events.groupBy("symbol").agg(F.max("effective_date").alias("valid_from"))
    current = constituents.select(sym("symbol").alias("symbol")).where("symbol IS NOT NULL").distinct()
    tail = current.join(last_event, "symbol", "left").select("symbol", "valid_from", F.lit(None).cast("date").alias("valid_to"))
    return past.unionByName(tail)


def membership_history(
    schedule: Schedule, constituents: DataFrame, changes: DataFrame, normalize: bool = True
) -> DataFrame:
    """Long ``(rebalance_date, symbol)``; only member rows are ever produced."""
    spans = membership_intervals(constituents, changes, normalize)
    # The schedule is one short sorted array; each span takes its slice of it, so no span meets a date outside it.
    dates = schedule.rows.agg(F.array_sort(F.collect_set("rebalance_date"))).scalar()
    first = lambda day: F.size(F.filter("_dates", lambda d: d < day))
    lo = F.when(F.col("valid_from").isNull(), 0).otherwise(first(F.col("valid_from")))
    hi = F.when(F.col("valid_to").isNull(), F.size("_dates")).otherwise(first(F.col("valid_to")))
    placed = spans.withColumn("_dates", dates).select("symbol", "_dates", lo.alias("_lo"), hi.alias("_hi")).where("_hi > _lo")
    return placed.select(F.explode(F.slice("_dates", F.col("_lo") + 1, F.col("_hi") - F.col("_lo"))).alias("rebalance_date"), "symbol")


def membership_at(as_of_date: dt.date | str, constituents: DataFrame, changes: DataFrame, normalize: bool = True) -> DataFrame:
    """Members on one date."""
    day = dt.date.fromisoformat(as_of_date) if isinstance(as_of_date, str) else as_of_date
    one = Schedule(constituents.sparkSession.range(1).select(F.lit(day).alias("rebalance_date")), 1)
    return membership_history(one, constituents, changes, normalize).select("symbol")


def coverage_notes(constituents: DataFrame, changes: DataFrame, log_start: dt.date = LOG_START) -> DataFrame:
    """One row: log span, current count, and members added before the log starts."""
    span = changes.agg(F.min("effective_date").alias("log_first"), F.max("effective_date").alias("log_last"))
    counts = constituents.agg(
        F.count(F.lit(1)).alias("n_current"),
        F.count_if(F.col("date_added") < F.lit(log_start)).alias("n_added_before_log"),
    )
    # Both sides are single rows.
    pick = lambda df: df.select(F.struct(*df.columns)).scalar()
    base = constituents.sparkSession.range(1).select(pick(span).alias("s"), pick(counts).alias("c"))
    return base.select("s.*", "c.*", F.lit(log_start).alias("log_start"))


def universe_size(constituents: DataFrame, changes: DataFrame, normalize: bool = True) -> DataFrame:
    """Distinct symbols that were ever in the index according to list and log."""
    sym = feed_symbol if normalize else F.col
    names = (
        constituents.select(sym("symbol").alias("symbol"))
        .unionByName(changes.select(sym("added_ticker").alias("symbol")))
        .unionByName(changes.select(sym("removed_ticker").alias("symbol")))
    )
    return names.agg(F.countDistinct("symbol").alias("universe_size"))
