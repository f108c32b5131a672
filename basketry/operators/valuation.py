"""Buy-and-hold valuation of weight histories, chained across rebalances.

A segment's growth is ``sum(weight * price(d) / price(start))``; the value carried
into a segment is the product of the earlier segments' end growths. That turns a
sequential simulation into one join by symbol and a window over a tiny table.
Prices are never filled over the whole calendar: quotes are merged with the segments,
and days are written out for held names alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from basketry.functions.columns import ratio
from basketry.sizing import Calendar


def segment_growth(weights: DataFrame, spans: DataFrame, normalize: bool = False) -> DataFrame:
    """``(strategy, rebalance_date, pos, growth)`` of every holding segment.

    ``spans`` are the quotes merged with the segments (``held_spans``). Without ``normalize`` a carried quote may
    price the start (full replication). With it the start needs a real quote and the
    path is rebased to 1, so a name that has none drops out of the portfolio.
    """
    growth = held_days(units_held(weights, spans, normalize), spans).groupBy("strategy", "rebalance_date", "pos").agg(F.sum("value").alias("growth"))
    if not normalize:
        return growth
    first = W.partitionBy("strategy", "rebalance_date").orderBy("pos")
    return growth.withColumn("growth", ratio("growth", F.first("growth").over(first)))


def units_held(weights: DataFrame, spans: DataFrame, quoted: bool) -> DataFrame:
    """``(strategy, rebalance_date, symbol, units)`` bought at the start of a segment."""
    opening = spans.where(F.col("first") == F.col("sp"))
    opening = (opening.where("quoted") if quoted else opening).select("rebalance_date", "symbol", F.col("close").alias("_open"))
    return weights.join(opening, ["rebalance_date", "symbol"]).select(
        "strategy", "rebalance_date", "symbol", ratio("weight", "_open").alias("units")
    )


def held_days(units: DataFrame, spans: DataFrame) -> DataFrame:
    """``(strategy, rebalance_date, pos, value)``: days are written out behind the join, so there is one row a held day and no other."""
    held = units.join(spans.select("rebalance_date", "symbol", "first", "last", "close"), ["rebalance_date", "symbol"])
    return held.select(
        "strategy", "rebalance_date", (F.col("units") * F.col("close")).alias("value"), F.explode(F.sequence("first", "last")).alias("pos")
    )


def chain_segments(growth: DataFrame, cal: Calendar) -> DataFrame:
    """``(strategy, pos, date, value)`` starting at 1; a boundary day keeps the earlier segment's value.

    Everything after the aggregation runs on one shuffle by strategy: the value carried
    into a segment is the product of the end growths of all segments with an earlier
    rebalance date.
    """
    in_order = W.partitionBy("strategy").orderBy("rebalance_date", "pos")
    following = F.lead("rebalance_date").over(in_order)
    ends_here = following.isNull() | (following != F.col("rebalance_date"))
    earlier = W.partitionBy("strategy").orderBy(F.unix_date("rebalance_date")).rangeBetween(W.unboundedPreceding, -1)
    seen = F.max("pos").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    return (
        growth.withColumn("_end", F.when(ends_here, F.col("growth"))).withColumn("_seen", seen)
        .withColumn("value", F.coalesce(F.product("_end").over(earlier), F.lit(1.0)) * F.col("growth"))
        .where("_seen IS NULL OR pos > _seen")
        .join(cal.hint(cal.rows), "pos").select("strategy", "pos", "date", "value")
    )


FLAT = 1e-12  # summation noise: a carried value that should not have moved


def value_returns(values: DataFrame) -> DataFrame:
    """``(strategy, pos, date, ret)`` between consecutive valued days of each strategy.

    Moves below ``FLAT`` are exact zeros, so that win rates and downside deviations do
    not depend on the order in which a carried value was summed.
    """
    before = F.lag("value").over(W.partitionBy("strategy").orderBy("pos"))
    move = ratio("value", before) - 1
    return values.select("strategy", "pos", "date", F.when(F.abs(move) < FLAT, 0.0).otherwise(move).alias("ret")).where("ret IS NOT NULL")


def simulate(weights: DataFrame, spans: DataFrame, cal: Calendar, normalize: bool) -> DataFrame:
    """Chained value of every strategy in ``weights``."""
    return chain_segments(segment_growth(weights, spans, normalize), cal)


def replication_values(cap_weights: DataFrame, spans: DataFrame, cal: Calendar) -> DataFrame:
    """Full cap-weighted replication."""
    named = cap_weights.withColumn("strategy", F.lit("full_replication"))
    return simulate(named, spans, cal, normalize=False)


def forward_tracking_error(growth: DataFrame, benchmark_returns: DataFrame, by: list[str], periods_per_year: float = 252) -> DataFrame:
    """Tracking error of every holding segment against the benchmark on the same days."""
    in_order = W.partitionBy(*by, "rebalance_date").orderBy("pos")
    own = growth.withColumn("ret", ratio("growth", F.lag("growth").over(in_order)) - 1).where("ret IS NOT NULL")
    pairs = own.join(benchmark_returns.select("pos", F.col("ret").alias("bench_ret")), "pos")
    te = F.stddev_samp(F.col("ret") - F.col("bench_ret")) * F.sqrt(F.lit(float(periods_per_year)))
    return pairs.groupBy(*by, "rebalance_date").agg(te.alias("tracking_error"))


def lost_weight(weights: DataFrame, start_prices: DataFrame) -> DataFrame:
    """Per strategy and rebalance: names held without a quote on the start row, and the weight they carry.

    The rebased valuation drops these names; this says how much that is.
    """
    quoted = start_prices.where("close IS NOT NULL AND close <> 0").select("rebalance_date", "symbol", F.lit(True).alias("_quoted"))
    rows = weights.join(quoted, ["rebalance_date", "symbol"], "left")
    return rows.groupBy("strategy", "rebalance_date").agg(
        F.count_if(F.col("_quoted").isNull()).alias("n_unquoted"),
        F.coalesce(F.sum(F.when(F.col("_quoted").isNull(), F.col("weight"))), F.lit(0.0)).alias("lost_weight"),
    )
