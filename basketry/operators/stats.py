"""Tracking, performance and tabular statistics of return series.

Inputs are long series ``(<by...>, date|pos, ret[, bench_ret])``, one row per
strategy-day, so windows per strategy are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from basketry.functions.columns import compounded_from_mean, ratio

ZERO_VOL = 1e-9


def align(returns: DataFrame, benchmark: DataFrame, on: str = "date") -> DataFrame:
    """Inner join on the day, rows with a null on either side dropped; adds ``bench_ret``."""
    bench = benchmark.select(on, F.col("ret").alias("bench_ret"))
    return returns.join(bench, on).where("ret IS NOT NULL AND bench_ret IS NOT NULL")


def tracking_error_col(periods_per_year: float) -> Column:
    """Annualised sample deviation of active returns; null below two pairs."""
    return F.stddev_samp(F.col("ret") - F.col("bench_ret")) * F.sqrt(F.lit(float(periods_per_year)))


def tracking_error(pairs: DataFrame, by: Sequence[str] = ("strategy",), periods_per_year: float = 252) -> DataFrame:
    return pairs.groupBy(*by).agg(tracking_error_col(periods_per_year).alias("tracking_error"))


def tracking_summary(pairs: DataFrame, by: Sequence[str] = ("strategy",), periods_per_year: float = 252) -> DataFrame:
    """Tracking error, mean active return, correlation, pair count, difference of compounded returns."""
    return pairs.groupBy(*by).agg(
        tracking_error_col(periods_per_year).alias("tracking_error_annualized"),
        (F.avg(F.col("ret") - F.col("bench_ret")) * periods_per_year).alias("mean_active_return_annualized"),
        F.corr("ret", "bench_ret").alias("correlation"),
        F.count(F.lit(1)).alias("n_periods"),
        (F.product(1 + F.col("ret")) - F.product(1 + F.col("bench_ret"))).alias("cumulative_active_return"),
    )


def strategy_summary(returns: DataFrame, benchmark: DataFrame, periods_per_year: float = 252) -> DataFrame:
    """Per strategy: compounded mean return, volatility, tracking error and correlation to the benchmark."""
    own = returns.groupBy("strategy").agg(
        compounded_from_mean(F.avg("ret"), periods_per_year).alias("annualized_return"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(float(periods_per_year)))).alias("annualized_vol"),
        F.count("ret").alias("n_days"),
    )
    tracked = tracking_summary(align(returns, benchmark), ("strategy",), periods_per_year).select(
        "strategy", F.col("tracking_error_annualized").alias("tracking_error_vs_full_replication"), "correlation"
    )
    return own.join(tracked, "strategy", "left")


def _sharpe(excess: Column, denominator: Column, periods_per_year: float) -> Column:
    ok = (denominator >= ZERO_VOL) | denominator.isNull()
    return F.when(ok, F.avg(excess) / denominator * F.sqrt(F.lit(float(periods_per_year))))


def metric_columns(periods_per_year: float = 252, risk_free: float = 0.0) -> dict[str, Column]:
    """Order-free metrics of a return series as aggregates over ``ret``.

    CAGR compounds from a starting 1, which counts as a point: its exponent is
    ``periods / (n + 1)``. Sortino divides by the deviation of the negative excesses.
    """
    excess = F.col("ret") - risk_free / periods_per_year
    growth = F.product(1 + F.col("ret"))
    down = F.stddev_samp(F.when(excess < 0, excess))
    return {
        "cagr": F.when(growth >= 0, F.pow(growth, F.lit(float(periods_per_year)) / (F.count("ret") + 1)) - 1),
        "sharpe_ratio": _sharpe(excess, F.stddev_samp(excess), periods_per_year),
        "sortino_ratio": _sharpe(excess, down, periods_per_year),
        "win_rate": F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)),
    }


def cumulative_growth(returns: DataFrame, by: Sequence[str] = ("strategy",), order: str = "date") -> DataFrame:
    """Adds ``value``, the running product of ``1 + ret`` from a start of 1."""
    path = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return returns.withColumn("value", F.product(1 + F.col("ret")).over(path))


def running_drawdown(values: DataFrame, by: Sequence[str] = ("strategy",), order: str = "date", floor: float | None = None) -> DataFrame:
    """Adds ``peak`` and ``drawdown = 1 - value / peak``; ``floor`` is an initial peak."""
    path = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    peak = F.max("value").over(path)
    if floor is not None:
        peak = F.greatest(peak, F.lit(float(floor)))
    return values.withColumn("peak", peak).withColumn("drawdown", 1 - ratio("value", "peak"))


def performance(returns: DataFrame, by: Sequence[str] = ("strategy",), order: str = "date", periods_per_year: float = 252, risk_free: float = 0.0) -> DataFrame:
    """CAGR, Sharpe, Sortino, max drawdown and win rate of return series (equity starts at 1)."""
    valid = returns.where("ret IS NOT NULL")
    curve = running_drawdown(cumulative_growth(valid, by, order), by, order, floor=1.0)
    metrics = metric_columns(periods_per_year, risk_free)
    return curve.groupBy(*by).agg(*[c.alias(n) for n, c in metrics.items()], F.max("drawdown").alias("max_drawdown"))


def equity_performance(values: DataFrame, by: Sequence[str] = ("strategy",), order: str = "date", periods_per_year: float = 252) -> DataFrame:
    """The same five metrics from an equity curve; CAGR's years count every point."""
    in_order = W.partitionBy(*by).orderBy(order)
    curve = running_drawdown(values, by, order).withColumn("ret", ratio("value", F.lag("value").over(in_order)) - 1)
    first, last = F.min_by("value", order), F.max_by("value", order)
    n = F.count("value")
    grown = ratio(last, first)
    metrics = metric_columns(periods_per_year)
    metrics["cagr"] = F.when((n >= 2) & (first > 0) & (grown >= 0), F.pow(grown, F.lit(float(periods_per_year)) / n) - 1)
    metrics["win_rate"] = F.avg(F.when(F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0))
    return curve.groupBy(*by).agg(*[c.alias(k) for k, c in metrics.items()], F.max("drawdown").alias("max_drawdown"))


def portfolio_returns(weights: DataFrame, returns: DataFrame, days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fixed-weight return per problem and day: ``sum(w * r)`` over the days of the problem."""
    return (
        weights.join(returns, "symbol").join(days, ["rebalance_date", "pos"])
        .groupBy(*keys, "pos").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    )


def sampling_curve(results: DataFrame) -> DataFrame:
    """Mean names, mean and median tracking error and period count per (method, target)."""
    return results.where("tracking_error IS NOT NULL").groupBy("method", "target_n").agg(
        F.avg("actual_n").alias("mean_actual_n"), F.avg("tracking_error").alias("mean_tracking_error"),
        F.percentile("tracking_error", F.lit(0.5)).alias("median_tracking_error"),
        F.count("tracking_error").alias("n_periods"),
    )


def period_returns(prices: DataFrame, first_pos, last_pos) -> DataFrame:
    """Return per symbol between two trading rows, from unfilled quotes."""
    ends = prices.where((F.col("pos") == first_pos) | (F.col("pos") == last_pos)).groupBy("symbol").agg(
        F.max(F.when(F.col("pos") == first_pos, F.col("close"))).alias("_a"),
        F.max(F.when(F.col("pos") == last_pos, F.col("close"))).alias("_b"),
    )
    return ends.select("symbol", (ratio("_b", "_a") - 1).alias("ret"))
