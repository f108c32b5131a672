"""Factor panels, information coefficients, composites and quality scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from basketry.functions.columns import ratio
from basketry.operators.calendar import shifted, trailing_days
from basketry.sizing import Calendar, Schedule, mean_rank_in_group, quantiles_in_group

QUALITY_UP = ("returnOnEquity", "profitMargins", "earningsGrowth")
QUALITY_DOWN = ("debtToEquity",)


def date_moments(panel: DataFrame, keys: Sequence[str] = ("pos",)) -> DataFrame:
    return panel.where("raw IS NOT NULL").groupBy(*keys).agg(F.avg("raw").alias("_mean"), F.stddev_samp("raw").alias("_std"))


def scored(panel: DataFrame, moments: DataFrame, cal: Calendar, keys: Sequence[str] = ("pos",)) -> DataFrame:
    """``score`` of the raw values under the moments of their ``keys``; zero deviation gives no score."""
    rest = [c for c in ("factor", "symbol", "pos") if c in panel.columns]
    return (
        panel.where("raw IS NOT NULL").join(cal.hint(moments, 16), list(keys))
        .select(*rest, ratio(F.col("raw") - F.col("_mean"), "_std").alias("score"))
        .where("score IS NOT NULL")
    )


def zscore_by_date(panel: DataFrame, cal: Calendar) -> DataFrame:
    """``score`` centred and scaled per ``pos`` with the sample deviation; zero deviation gives no score."""
    return scored(panel, date_moments(panel), cal)


def raw_momentum(prices: DataFrame, cal: Calendar, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Return from ``lookback`` to ``skip`` calendar rows ago.

    Evaluated on the row ``skip`` back and moved forward, so a score exists even on a
    day the symbol itself has no quote.
    """
    return prices.select(
        "symbol", (F.col("pos") + skip).alias("pos"),
        (ratio("close", shifted("close", -(lookback - skip))) - 1).alias("raw"),
    ).where((F.col("pos") <= cal.last) & F.col("raw").isNotNull())


def momentum_scores(prices: DataFrame, cal: Calendar, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Momentum, z-scored."""
    return zscore_by_date(raw_momentum(prices, cal, lookback, skip), cal)


def raw_low_vol(returns: DataFrame, window: int = 90, periods_per_year: int = 252) -> DataFrame:
    """Negative annualised deviation of the last ``window`` returns (all present)."""
    frame = W.partitionBy("symbol").orderBy("pos").rangeBetween(-(window - 1), 0)
    full = F.count("ret").over(frame) == window
    vol = F.stddev_samp("ret").over(frame) * F.sqrt(F.lit(float(periods_per_year)))
    return returns.select("symbol", "pos", F.when(full, -vol).alias("raw")).where("raw IS NOT NULL")


def low_vol_scores(returns: DataFrame, cal: Calendar, window: int = 90, periods_per_year: int = 252) -> DataFrame:
    """Low volatility, z-scored."""
    return zscore_by_date(raw_low_vol(returns, window, periods_per_year), cal)


def raw_value(prices: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Trailing earnings per share over price."""
    eps = fundamentals.select("symbol", "trailingEps")
    return prices.join(eps, "symbol").select("symbol", "pos", ratio("trailingEps", "close").alias("raw")).where("raw IS NOT NULL")


def value_scores(prices: DataFrame, fundamentals: DataFrame, cal: Calendar) -> DataFrame:
    """Value, z-scored."""
    return zscore_by_date(raw_value(prices, fundamentals), cal)


def quality_scores(fundamentals: DataFrame) -> DataFrame:
    """Mean over available fields of population z-scores; leverage counts negatively.

    Absent columns are ignored. The field moments come back as one row.
    """
    fields = [(c, 1) for c in QUALITY_UP if c in fundamentals.columns]
    fields += [(c, -1) for c in QUALITY_DOWN if c in fundamentals.columns]
    if not fields:
        return fundamentals.select("symbol", F.lit(None).cast("double").alias("score"))
    moments = fundamentals.agg(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c, _ in fields], *[F.stddev_pop(c).alias(f"s_{c}") for c, _ in fields]).alias("m")
    )
    rows = fundamentals.withColumn("_m", moments.scalar())
    z = [ratio(sign * (F.col(c) - F.col(f"_m.m_{c}")), f"_m.s_{c}") for c, sign in fields]
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in z])
    present = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in z])
    return rows.select("symbol", ratio(total, present).alias("score"))


def snapshot_zscore(df: DataFrame, value: str, out: str = "zscore") -> DataFrame:
    """Whole-table population z-score; null everywhere when the deviation is zero."""
    moments = df.agg(F.struct(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).alias("x"))
    return df.withColumn("_m", moments.scalar()).withColumn(out, ratio(F.col(value) - F.col("_m.m"), "_m.s")).drop("_m")


def forward_returns(prices: DataFrame, horizon: int = 21) -> DataFrame:
    """Return over the next ``horizon`` calendar rows."""
    return prices.select("symbol", "pos", (ratio(shifted("close", horizon), "close") - 1).alias("fwd")).where("fwd IS NOT NULL")


def stack(panels: Mapping[str, DataFrame], value: str) -> DataFrame:
    """``(factor, symbol, pos, value)`` of all panels."""
    named = [df.select(F.lit(name).alias("factor"), "symbol", "pos", value) for name, df in panels.items()]
    return reduce(DataFrame.unionByName, named)


def stack_scores(panels: Mapping[str, DataFrame]) -> DataFrame:
    """``(factor, symbol, pos, score)`` of all panel factors."""
    return stack(panels, "score")


def pair_with_forward(scores: DataFrame, constants: Mapping[str, DataFrame], forward: DataFrame) -> DataFrame:
    """``(factor, symbol, pos, score, fwd)``: every valid score with its forward return.

    A date-constant score is paired with every forward return of its symbol.
    """
    parts = [scores.join(forward, ["symbol", "pos"]).select("factor", "symbol", "pos", "score", "fwd")]
    parts += [
        df.where("score IS NOT NULL").join(forward, "symbol").select(F.lit(name).alias("factor"), "symbol", "pos", "score", "fwd")
        for name, df in constants.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def information_coefficients(
    pairs: DataFrame, min_names: int = 10, n_symbols: int | None = None, task_rows: int | None = None
) -> DataFrame:
    """Spearman correlation of score and forward return per ``(factor, pos)`` over valid pairs.

    Ranks use ties' mean. Beyond one task's size the ranking spreads over value slices.
    """
    extra = {} if task_rows is None else {"task_rows": task_rows}
    keys = ["factor", "pos"]
    ranked = mean_rank_in_group(pairs, keys, "score", n_symbols, "_rs", **extra)
    ranked = mean_rank_in_group(ranked, keys, "fwd", n_symbols, "_rf", **extra)
    ic = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_names"), F.corr("_rs", "_rf").alias("ic"))
    return ic.where(F.col("n_names") >= min_names).withColumn("ic", F.nanvl("ic", F.lit(None).cast("double")))


def trailing_ic_weights(
    ic: DataFrame, segments: DataFrame, factor_names: Sequence[str], schedule: Schedule, lookback: int = 126, embargo: int = 0
) -> DataFrame:
    """``(rebalance_date, factor, weight)``: mean trailing IC clipped at zero and normalised, equal when none is positive.

    ``embargo`` moves the window back so that forward returns end before the refit.
    """
    window = trailing_days(segments, lookback, embargo).select("rebalance_date", "pos")
    means = (
        ic.join(window, "pos").groupBy("rebalance_date", "factor").agg(F.avg("ic").alias("_mean"))
    )
    grid = segments.select("rebalance_date", F.explode(F.array(*[F.lit(f) for f in factor_names])).alias("factor"))
    clipped = grid.join(means, ["rebalance_date", "factor"], "left").withColumn(
        "_ic", F.greatest(F.lit(0.0), F.coalesce("_mean", F.lit(0.0)))
    )
    total = F.sum("_ic").over(W.partitionBy("rebalance_date"))  # one row per factor in each group
    return clipped.select(
        "rebalance_date", "factor",
        F.when(total > 0, F.col("_ic") / total).otherwise(F.lit(1.0 / len(factor_names))).alias("weight"),
    )


def scores_at_segment_start(scores: DataFrame, constants: Mapping[str, DataFrame], segments: DataFrame, schedule: Schedule) -> DataFrame:
    """``(rebalance_date, factor, symbol, score)``: each factor's row on the segment start, or its constant."""
    starts = schedule.hint(segments.select("rebalance_date", F.col("sp").alias("pos")))
    parts = [scores.join(starts, "pos").select("rebalance_date", "factor", "symbol", "score")]
    if constants:
        dates = segments.agg(F.collect_list("rebalance_date").alias("d"))  # bounded by the schedule
        parts += [
            df.where("score IS NOT NULL").select(
                F.explode(dates.scalar()).alias("rebalance_date"), F.lit(name).alias("factor"), "symbol", "score"
            )
            for name, df in constants.items()
        ]
    return reduce(DataFrame.unionByName, parts)


def composite_scores(start_scores: DataFrame, ic_weights: DataFrame, schedule: Schedule, n_factors: int) -> DataFrame:
    """``(rebalance_date, symbol, composite)``: mean over available factors, weights renormalised; null when they sum to zero."""
    w = schedule.hint(ic_weights, n_factors)
    return (
        start_scores.where("score IS NOT NULL").join(w, ["rebalance_date", "factor"])
        .groupBy("rebalance_date", "symbol")
        .agg(ratio(F.sum(F.col("weight") * F.col("score")), F.sum("weight")).alias("composite"))
        .where("composite IS NOT NULL")
    )


def composite_quantiles(composite: DataFrame, probs: Mapping[str, float], n_symbols: int | None) -> DataFrame:
    """Exact interpolated quantiles of the composite per rebalance."""
    return quantiles_in_group(composite, ["rebalance_date"], "composite", dict(probs), n_symbols)


def exposure_differential(portfolio: DataFrame, benchmark: DataFrame, composite: DataFrame) -> DataFrame:
    """Weighted mean composite of portfolio minus benchmark per rebalance, over scored names only."""
    p = portfolio.select("rebalance_date", "symbol", F.col("weight").alias("wp"))
    b = benchmark.select("rebalance_date", "symbol", F.col("weight").alias("wb"))
    both = p.join(b, ["rebalance_date", "symbol"], "full_outer").join(
        composite.where("composite IS NOT NULL"), ["rebalance_date", "symbol"]
    )
    mean = lambda w: ratio(F.sum(F.col(w) * F.col("composite")), F.sum(F.when(F.col("composite").isNotNull(), F.col(w))))
    return both.groupBy("rebalance_date").agg(
        mean("wp").alias("portfolio_exposure"), mean("wb").alias("benchmark_exposure")
    ).withColumn("exposure_differential", F.col("portfolio_exposure") - F.col("benchmark_exposure"))
