"""Volatility regimes of a reference series and regime-conditional statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from basketry.functions.columns import compounded_from_mean, ratio
from basketry.operators.calendar import shifted
from basketry.operators.running import running_quantiles

LABELS = ("calm", "normal", "volatile")


def number_series(levels: DataFrame, key: str = "ticker") -> DataFrame:
    """``pos`` of each row in its own series; one series is bounded by its calendar."""
    return levels.withColumn("pos", (F.row_number().over(W.partitionBy(key).orderBy("date")) - 1).cast("bigint"))


def rolling_vol(levels: DataFrame, key: str = "ticker", window: int = 21, periods_per_year: float = 252) -> DataFrame:
    """Annualised sample deviation of the last ``window`` log returns, null until all are present."""
    logs = levels.withColumn("_log", F.ln(ratio("close", shifted("close", -1, [key]))))
    frame = W.partitionBy(key).orderBy("pos").rangeBetween(-(window - 1), 0)
    vol = F.when(F.count("_log").over(frame) == window, F.stddev_samp("_log").over(frame) * F.sqrt(F.lit(float(periods_per_year))))
    return logs.withColumn("vol", vol).drop("_log")


def regime_thresholds(vols: DataFrame, low_q: float = 1 / 3, high_q: float = 2 / 3) -> DataFrame:
    """Interpolated quantiles of each ticker over its whole history."""
    return vols.groupBy("ticker").agg(
        F.percentile("vol", F.lit(low_q)).alias("low_threshold"), F.percentile("vol", F.lit(high_q)).alias("high_threshold")
    ).select("ticker", F.lit(low_q).alias("low_quantile"), F.lit(high_q).alias("high_quantile"), "low_threshold", "high_threshold")


def classify(vols: DataFrame, low_q: float = 1 / 3, high_q: float = 2 / 3) -> DataFrame:
    """Adds ``label``: calm at or below the low threshold of its ticker, volatile at or above the high one. Without
    a ``ticker`` column all rows are one series."""
    if "ticker" not in vols.columns:
        return classify(vols.withColumn("ticker", F.lit("")), low_q, high_q).drop("ticker")
    cut = regime_thresholds(vols, low_q, high_q).select("ticker", F.struct("low_threshold", "high_threshold").alias("_t"))
    label = (
        F.when(F.col("vol").isNull(), F.lit(None).cast("string"))
        .when(F.col("vol") <= F.col("_t.low_threshold"), "calm")
        .when(F.col("vol") >= F.col("_t.high_threshold"), "volatile").otherwise("normal")
    )
    return vols.join(cut, "ticker").withColumn("label", label).drop("_t")


def expanding_thresholds(vols: DataFrame, rows_bound: int | None, low_q: float = 1 / 3, high_q: float = 2 / 3) -> DataFrame:
    """``(ticker, date, n_seen, low_threshold, high_threshold)``: quantiles of what each ticker has shown up to each date."""
    return running_quantiles(vols, "ticker", "date", "vol", {"low_threshold": low_q, "high_threshold": high_q}, rows_bound)


def classify_expanding(vols: DataFrame, rows_bound: int | None, low_q: float = 1 / 3, high_q: float = 2 / 3, least: int = 21) -> DataFrame:
    """Adds ``label`` by the thresholds known on each date, so no later day moves an earlier label; null before ``least``
    days have been seen."""
    cut = expanding_thresholds(vols, rows_bound, low_q, high_q)
    label = (
        F.when(F.col("vol").isNull() | (F.col("n_seen") < least), F.lit(None).cast("string"))
        .when(F.col("vol") <= F.col("low_threshold"), "calm").when(F.col("vol") >= F.col("high_threshold"), "volatile").otherwise("normal")
    )
    return vols.join(cut, ["ticker", "date"], "left").withColumn("label", label).drop("n_seen", "low_threshold", "high_threshold")


def reference_levels(index_level: DataFrame, ticker: str | None = None) -> DataFrame:
    """The levels of one index, by default of the first by name; a date that it has twice is an error."""
    chosen = index_level.agg(F.min("ticker")).scalar() if ticker is None else F.lit(ticker)
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.format_string("%s: two levels on %s", F.first("ticker"), "date")).cast("double"))
    levels = index_level.where(F.col("ticker") == chosen).groupBy("ticker", "date")
    return levels.agg(once.otherwise(F.first("close")).alias("close"))


def regime_labels(
    index_level: DataFrame, window: int = 21, periods_per_year: float = 252, ticker: str | None = None, thresholds: str = "full",
    rows_bound: int | None = None,
) -> DataFrame:
    """``(date, vol, label)`` of one index, a row per date. ``thresholds``: ``full`` takes the quantiles of the whole history,
    ``expanding`` those of the days up to each date."""
    if thresholds not in ("full", "expanding"):
        raise ValueError(f"thresholds are full or expanding, not {thresholds}")
    vols = rolling_vol(number_series(reference_levels(index_level, ticker)), "ticker", window, periods_per_year)
    labelled = classify(vols) if thresholds == "full" else classify_expanding(vols, rows_bound)
    return labelled.select("date", "vol", "label")


def day_counts(labels: DataFrame) -> DataFrame:
    return labels.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n_days"))


def current_regime(labels: DataFrame) -> DataFrame:
    return labels.agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.col("date"))).alias("current_regime"))


def attach_labels(returns: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on the date, never filled: days without a label stay unlabelled."""
    return returns.join(labels.select("date", F.col("label").alias("regime")), "date", "left")


def conditional_stats(returns: DataFrame, labels: DataFrame, min_days: int = 30, periods_per_year: float = 252) -> DataFrame:
    """Per (strategy, regime): compounded return, volatility, their ratio and the day count."""
    stats = _per_regime(returns, labels, periods_per_year).where(F.col("n_days") >= min_days)
    return stats.withColumn(
        "sharpe_zero_rate", F.when(F.col("annualized_vol") > 0, F.col("annualized_return") / F.col("annualized_vol"))
    )


def skipped_regimes(returns: DataFrame, labels: DataFrame, min_days: int = 30) -> DataFrame:
    """Regimes left out for too few days, with the note text."""
    few = _per_regime(returns, labels, 1).where(F.col("n_days") < min_days)
    # Fixed value: wording of the note.
    note = F.format_string("%s: only %d days (< %d) -- skipped, too few observations.", "regime", "n_days", F.lit(min_days))
    return few.select("strategy", "regime", "n_days", note.alias("note"))


def _per_regime(returns: DataFrame, labels: DataFrame, periods_per_year: float) -> DataFrame:
    return (
        attach_labels(returns, labels).where("regime IS NOT NULL").groupBy("strategy", "regime").agg(
            compounded_from_mean(F.avg("ret"), periods_per_year).alias("annualized_return"),
            (F.stddev_samp("ret") * F.sqrt(F.lit(float(periods_per_year)))).alias("annualized_vol"),
            F.count(F.lit(1)).alias("n_days"),
        )
    )


def regime_pivot(stats: DataFrame, value: str, labels: Sequence[str] = LABELS) -> DataFrame:
    return stats.groupBy("strategy").pivot("regime", list(labels)).agg(F.first(value))


def regime_excess(stats: DataFrame, strategy: str = "min_vol", benchmark: str = "full_replication") -> DataFrame:
    """Return of one strategy over another per regime."""
    other = stats.where(F.col("strategy") == benchmark).select("regime", F.col("annualized_return").alias("_b"))
    return stats.where(F.col("strategy") == strategy).join(other, "regime").select(
        "regime", (F.col("annualized_return") - F.col("_b")).alias("excess_annualized_return")
    )
