"""Consolidated comparison table and the sentences derived from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from basketry.functions.columns import compounded_from_mean, dollars, plain_percent, signed_percent
from basketry.operators import bootstrap, regime, stats

BENCHMARK = "full_replication"


def with_all_regime(rows: DataFrame) -> DataFrame:
    """Each labelled row counts once under its regime and once under ``all``."""
    both = F.array_compact(F.array(F.lit("all"), F.col("regime")))
    return rows.withColumn("regime", F.explode(both))


def comparison_table(
    adjusted: DataFrame, benchmark: DataFrame, labels: DataFrame, metadata: DataFrame, block_length: int = 20,
    n_resamples: int = 2000, confidence: float = 0.95, seed: int = 42, source: str = "hash", periods_per_year: float = 252,
    settings: dict[str, str] | None = None,
) -> DataFrame:
    """Strategy x aum x {all, regimes}: gross and cost-adjusted return, Sharpe and tracking error with intervals.

    ``adjusted`` has ``strategy, aum, date, ret, gross_ret``. Cells with fewer days than
    one block are skipped.
    """
    by = ["strategy", "aum", "regime"]
    rows = with_all_regime(regime.attach_labels(stats.align(adjusted, benchmark), labels))
    per = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"), compounded_from_mean(F.avg("gross_ret"), periods_per_year).alias("gross_annualized_return")
    ).where(F.col("n_days") >= block_length)
    wanted = {"cagr": "cost_adjusted_return", "sharpe_ratio": "sharpe", "tracking_error": "tracking_error"}
    boot = bootstrap.bootstrap_metrics(
        rows, by, block_length, n_resamples, confidence, "date", seed, source, periods_per_year, "skip", list(wanted)
    )
    cells = []
    for metric, out in wanted.items():
        for col, suffix in (("point_estimate", ""), ("ci_low", "_ci_low"), ("ci_high", "_ci_high")):
            cells.append(F.max(F.when(F.col("metric") == metric, F.col(col))).alias(out + suffix))
    wide = boot.groupBy(*by).agg(*cells)
    family = F.when(F.col("strategy") == BENCHMARK, "benchmark").otherwise("smart_beta")
    table = per.join(wide, by).join(metadata, "strategy", "left").select(
        "strategy", family.alias("strategy_family"), "aum", "regime", "name_count", "mean_one_way_turnover", "n_days",
        "gross_annualized_return", *[out + s for out in wanted.values() for s in ("", "_ci_low", "_ci_high")],
    )
    if settings:
        pairs = [x for k, v in sorted(settings.items()) for x in (F.lit(k), F.lit(v))]
        table = table.withColumn("settings", F.create_map(*pairs))
    return table


def findings(comparison: DataFrame, sampling: DataFrame | None = None) -> DataFrame:
    """``(seq, text)``: per fund size the best variant against the benchmark, the low-volatility claim in
    volatile regimes, and the best sampling method per target count."""
    # Fixed values below: the wording of each sentence is part of the result.
    bench = comparison.where(F.col("strategy") == BENCHMARK).select("aum", "regime", F.col("cost_adjusted_return").alias("_b"))
    overall = comparison.where("regime = 'all' AND strategy_family = 'smart_beta' AND cost_adjusted_return IS NOT NULL")
    best = overall.groupBy("aum").agg(
        F.min_by(F.struct("strategy", "cost_adjusted_return"), F.struct(-F.col("cost_adjusted_return"), F.col("strategy"))).alias("w")
    ).join(bench.where("regime = 'all'"), "aum")
    excess = F.col("w.cost_adjusted_return") - F.col("_b")
    first = best.select(
        F.lit(1).alias("section"), F.col("aum").alias("k"),
        F.concat(
            F.lit("At "), dollars("aum"), F.lit(" AUM, "), F.col("w.strategy"), F.when(excess > 0, " beat").otherwise(" did not beat"),
            F.lit(" full replication after costs ("), signed_percent(excess), F.lit(" annualized difference)."),
        ).alias("text"),
    )
    low_vol = comparison.where("regime = 'volatile' AND strategy = 'min_vol'").join(bench.where("regime = 'volatile'").drop("regime"), "aum")
    gap = F.col("cost_adjusted_return") - F.col("_b")
    second = low_vol.select(
        F.lit(2).alias("section"), F.col("aum").alias("k"),
        F.concat(
            F.lit("In volatile regimes at "), dollars("aum"), F.lit(" AUM, min_vol "),
            F.when(gap > 0, "outperformed").otherwise("underperformed"), F.lit(" full replication by "), signed_percent(gap),
            F.lit(" annualized; the low-vol claim is therefore regime-specific evidence, not a universal conclusion."),
        ).alias("text"),
    )
    parts = [first, second]
    if sampling is not None:
        valid = sampling.where("mean_tracking_error IS NOT NULL")
        te_of = lambda m: F.max(F.when(F.col("method") == m, F.col("mean_tracking_error")))
        per = valid.groupBy("target_n").agg(
            F.min_by(F.struct("method", "mean_tracking_error"), F.struct("mean_tracking_error", "method")).alias("w"),
            (te_of("lasso") - te_of("optimization")).alias("_delta"),
        )
        parts.append(per.select(
            F.lit(3).alias("section"), F.col("target_n").cast("double").alias("k"),
            F.concat(
                F.lit("At target "), F.col("target_n").cast("string"), F.lit(" names, "), F.col("w.method"),
                F.lit(" had the lowest mean out-of-sample tracking error ("), plain_percent("w.mean_tracking_error"), F.lit(")"),
                F.coalesce(F.concat(F.lit("; LASSO minus optimization TE was "), signed_percent("_delta")), F.lit("")), F.lit("."),
            ).alias("text"),
        ))
    from pyspark.sql import Window as W

    ordered = reduce(DataFrame.unionByName, parts)  # a few sentences
    return ordered.select(F.row_number().over(W.orderBy("section", "k")).cast("bigint").alias("seq"), "text")


def best_by_aum(comparison: DataFrame) -> DataFrame:
    """Best strategy per fund size over all days, ties by name."""
    return comparison.where("regime = 'all'").groupBy("aum").agg(
        F.min_by("strategy", F.struct(-F.col("cost_adjusted_return"), F.col("strategy"))).alias("best_strategy"),
        F.max("cost_adjusted_return").alias("cost_adjusted_return"),
    )


def best_by_target(sampling: DataFrame) -> DataFrame:
    return sampling.where("mean_tracking_error IS NOT NULL").groupBy("target_n").agg(
        F.min_by("method", F.struct("mean_tracking_error", "method")).alias("best_method"),
        F.min("mean_tracking_error").alias("mean_tracking_error"),
    )


def beating_benchmark(point_estimates: DataFrame, value: str = "cagr") -> DataFrame:
    """Per fund size: the benchmark's value and the strategies above it, as a sorted array (a handful of names)."""
    bench = point_estimates.where(F.col("strategy") == BENCHMARK).select("aum", F.col(value).alias("benchmark_value"))
    others = point_estimates.where(F.col("strategy") != BENCHMARK).join(bench, "aum")
    return others.groupBy("aum").agg(
        F.max("benchmark_value").alias("benchmark_value"),
        F.sort_array(F.collect_list(F.when(F.col(value) > F.col("benchmark_value"), F.col("strategy")))).alias("beating"),
    )
