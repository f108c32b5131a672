"""Every registered query: ``name -> (spark, sf_dir) -> DataFrame``.

Outputs are rounded and integers widened so that they compare with SQL engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.operators import (
    bootstrap as BS, calendar as C, comparison as Q, costs as K, factors as X, fits as FT, fundamentals as KN, marketcap as MC, membership as M,
    regime as R, risk as L, stats as G, valuation as V, weights as B,
)
from basketry.plans import named, studies
from basketry.plans.market import Market, numbered_prices, supplied_market
from basketry.schemas import key_violations
from basketry.session import materialize, shared_dir, tune
from basketry.sources import cleaning, fixtures, results, store
from basketry.streaming import monitor as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    """Register a query that reads the supplied market."""
    def wrap(fn: Callable[[Market], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(supplied_market(spark, sf_dir))
        return fn

    return wrap


def raw_query(name: str):
    """Register a query that reads the supplied tables directly."""
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        return fn

    return wrap


def tidy(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named double columns; adding zero turns a negative zero into a plain one."""
    return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})


# --- panels, calendar, joins -------------------------------------------------------------

@query("price_panel")
def price_panel(m: Market) -> DataFrame:
    return m.prices.select("symbol", "date", "pos", "close", "volume")


@query("trading_calendar")
def trading_calendar(m: Market) -> DataFrame:
    return m.cal.rows


@query("rebalance_schedule")
def rebalance_schedule(m: Market) -> DataFrame:
    return m.schedule.rows


@query("holding_segments")
def holding_segments(m: Market) -> DataFrame:
    return m.segments


@query("simple_returns")
def simple_returns(m: Market) -> DataFrame:
    return tidy(m.returns, ret=9)


@query("forward_filled_panel")
def forward_filled_panel(m: Market) -> DataFrame:
    return C.forward_fill(fixtures.gappy(m.prices), m.cal)


# --- membership and caps -----------------------------------------------------------------

@query("membership_history")
def membership_history(m: Market) -> DataFrame:
    return m.members


@query("membership_at_date")
def membership_at_date(m: Market) -> DataFrame:
    return M.membership_at("1998-09-18", m.constituents, m.changes)


@query("membership_coverage_notes")
def membership_coverage_notes(m: Market) -> DataFrame:
    return M.coverage_notes(m.constituents, m.changes)


@query("universe_size")
def universe_size(m: Market) -> DataFrame:
    return M.universe_size(m.constituents, m.changes)


@query("market_caps")
def market_caps(m: Market) -> DataFrame:
    return m.caps.select("symbol", "pos", "market_cap")


@query("market_cap_coverage")
def market_cap_coverage(m: Market) -> DataFrame:
    return tidy(MC.coverage_report(m.prices, m.shares), coverage_fraction=9)


@query("missing_share_counts")
def missing_share_counts(m: Market) -> DataFrame:
    return MC.missing_shares(m.prices, m.anchors)


@query("rebalance_coverage")
def rebalance_coverage(m: Market) -> DataFrame:
    valid = m.members.join(m.schedule.hint(m.segments.select("rebalance_date")), "rebalance_date", "left_semi")
    return tidy(MC.rebalance_coverage(valid, m.cap_weights), coverage_fraction=9)


@query("rebalance_coverage_summary")
def rebalance_coverage_summary(m: Market) -> DataFrame:
    return tidy(MC.coverage_summary(rebalance_coverage(m)), min_coverage=9, max_coverage=9, mean_coverage=8)


# --- weights and replication -------------------------------------------------------------

@query("cap_weights")
def cap_weights(m: Market) -> DataFrame:
    return tidy(m.cap_weights, weight=9)


@query("equal_weights")
def equal_weights(m: Market) -> DataFrame:
    return tidy(B.equal_weights(m.members, m.start_prices, m.schedule), weight=9)


@query("replication_values")
def replication_values(m: Market) -> DataFrame:
    out = m.benchmark_values.join(m.benchmark_returns.select("pos", "ret"), "pos", "left")
    return tidy(out.select("date", "value", "ret"), value=9, ret=9)


# --- factors -----------------------------------------------------------------------------

@query("momentum_scores")
def momentum_scores(m: Market) -> DataFrame:
    return tidy(m.factor_panels["momentum"], score=8)


@query("low_vol_scores")
def low_vol_scores(m: Market) -> DataFrame:
    return tidy(m.factor_panels["low_vol"], score=8)


@query("value_scores")
def value_scores(m: Market) -> DataFrame:
    return tidy(m.factor_panels["value"], score=8)


@query("quality_scores")
def quality_scores(m: Market) -> DataFrame:
    return tidy(m.quality, score=8)


# --- fundamentals as they were known --------------------------------------------------------

STATED = ("returnOnEquity", "profitMargins", "earningsGrowth", "debtToEquity", "trailingEps")
_dated: dict[int, Market] = {}


def dated_market(m: Market, reports: DataFrame) -> Market:
    """The same market over dated fundamentals, derived once for each market."""
    if id(m) not in _dated or _dated[id(m)].prices is not m.prices:
        _dated[id(m)] = replace(m, fundamentals=reports)
    return _dated[id(m)]


def known_query(name: str):
    """Register a query that reads the supplied market with fundamentals as they were known on each date."""
    def wrap(fn: Callable[[Market], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(dated_market(supplied_market(spark, sf_dir), fixtures.dated_fundamentals(spark, sf_dir)))
        return fn

    return wrap


@known_query("fundamentals_known")
def fundamentals_known(m: Market) -> DataFrame:
    return tidy(KN.known_intervals(m.fundamentals, STATED), **dict.fromkeys(STATED, 9))


@known_query("fundamentals_at_rebalances")
def fundamentals_at_rebalances(m: Market) -> DataFrame:
    return tidy(KN.known_at_rebalances(m.fundamentals, STATED, m.schedule), **dict.fromkeys(STATED, 9))


@known_query("quality_scores_known")
def quality_scores_known(m: Market) -> DataFrame:
    return tidy(m.quality, score=8)


@known_query("quality_panel_known")
def quality_panel_known(m: Market) -> DataFrame:
    return tidy(m.factor_panels["quality"], score=8)


@known_query("value_scores_known")
def value_scores_known(m: Market) -> DataFrame:
    return tidy(m.factor_panels["value"], score=8)


@known_query("information_coefficients_known")
def information_coefficients_known(m: Market) -> DataFrame:
    return tidy(m.ic, ic=8)


@known_query("composite_scores_known")
def composite_scores_known(m: Market) -> DataFrame:
    return tidy(m.composite, composite=8)


@known_query("quality_weights_known")
def quality_weights_known(m: Market) -> DataFrame:
    return tidy(m.quality_weights, weight=9)


@query("snapshot_zscore")
def snapshot_zscore(m: Market) -> DataFrame:
    return tidy(X.snapshot_zscore(m.fundamentals, "profitMargins").select("symbol", "zscore"), zscore=8)


@query("forward_returns")
def forward_returns(m: Market) -> DataFrame:
    return tidy(m.forward, fwd=9)


@query("information_coefficients")
def information_coefficients(m: Market) -> DataFrame:
    return tidy(m.ic, ic=8)


@query("trailing_ic_weights")
def trailing_ic_weights(m: Market) -> DataFrame:
    return tidy(m.ic_weights, weight=8)


@query("trailing_ic_weights_embargoed")
def trailing_ic_weights_embargoed(m: Market) -> DataFrame:
    s = m.settings
    return tidy(X.trailing_ic_weights(m.ic, m.segments, m.factor_names, m.schedule, s.ic_lookback, s.ic_horizon), weight=8)


@query("composite_scores")
def composite_scores(m: Market) -> DataFrame:
    return tidy(m.composite, composite=8)


@query("composite_quantiles")
def composite_quantiles(m: Market) -> DataFrame:
    return tidy(X.composite_quantiles(m.composite, {"median": 0.5, "p75": 0.75}, m.n_symbols), median=8, p75=8)


@query("exposure_differential")
def exposure_differential(m: Market) -> DataFrame:
    tilted = m.weights_of("multi_factor")
    out = X.exposure_differential(tilted, m.cap_weights, m.composite)
    return tidy(out, portfolio_exposure=8, benchmark_exposure=8, exposure_differential=8)


# --- rule-based weights ------------------------------------------------------------------

@query("quality_weights")
def quality_weights(m: Market) -> DataFrame:
    return tidy(m.quality_weights, weight=9)


@query("tilt_weights")
def tilt_weights(m: Market) -> DataFrame:
    return tidy(m.tilt_weights, weight=9)


@query("top_by_cap")
def top_by_cap(m: Market) -> DataFrame:
    return B.top_by_cap(m.members, m.start_caps, 10).drop("market_cap")


@query("buckets_per_sector")
def buckets_per_sector(m: Market) -> DataFrame:
    return B.buckets_per_sector(m.members, m.sectors, 17)


def _buckets(m: Market, n: int) -> DataFrame:
    k = B.buckets_per_sector(m.members, m.sectors, n)
    return B.size_buckets(m.members, m.start_caps, m.sectors, k, m.schedule, m.n_symbols)


@query("size_buckets")
def size_buckets(m: Market) -> DataFrame:
    return _buckets(m, 17).drop("market_cap")


@query("stratified_weights")
def stratified_weights(m: Market) -> DataFrame:
    return tidy(B.stratified_weights(_buckets(m, 17), m.schedule), weight=9)


# --- valuation and performance -----------------------------------------------------------

@query("holding_period_values")
def holding_period_values(m: Market) -> DataFrame:
    w = m.rule_weights
    growth = V.segment_growth(w, C.held_spans(fixtures.gappy(m.prices), m.segments, m.schedule, m.cal), normalize=True)
    return tidy(growth, growth=9)


@query("variant_values")
def variant_values(m: Market) -> DataFrame:
    return tidy(m.rule_values.drop("pos"), value=8)


@query("variant_returns")
def variant_returns(m: Market) -> DataFrame:
    return tidy(m.rule_returns.drop("pos"), ret=9)


@query("forward_tracking_error")
def forward_tracking_error(m: Market) -> DataFrame:
    """Tracking error of each stratified portfolio over its own next period."""
    w = B.stratified_weights(_buckets(m, 17), m.schedule).withColumn("strategy", F.lit("stratified"))
    growth = V.segment_growth(w, m.spans, normalize=True)
    te = V.forward_tracking_error(growth, m.benchmark_returns, ["strategy"], m.settings.periods_per_year)
    return tidy(te.drop("strategy"), tracking_error=8)


@query("stratified_curve")
def stratified_curve(m: Market) -> DataFrame:
    """The sampling curve of the method that needs no fitting."""
    w = B.stratified_weights(_buckets(m, 17), m.schedule)
    growth = V.segment_growth(w.withColumn("strategy", F.lit("stratified")), m.spans, normalize=True)
    te = V.forward_tracking_error(growth, m.benchmark_returns, ["strategy"], m.settings.periods_per_year).drop("strategy")
    counts = w.groupBy("rebalance_date").agg(F.count(F.lit(1)).alias("actual_n"))
    rows = counts.join(te, "rebalance_date", "left").select(
        F.lit("stratified").alias("method"), F.lit(17).cast("bigint").alias("target_n"), "actual_n", "tracking_error"
    )
    return tidy(G.sampling_curve(rows), mean_actual_n=8, mean_tracking_error=8, median_tracking_error=8)


@query("active_returns")
def active_returns(m: Market) -> DataFrame:
    pairs = G.align(m.rule_returns, m.benchmark_returns)
    return tidy(pairs.select("strategy", "date", (F.col("ret") - F.col("bench_ret")).alias("active")), active=9)


@query("tracking_summary")
def tracking_summary(m: Market) -> DataFrame:
    index = named.index_returns(m, "IDX")
    out = G.tracking_summary(G.align(m.rule_returns, index), ("strategy",), m.settings.periods_per_year)
    return tidy(out, tracking_error_annualized=8, mean_active_return_annualized=8, correlation=8, cumulative_active_return=7)


@query("strategy_summary")
def strategy_summary(m: Market) -> DataFrame:
    out = G.strategy_summary(m.rule_returns, m.benchmark_returns, m.settings.periods_per_year)
    return tidy(out, annualized_return=8, annualized_vol=8, tracking_error_vs_full_replication=8, correlation=8)


@query("performance_metrics")
def performance_metrics(m: Market) -> DataFrame:
    out = G.performance(m.rule_returns, periods_per_year=m.settings.periods_per_year)
    return tidy(out, cagr=8, sharpe_ratio=8, sortino_ratio=8, max_drawdown=8, win_rate=8)


@query("equity_metrics")
def equity_metrics(m: Market) -> DataFrame:
    out = G.equity_performance(m.rule_values, periods_per_year=m.settings.periods_per_year)
    return tidy(out, cagr=8, sharpe_ratio=8, sortino_ratio=8, max_drawdown=8, win_rate=8)


@raw_query("event_performance_metrics")
def event_performance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.performance(fixtures.event_returns(spark, sf_dir).drop("bench_ret"))
    return tidy(out, cagr=7, sharpe_ratio=7, sortino_ratio=7, max_drawdown=8, win_rate=8)


@query("running_drawdown")
def running_drawdown(m: Market) -> DataFrame:
    return tidy(G.running_drawdown(m.rule_values).select("strategy", "date", "peak", "drawdown"), peak=8, drawdown=8)


@query("cumulative_growth")
def cumulative_growth(m: Market) -> DataFrame:
    return tidy(G.cumulative_growth(m.rule_returns).select("strategy", "date", "value"), value=8)


@query("period_returns")
def period_returns(m: Market) -> DataFrame:
    return tidy(G.period_returns(m.prices, F.lit(60), F.lit(63)).where("ret IS NOT NULL"), ret=9)


@raw_query("daily_returns_filled")
def daily_returns_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, cal, _ = _daily(spark, sf_dir)
    return tidy(C.simple_returns(prices, cal, fill="ffill"), ret=9)


@raw_query("daily_returns_unfilled")
def daily_returns_unfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, cal, _ = _daily(spark, sf_dir)
    return tidy(C.simple_returns(prices, cal), ret=9)


_daily_panels: dict = {}


def _daily(spark: SparkSession, sf_dir: str):
    key = (spark.sparkContext.applicationId, id(spark._jsparkSession), sf_dir)
    if key not in _daily_panels:
        _daily_panels[key] = numbered_prices(fixtures.prices_daily(spark, sf_dir))
    return _daily_panels[key]


# --- regimes -----------------------------------------------------------------------------

@query("rolling_vol")
def rolling_vol(m: Market) -> DataFrame:
    return tidy(m.labels.select("date", "vol"), vol=8)


@query("regime_labels")
def regime_labels(m: Market) -> DataFrame:
    return m.labels.select("date", "label")


@query("regime_labels_expanding")
def regime_labels_expanding(m: Market) -> DataFrame:
    """Labels by thresholds that know no later day."""
    return m.with_settings(thresholds="expanding").labels.select("date", "label")


@query("regime_thresholds_expanding")
def regime_thresholds_expanding(m: Market) -> DataFrame:
    vols = R.rolling_vol(R.number_series(m.index_level), "ticker", m.settings.regime_window)
    return tidy(R.expanding_thresholds(vols, None), low_threshold=8, high_threshold=8)


@query("regime_thresholds")
def regime_thresholds(m: Market) -> DataFrame:
    return tidy(R.regime_thresholds(m.labels.withColumn("ticker", F.lit("IDX"))).drop("ticker"), low_quantile=8, high_quantile=8, low_threshold=8, high_threshold=8)


@query("regime_day_counts")
def regime_day_counts(m: Market) -> DataFrame:
    return R.day_counts(m.labels)


@query("current_regime")
def current_regime(m: Market) -> DataFrame:
    return R.current_regime(m.labels)


def _regime_stats(m: Market) -> DataFrame:
    return R.conditional_stats(m.rule_returns, m.labels, m.settings.min_regime_days, m.settings.periods_per_year)


@query("regime_conditional")
def regime_conditional(m: Market) -> DataFrame:
    return tidy(_regime_stats(m), annualized_return=8, annualized_vol=8, sharpe_zero_rate=8)


@query("regime_skipped")
def regime_skipped(m: Market) -> DataFrame:
    return R.skipped_regimes(m.rule_returns, m.labels, 24)


@query("regime_pivot")
def regime_pivot(m: Market) -> DataFrame:
    return tidy(R.regime_pivot(_regime_stats(m), "annualized_return"), calm=8, normal=8, volatile=8)


@query("regime_excess")
def regime_excess(m: Market) -> DataFrame:
    return tidy(R.regime_excess(_regime_stats(m), "quality"), excess_annualized_return=8)


# --- costs -------------------------------------------------------------------------------

@query("liquidity_at_end")
def liquidity_at_end(m: Market) -> DataFrame:
    return tidy(m.liquidity, vol=8, adv=4)


@query("liquidity_last_valid")
def liquidity_last_valid(m: Market) -> DataFrame:
    s = m.settings
    return tidy(K.latest_vol(m.prices, m.cal, s.vol_window, s.periods_per_year, last_valid=True), vol=8)


@query("liquidity_at_rebalance")
def liquidity_at_rebalance(m: Market) -> DataFrame:
    s = m.settings
    out = K.liquidity_at_rebalance(m.prices, m.segments, m.cal, s.volume_window, s.vol_window, s.periods_per_year)
    return tidy(out, vol=8, adv=4)


@query("weight_changes")
def weight_changes(m: Market) -> DataFrame:
    return tidy(m.changes_of(m.rule_weights), weight=9, dw=9)


@query("turnover")
def turnover(m: Market) -> DataFrame:
    return tidy(K.turnover(m.changes_of(m.rule_weights)), two_way_turnover=8, one_way_turnover=8)


@query("portfolio_metadata")
def portfolio_metadata(m: Market) -> DataFrame:
    out = K.portfolio_metadata(K.turnover(m.changes_of(m.rule_weights)))
    return tidy(out, name_count=8, mean_one_way_turnover=8)


@query("symbol_costs")
def symbol_costs(m: Market) -> DataFrame:
    out = K.symbol_costs(m.changes_of(m.rule_weights_all), m.liquidity, 1e7)
    return tidy(out, trade_value=2, participation_rate=6, cost_fraction=7, dollar_cost=1)


@query("rebalance_costs")
def rebalance_costs(m: Market) -> DataFrame:
    return tidy(m.rule_costs, cost_fraction=7, dollar_cost=2)


@query("cost_adjusted_returns")
def cost_adjusted_returns(m: Market) -> DataFrame:
    return tidy(m.rule_adjusted.drop("pos"), ret=7, gross_ret=8)


@query("mean_rebalance_costs")
def mean_rebalance_costs(m: Market) -> DataFrame:
    return tidy(K.mean_costs(m.rule_costs), mean_rebalance_cost_frac=7)


def _capacity(m: Market) -> DataFrame:
    s = m.settings
    gross = m.rule_returns.groupBy("strategy").agg((F.pow(1 + F.avg("ret"), F.lit(float(s.periods_per_year))) - 1).alias("gross_return"))
    changes = m.changes_of(m.rule_weights)
    last = K.last_two_held(m.weights_of("multi_factor"), "multi_factor").select("t_curr").scalar()
    changes = changes.where(F.col("rebalance_date") == last)
    return K.capacity_table(changes, K.trade_costs(changes, m.liquidity, s.aums, s.impact_y), gross)


@query("capacity_ranking")
def capacity_ranking(m: Market) -> DataFrame:
    return tidy(_capacity(m), turnover=8, rebalance_cost_fraction=7, annualized_cost_drag=7, gross_return=8, net_return=7)


@query("last_two_held")
def last_two_held(m: Market) -> DataFrame:
    return K.last_two_held(m.weights_of("multi_factor"), "multi_factor")


# --- attribution and limits --------------------------------------------------------------

@query("attribution_by_sector")
def attribution_by_sector(m: Market) -> DataFrame:
    out = L.attribution_by_sector(*named.attribution_inputs(m))
    return tidy(out, **{c: 8 for c in out.columns if c != "sector"})


@query("attribution_totals")
def attribution_totals(m: Market) -> DataFrame:
    out = L.attribution_totals(L.attribution_by_sector(*named.attribution_inputs(m)))
    return tidy(out, **{c: 8 for c in out.columns if c != "reconciles"})


@query("attribution_excluded")
def attribution_excluded(m: Market) -> DataFrame:
    return tidy(L.attribution_excluded(*named.attribution_inputs(m)), weight=9)


@query("relative_values")
def relative_values(m: Market) -> DataFrame:
    out = L.relative_drawdowns(G.align(m.rule_returns, m.benchmark_returns)).select("strategy", "date", "value", "drawdown")
    return tidy(out, value=8, drawdown=8)


@query("limit_checks")
def limit_checks(m: Market) -> DataFrame:
    s = m.settings
    pairs = G.align(m.rule_adjusted, m.benchmark_returns)
    out = L.limit_checks(pairs, ("strategy", "aum"), s.te_limit, s.drawdown_limit, s.periods_per_year)
    out = out.withColumn("trigger_reasons", F.array_join("trigger_reasons", ","))
    return tidy(out, tracking_error=7, max_relative_drawdown=7)


@raw_query("sticky_limit_switch")
def sticky_limit_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily limit checks on event returns; the 16th of the month resets every switch."""
    checks = L.daily_checks(fixtures.event_returns(spark, sf_dir), te_limit=0.05, drawdown_limit=0.004)
    out = L.sticky_switch(checks.withColumn("reset", F.dayofmonth("date") == 16), reset="reset")
    return tidy(out.drop("ret", "bench_ret"), tracking_error=8, max_relative_drawdown=8)


# --- bootstrap and comparison ------------------------------------------------------------

@raw_query("bootstrap_indices")
def bootstrap_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = BS.collect_series(fixtures.event_returns(spark, sf_dir), ["strategy"])
    return BS.resample_indices(series, ["strategy"], 7, 20, source="lcg")


@raw_query("bootstrap_resamples")
def bootstrap_resamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = BS.resample_rows(fixtures.event_returns(spark, sf_dir), ["strategy"], 7, 20, source="lcg")
    return tidy(out, ret=9, bench_ret=9)


@query("bootstrap_metrics")
def bootstrap_metrics(m: Market) -> DataFrame:
    s = m.settings
    pairs = G.align(m.rule_adjusted, m.benchmark_returns)
    out = BS.bootstrap_metrics(
        pairs, ["strategy", "aum"], s.block_length, s.n_resamples, s.confidence, source="lcg", periods_per_year=s.periods_per_year
    )
    return tidy(out, point_estimate=6, ci_low=6, ci_high=6, confidence_level=6)


@query("beating_benchmark")
def beating_benchmark(m: Market) -> DataFrame:
    point = G.performance(m.rule_adjusted, ("strategy", "aum"), periods_per_year=m.settings.periods_per_year)
    out = Q.beating_benchmark(point)
    return tidy(out.withColumn("beating", F.array_join("beating", ",")), benchmark_value=7)


def _comparison(m: Market) -> DataFrame:
    """Comparison over the rule-based variants, stored once because several reports read it."""
    if "rule_comparison" not in m.__dict__:
        s = m.settings
        metadata = K.portfolio_metadata(K.turnover(m.changes_of(m.rule_weights_all)))
        table = Q.comparison_table(
            m.rule_adjusted, m.benchmark_returns, m.labels, metadata, s.block_length, s.n_resamples, s.confidence, source=s.source,
            periods_per_year=s.periods_per_year,
        )
        m.__dict__["rule_comparison"] = materialize(table, "comparison")
    return m.__dict__["rule_comparison"]


@query("comparison_table")
def comparison_table(m: Market) -> DataFrame:
    out = _comparison(m)
    doubles = [f.name for f in out.schema.fields if f.dataType.simpleString() == "double" and f.name != "aum"]
    return tidy(out, **{c: 6 for c in doubles})


@query("best_strategy_by_aum")
def best_strategy_by_aum(m: Market) -> DataFrame:
    return tidy(Q.best_by_aum(_comparison(m)), cost_adjusted_return=6)


@query("findings")
def findings(m: Market) -> DataFrame:
    return Q.findings(_comparison(m))


# --- fits --------------------------------------------------------------------------------

@query("trailing_histories")
def trailing_histories(m: Market) -> DataFrame:
    rows = m.histories.select("rebalance_date", "symbol", F.posexplode("x").alias("t", "ret"))
    return tidy(rows.withColumn("t", F.col("t").cast("bigint")), ret=9)


@query("trailing_benchmark")
def trailing_benchmark(m: Market) -> DataFrame:
    rows = m.fit_benchmark.select("rebalance_date", F.posexplode("b").alias("t", "ret"))
    return tidy(rows.withColumn("t", F.col("t").cast("bigint")), ret=9)


@query("day_gram")
def day_gram(m: Market) -> DataFrame:
    return tidy(FT.day_gram(m.histories), a=7)


@query("shrinkage_terms")
def shrinkage_terms(m: Market) -> DataFrame:
    return tidy(m.shrunk, mu=9, delta=9, beta=9, shrinkage=7)


@query("min_vol_weights")
def min_vol_weights(m: Market) -> DataFrame:
    return tidy(m.min_vol_weights, weight=6)


@query("min_vol_certificate")
def min_vol_certificate(m: Market) -> DataFrame:
    return studies.min_vol_certificate(m)


@query("fit_status")
def fit_status(m: Market) -> DataFrame:
    return m.min_vol_status


@query("best_method_by_target")
def best_method_by_target(m: Market) -> DataFrame:
    return tidy(Q.best_by_target(G.sampling_curve(studies.sampling_study(m, [8, 30]))), mean_tracking_error=6)


@query("replication_coverage")
def replication_coverage(m: Market) -> DataFrame:
    return tidy(named.replication_coverage(m), **{f.name: 8 for f in named.replication_coverage(m).schema.fields if f.dataType.simpleString() == "double"})


BUDGETS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0)


@query("turnover_fit_certificate")
def turnover_fit_certificate(m: Market) -> DataFrame:
    return tidy(studies.turnover_fit_certificate(m, BUDGETS), factor_target=8)


@query("frontier_status")
def frontier_status(m: Market) -> DataFrame:
    return tidy(studies.frontier_status(m, BUDGETS), factor_target=8, greatest_exposure=8)


@query("sparse_path_certificate")
def sparse_path_certificate(m: Market) -> DataFrame:
    out = studies.sparse_path_certificate(m.lasso_paths, m.histories, m.fit_benchmark)
    return tidy(out.drop("n_held"), alpha=12)


@query("tracking_fit_certificate")
def tracking_fit_certificate(m: Market) -> DataFrame:
    return studies.tracking_fit_certificate(m, [8, 30])


@query("sampling_weights")
def sampling_weights(m: Market) -> DataFrame:
    return tidy(studies.sampling_weights(m, [8, 30]), weight=6)


@query("sampling_study")
def sampling_study(m: Market) -> DataFrame:
    return tidy(studies.sampling_study(m, [8, 30]), tracking_error=6)


# --- named queries -----------------------------------------------------------------------

@query("replication_full")
def replication_full(m: Market) -> DataFrame:
    out = named.replication_full(m)
    return tidy(out, tracking_error_annualized=8, mean_active_return_annualized=8, correlation=8, cumulative_active_return=7)


@query("replication_full_recent")
def replication_full_recent(m: Market) -> DataFrame:
    out = named.replication_full_recent(m, "1999-01-01")
    return tidy(out, tracking_error_annualized=8, mean_active_return_annualized=8, correlation=8, cumulative_active_return=7)


@query("replication_sampling")
def replication_sampling(m: Market) -> DataFrame:
    out = named.replication_sampling(m, "8,30")
    return tidy(out, mean_actual_n=6, mean_tracking_error=6, median_tracking_error=6)


@query("multi_objective")
def multi_objective(m: Market) -> DataFrame:
    out = named.multi_objective(m)
    return tidy(out, factor_target=8, realized_turnover=6, realized_factor_exposure=6, tracking_error=6)


@query("smartbeta")
def smartbeta(m: Market) -> DataFrame:
    out = named.smartbeta(m)
    return tidy(out, annualized_return=6, annualized_vol=6, tracking_error_vs_full_replication=6, correlation=6)


@query("regime_performance")
def regime_performance(m: Market) -> DataFrame:
    return tidy(named.regime_performance(m), annualized_return=6, annualized_vol=6, sharpe_zero_rate=6)


@query("regime_summary")
def regime_summary(m: Market) -> DataFrame:
    return named.regime_summary(m)


@query("liquidity")
def liquidity(m: Market) -> DataFrame:
    return tidy(named.liquidity(m, 1e5), turnover=6, rebalance_cost_fraction=6, annualized_cost_drag=6)


@query("backtest_bootstrap")
def backtest_bootstrap(m: Market) -> DataFrame:
    out = named.backtest_bootstrap(m, "quality", 1e4, 2000)
    return tidy(out, point_estimate=6, ci_low=6, ci_high=6, confidence_level=6, mean_rebalance_cost_frac=7)


@query("risk_attribution")
def risk_attribution(m: Market) -> DataFrame:
    out = named.risk_attribution(m, "multi_factor")
    return tidy(out, **{f.name: 8 for f in out.schema.fields if f.dataType.simpleString() == "double"})


@query("risk_kill_switch")
def risk_kill_switch(m: Market) -> DataFrame:
    out = named.risk_kill_switch(m, 1e4).withColumn("trigger_reasons", F.array_join("trigger_reasons", ","))
    return tidy(out, tracking_error=6, max_relative_drawdown=6)


@query("full_comparison")
def full_comparison(m: Market) -> DataFrame:
    out = named.full_comparison(m)
    out = out.withColumn("settings", F.to_json("settings"))
    return tidy(out, **{f.name: 6 for f in out.schema.fields if f.dataType.simpleString() == "double" and f.name != "aum"})


@query("full_findings")
def full_findings(m: Market) -> DataFrame:
    return named.all_findings(m, named.full_comparison(m, with_settings=False), "8,30")


# --- streaming ---------------------------------------------------------------------------

@raw_query("streaming_limit_monitor")
def streaming_limit_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event returns as a stream; the same rows and limits as ``sticky_limit_switch``."""
    base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/monitor-{uuid.uuid4().hex}"
    feed = fixtures.event_returns(spark, sf_dir).withColumn("reset", F.dayofmonth("date") == 16)
    ST.write_feed(feed, f"{base}/feed")
    run = lambda: ST.run_available(
        spark, f"{base}/feed", f"{base}/out", f"{base}/checkpoint", te_limit=0.05, drawdown_limit=0.004, changes_only=False
    )
    run()
    ST.write_heartbeat(spark, f"{base}/feed", "2100-01-01")
    out = run()
    out = out.where("strategy <> 'heartbeat'").withColumn("date", F.col("ts").cast("date")).drop("ts")
    return tidy(out, tracking_error=8, max_relative_drawdown=8)


@raw_query("streaming_late_rows")
def streaming_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event returns, then a row that moves the watermark past them, then all of them once more: those come too late."""
    base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/late-{uuid.uuid4().hex}"
    feed = fixtures.event_returns(spark, sf_dir).withColumn("reset", F.lit(False))
    run = lambda: ST.run_available(
        spark, f"{base}/feed", f"{base}/out", f"{base}/checkpoint", late=f"{base}/late", te_limit=0.05, drawdown_limit=0.004
    )
    ST.write_feed(feed, f"{base}/feed")
    run()
    ST.write_heartbeat(spark, f"{base}/feed", "2100-01-01")
    run()
    ST.write_feed(feed, f"{base}/feed")
    run()
    return ST.late_rows(spark, f"{base}/late").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_late").alias("n_late"))


# --- cleaning, scans, results ------------------------------------------------------------

@raw_query("clean_constituents")
def clean_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_constituents(fixtures.raw_constituents(spark, sf_dir))


@raw_query("clean_changes")
def clean_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_changes(fixtures.raw_changes(spark, sf_dir))


def _written(df: DataFrame, name: str, kind: str = "parquet") -> str:
    """Path of ``df`` as files in the shared folder, for the scans to read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("header", True).format(kind).save(path)
    return path


@query("scan_prices")
def scan_prices(m: Market) -> DataFrame:
    path = _written(m.prices.select("symbol", "date", "close", "volume"), "prices")
    return tidy(cleaning.read_prices(m.spark, path), close=9)


@raw_query("scan_index_level")
def scan_index_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(fixtures.index_level(spark, sf_dir), "index")
    return tidy(cleaning.read_index_level(spark, path, ["IDX", "IDXTR"]), close=9)


@raw_query("scan_constituents")
def scan_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.read_constituents(spark, _written(cleaning.clean_constituents(fixtures.raw_constituents(spark, sf_dir)), "constituents", "csv"))


@raw_query("scan_changes")
def scan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.read_changes(spark, _written(cleaning.clean_changes(fixtures.raw_changes(spark, sf_dir)), "changes", "csv"))


@raw_query("clean_shares")
def clean_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_shares(fixtures.raw_shares(spark, sf_dir))


@raw_query("clean_anchors")
def clean_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.table(spark, sf_dir, "part").select(F.col("p_name").alias("symbol"), F.nullif(F.col("p_size") % 5, F.lit(3)).cast("double").alias("shares"), "p_partkey")
    return cleaning.clean_anchors(raw)


@query("clean_fundamentals")
def clean_fundamentals(m: Market) -> DataFrame:
    out = cleaning.clean_fundamentals(m.fundamentals).select("symbol", "returnOnEquity", "debtToEquity", "earningsGrowth", "totalCash")
    return tidy(out, returnOnEquity=9, earningsGrowth=9)


@query("feed_symbol_lookup")
def feed_symbol_lookup(m: Market) -> DataFrame:
    mapped = m.constituents.select("symbol", F.concat(F.col("symbol"), F.lit("-M")).alias("feed_symbol"))
    wanted = m.changes.select(F.concat(F.coalesce("added_ticker", "removed_ticker"), F.lit(".B")).alias("symbol")).unionByName(m.changes.select(F.coalesce("added_ticker", "removed_ticker").alias("symbol")))
    return cleaning.lookup_feed_symbol(wanted, mapped)


@query("price_hits")
def price_hits(m: Market) -> DataFrame:
    hits, missing = cleaning.split_hits(cleaning.requested(m.constituents, "symbol"), m.anchors)
    return hits.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


@query("buffered_price_scan")
def buffered_price_scan(m: Market) -> DataFrame:
    return cleaning.buffered(m.prices, "1998-01-01").select("symbol", "date", "close")


@query("wide_price_panel")
def wide_price_panel(m: Market) -> DataFrame:
    """The wide export in blocks of columns, read back as (date, symbol, close)."""
    return cleaning.from_wide_blocks(*cleaning.to_wide_blocks(m.prices, "close"), "close")


# --- prices stored by symbol and year -------------------------------------------------------

_stores: dict[str, tuple[store.PriceStore, C.Calendar]] = {}


def _stored(spark: SparkSession, sf_dir: str) -> tuple[store.PriceStore, C.Calendar]:
    """The monthly prices in a store, written as a history and a later delivery of the whole table."""
    key = f"{spark.sparkContext.applicationId} {id(spark._jsparkSession)} {sf_dir}"
    if key not in _stores:
        rows = fixtures.prices(spark, sf_dir)
        path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"
        early = store.create(rows.where("date < '1996-01-01'"), path)
        early.append(rows)
        early.detach()
        _stores[key] = store.attach(spark, path), C.trading_calendar(fixtures.price_dates(spark, sf_dir))
    return _stores[key]


@raw_query("stored_prices")
def stored_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that the two deliveries left in the store."""
    return tidy(_stored(spark, sf_dir)[0].read(), close=9)


@raw_query("stored_price_years")
def stored_price_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study's window of the store; other years are not read."""
    return tidy(_stored(spark, sf_dir)[0].read("1995-02-01", "1996-11-30"), close=9)


@raw_query("stored_key_violations")
def stored_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[0].violations()


@raw_query("stored_simple_returns")
def stored_simple_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, cal = _stored(spark, sf_dir)
    return tidy(C.simple_returns(C.number_dates(prices.read(), cal), cal), ret=9)


@raw_query("stored_market_caps")
def stored_market_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, cal = _stored(spark, sf_dir)
    caps = MC.market_caps(C.number_dates(prices.read(), cal), fixtures.shares(spark, sf_dir, cal), fixtures.share_anchors(spark, sf_dir), cal.rows)
    return caps.select("symbol", "pos", "market_cap")


@raw_query("price_key_violations")
def price_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = fixtures.table(spark, sf_dir, "lineitem")
    return key_violations(line, ["l_orderkey", "l_suppkey"])


def _result_set(m: Market) -> str:
    """Folder with the results of the rule variants, published twice: readers get the second set."""
    if "result_set" not in m.__dict__:
        path = f"{shared_dir(m.spark)}/{m.spark.sparkContext.applicationId}/results-{uuid.uuid4().hex}"
        sampling = materialize(G.sampling_curve(studies.sampling_study(m, [8, 30])), "sampling")
        table, said = _comparison(m), Q.findings(_comparison(m))
        results.write_results(path, table.limit(0), None, said.limit(0))
        results.write_results(path, table, sampling, said, {"comparison_csv": table, "sampling_csv": sampling})
        m.__dict__["result_set"] = path
    return m.__dict__["result_set"]


@query("stored_results")
def stored_results(m: Market) -> DataFrame:
    stored, csv = results.read_results(m.spark, _result_set(m)), results.read_csv(m.spark, _result_set(m), "comparison_csv")
    lines = [stored["findings"].select(F.lit("findings").alias("part"), "text")]
    for part, table in (("comparison", stored["comparison"]), ("comparison_csv", csv)):
        lines.append(table.select(F.lit(part).alias("part"), F.concat_ws(" ", "strategy", F.col("aum").cast("double").cast("long").cast("string"), "regime").alias("text")))
    lines.append(stored["sampling"].select(F.lit("sampling").alias("part"), F.concat_ws(" ", "method", F.col("target_n").cast("string")).alias("text")))
    return reduce(DataFrame.union, lines)


def _stored_comparison(table: DataFrame, m: Market) -> DataFrame:
    """Stored figures in the types of the table that was written."""
    table = table.select(*[F.col(f.name).cast(f.dataType) for f in _comparison(m).schema.fields if f.name in table.columns])
    doubles = [f.name for f in table.schema.fields if f.dataType.simpleString() == "double" and f.name != "aum"]
    return tidy(table, **{c: 6 for c in doubles})


@query("stored_comparison")
def stored_comparison(m: Market) -> DataFrame:
    """The comparison's figures as they are read back."""
    return _stored_comparison(results.read_results(m.spark, _result_set(m))["comparison"], m)


@query("stored_comparison_csv")
def stored_comparison_csv(m: Market) -> DataFrame:
    """The same figures from the flat file."""
    return _stored_comparison(results.read_csv(m.spark, _result_set(m), "comparison_csv"), m)


@query("result_manifest")
def result_manifest(m: Market) -> DataFrame:
    """Versions and rows of the published sets."""
    lines = results.published(m.spark, _result_set(m))
    return lines.select("version", F.explode("tables").alias("part", "n_rows"))


@query("lost_weight")
def lost_weight(m: Market) -> DataFrame:
    starts = C.at_segment_start(fixtures.gappy(m.prices), m.segments, m.schedule)
    return tidy(V.lost_weight(m.rule_weights, starts), lost_weight=8)


@query("capacity_study")
def capacity_study(m: Market) -> DataFrame:
    out = named.capacity_study(m, 30)
    return tidy(out, turnover=6, rebalance_cost_fraction=6, annualized_cost_drag=6, gross_return=6, net_return=6)


@query("bootstrap_table")
def bootstrap_table(m: Market) -> DataFrame:
    out = named.bootstrap_table(m)
    return tidy(out, point_estimate=6, ci_low=6, ci_high=6, confidence_level=6, mean_rebalance_cost_frac=6)


@query("in_sample_tracking_error")
def in_sample_tracking_error(m: Market) -> DataFrame:
    w = m.cap_weights.join(m.histories.select("rebalance_date", "symbol"), ["rebalance_date", "symbol"], "left_semi")
    out = studies.in_sample_tracking_error(w, m.histories, m.fit_benchmark, ["rebalance_date"], m.settings.periods_per_year)
    return tidy(out, tracking_error=8)
