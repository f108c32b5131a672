"""Final SELECT of every oracle, over the views in ``views``."""

FINALS: dict[str, str] = {}

FINALS["price_panel"] = "SELECT symbol, date, pos, close, volume FROM px"
FINALS["trading_calendar"] = "SELECT pos, date FROM cal"
FINALS["rebalance_schedule"] = "SELECT rebalance_date FROM sched"
FINALS["holding_segments"] = "SELECT rebalance_date, next_rebalance, is_last, sp, start_date, ep FROM seg"
FINALS["simple_returns"] = "SELECT symbol, pos, round(ret, 9) AS ret FROM rets"
FINALS["forward_filled_panel"] = """
SELECT symbol, pos, close, from_pos = pos AS quoted FROM filled_gappy"""

FINALS["membership_history"] = "SELECT rebalance_date, symbol FROM members"
FINALS["membership_at_date"] = "SELECT symbol FROM members WHERE rebalance_date = DATE '1998-09-18'"
FINALS["membership_coverage_notes"] = """
SELECT (SELECT min(effective_date) FROM fx_changes) AS log_first, (SELECT max(effective_date) FROM fx_changes) AS log_last,
       (SELECT count(*) FROM fx_constituents) AS n_current,
       (SELECT count(*) FROM fx_constituents WHERE date_added < DATE '1976-07-01') AS n_added_before_log,
       DATE '1976-07-01' AS log_start"""
FINALS["universe_size"] = "SELECT count(DISTINCT symbol) AS universe_size FROM grid_syms"
FINALS["market_caps"] = "SELECT symbol, pos, market_cap FROM caps"
FINALS["market_cap_coverage"] = """
SELECT count(*) AS priced_symbols, count(s.symbol) AS market_cap_symbols, round(count(s.symbol) / count(*), 9) AS coverage_fraction
FROM (SELECT DISTINCT symbol FROM px) p LEFT JOIN (SELECT DISTINCT symbol FROM fx_shares) s ON s.symbol = p.symbol"""
FINALS["missing_share_counts"] = """
SELECT DISTINCT symbol FROM px WHERE symbol NOT IN (SELECT symbol FROM fx_anchors)"""
FINALS["rebalance_coverage"] = """
SELECT m.rebalance_date, count(*) AS intended_members, count(w.symbol) AS weighted_members,
       round(count(w.symbol) / count(*), 9) AS coverage_fraction
FROM members m JOIN seg g ON g.rebalance_date = m.rebalance_date
LEFT JOIN w_cap w ON w.rebalance_date = m.rebalance_date AND w.symbol = m.symbol GROUP BY 1"""
FINALS["rebalance_coverage_summary"] = f"""
SELECT round(min(coverage_fraction), 9) AS min_coverage, round(max(coverage_fraction), 9) AS max_coverage,
       round(avg(coverage_fraction), 8) AS mean_coverage, count(*) AS n_rebalances FROM ({FINALS['rebalance_coverage']}) q"""

FINALS["cap_weights"] = "SELECT rebalance_date, symbol, round(weight, 9) AS weight FROM w_cap"
FINALS["equal_weights"] = "SELECT rebalance_date, symbol, round(weight, 9) AS weight FROM w_equal"
FINALS["replication_values"] = """
SELECT v.date, round(v.value, 9) AS value, round(r.ret, 9) + 0.0::DOUBLE AS ret FROM rep_values v LEFT JOIN rep_returns r ON r.pos = v.pos"""


def rounded(view: str, keys: str, **digits: int) -> str:
    cols = ", ".join(f"round({c}, {d}) + 0.0::DOUBLE AS {c}" for c, d in digits.items())
    return f"SELECT {keys}, {cols} FROM {view}"


FINALS["momentum_scores"] = rounded("mom_z", "symbol, pos", score=8)
FINALS["low_vol_scores"] = rounded("lowvol_z", "symbol, pos", score=8)
FINALS["value_scores"] = rounded("value_z", "symbol, pos", score=8)
FINALS["quality_scores"] = rounded("quality_z", "symbol", score=8)
_STATES = ', '.join(f'round({c}, 9) AS "{n}"' for c, n in (("roe", "returnOnEquity"), ("margin", "profitMargins"), ("growth", "earningsGrowth"), ("debt", "debtToEquity"), ("eps", "trailingEps")))
FINALS["fundamentals_known"] = f"SELECT symbol, known_from, CAST(lead(known_from) OVER (PARTITION BY symbol ORDER BY known_from) - 1 AS DATE) AS known_until, {_STATES} FROM known_days"
FINALS["fundamentals_at_rebalances"] = f"SELECT t AS rebalance_date, symbol, {_STATES} FROM known_reb"
FINALS["quality_scores_known"] = "SELECT t AS rebalance_date, symbol, round(score, 8) + 0.0::DOUBLE AS score FROM quality_known_reb"
FINALS["quality_panel_known"] = "SELECT t AS pos, symbol, round(score, 8) + 0.0::DOUBLE AS score FROM quality_known_pos WHERE score IS NOT NULL"
FINALS["value_scores_known"] = rounded("value_known_z", "symbol, pos", score=8)
FINALS["information_coefficients_known"] = rounded("ic_series_known", "factor, pos, n_names", ic=8)
FINALS["composite_scores_known"] = rounded("composite_known", "rebalance_date, symbol", composite=8)
FINALS["quality_weights_known"] = rounded("w_quality_known", "rebalance_date, symbol", weight=9)
FINALS["snapshot_zscore"] = "SELECT symbol, round(z2, 8) AS zscore FROM quality_parts"
FINALS["forward_returns"] = rounded("fwd", "symbol, pos", fwd=9)
FINALS["information_coefficients"] = rounded("ic_series", "factor, pos, n_names", ic=8)
FINALS["trailing_ic_weights"] = rounded("ic_w", "rebalance_date, factor", weight=8)
FINALS["trailing_ic_weights_embargoed"] = rounded("ic_w_embargo", "rebalance_date, factor", weight=8)
FINALS["composite_scores"] = rounded("composite", "rebalance_date, symbol", composite=8)
FINALS["composite_quantiles"] = """
SELECT rebalance_date, round(quantile_cont(composite, 0.5), 8) AS median, round(quantile_cont(composite, 0.75), 8) AS p75
FROM composite GROUP BY 1"""
FINALS["exposure_differential"] = """
SELECT rebalance_date, round(p, 8) AS portfolio_exposure, round(b, 8) AS benchmark_exposure, round(p - b, 8) AS exposure_differential FROM (
  SELECT k.rebalance_date, sum(t.weight * k.composite) / nullif(sum(t.weight), 0) AS p, sum(c.weight * k.composite) / nullif(sum(c.weight), 0) AS b
  FROM composite k LEFT JOIN w_tilt t ON t.rebalance_date = k.rebalance_date AND t.symbol = k.symbol
  LEFT JOIN w_cap c ON c.rebalance_date = k.rebalance_date AND c.symbol = k.symbol
  WHERE t.weight IS NOT NULL OR c.weight IS NOT NULL GROUP BY 1) q"""

FINALS["quality_weights"] = rounded("w_quality", "rebalance_date, symbol", weight=9)
FINALS["tilt_weights"] = rounded("w_tilt", "rebalance_date, symbol", weight=9)
FINALS["top_by_cap"] = "SELECT rebalance_date, symbol, cap_rank FROM top10"
FINALS["buckets_per_sector"] = "SELECT rebalance_date, k FROM sector_k"
FINALS["size_buckets"] = "SELECT rebalance_date, gics_sector, symbol, tier FROM buckets"
FINALS["stratified_weights"] = rounded("w_strat", "rebalance_date, symbol", weight=9)

FINALS["holding_period_values"] = """
WITH raw AS (
  SELECT w.strategy, g.rebalance_date, d.pos, sum(w.weight * d.close / o.close) AS growth
  FROM seg g JOIN w_rule w ON w.rebalance_date = g.rebalance_date
  JOIN px_gappy o ON o.symbol = w.symbol AND o.pos = g.sp AND o.close <> 0
  JOIN filled_gappy d ON d.symbol = w.symbol AND d.pos BETWEEN g.sp AND g.ep GROUP BY 1, 2, 3)
SELECT strategy, rebalance_date, pos, round(growth / first_value(growth) OVER (PARTITION BY strategy, rebalance_date ORDER BY pos), 9) AS growth FROM raw"""
FINALS["variant_values"] = rounded("rule_values", "strategy, date", value=8)
FINALS["variant_returns"] = rounded("rule_returns", "strategy, date", ret=9)
FINALS["forward_tracking_error"] = """
WITH raw AS (
  SELECT g.rebalance_date, d.pos, sum(w.weight * d.close / o.close) AS v
  FROM seg g JOIN w_strat w ON w.rebalance_date = g.rebalance_date
  JOIN px o ON o.symbol = w.symbol AND o.pos = g.sp JOIN filled d ON d.symbol = w.symbol AND d.pos BETWEEN g.sp AND g.ep GROUP BY 1, 2),
ret AS (SELECT rebalance_date, pos, v / lag(v) OVER (PARTITION BY rebalance_date ORDER BY pos) - 1 AS r FROM raw)
SELECT a.rebalance_date, round(stddev_samp(a.r - b.ret) * sqrt(12), 8) AS tracking_error
FROM ret a JOIN rep_returns b ON b.pos = a.pos WHERE a.r IS NOT NULL GROUP BY 1"""
FINALS["active_returns"] = "SELECT strategy, date, round(ret - bench_ret, 9) + 0.0::DOUBLE AS active FROM rule_pairs"
FINALS["tracking_summary"] = """
SELECT r.strategy, round(stddev_samp(r.ret - i.ret) * sqrt(12), 8) AS tracking_error_annualized,
  round(avg(r.ret - i.ret) * 12, 8) AS mean_active_return_annualized, round(corr(r.ret, i.ret), 8) AS correlation, count(*) AS n_periods,
  round(product(1 + r.ret) - product(1 + i.ret), 7) AS cumulative_active_return
FROM rule_returns r JOIN index_returns i ON i.date = r.date AND i.ticker = 'IDX' GROUP BY 1"""
FINALS["strategy_summary"] = """
SELECT a.*, b.tracking_error_vs_full_replication, b.correlation FROM (
  SELECT strategy, round(pow(1 + avg(ret), 12) - 1, 8) AS annualized_return, round(stddev_samp(ret) * sqrt(12), 8) AS annualized_vol,
    count(*) AS n_days FROM rule_returns GROUP BY 1) a
JOIN (SELECT strategy, round(stddev_samp(ret - bench_ret) * sqrt(12), 8) AS tracking_error_vs_full_replication,
    round(corr(ret, bench_ret), 8) AS correlation FROM rule_pairs GROUP BY 1) b ON b.strategy = a.strategy"""


def performance(src: str, ppy: int, digits: int = 8, extra: str = "") -> str:
    return f"""
WITH v AS (SELECT strategy, date, ret, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date) AS v FROM {src}),
d AS (SELECT *, 1 - v / greatest(1, max(v) OVER (PARTITION BY strategy ORDER BY date)) AS dd FROM v)
SELECT strategy, round(pow(product(1 + ret), {ppy}.0 / (count(*) + 1)) - 1, {digits}) AS cagr,
  round(avg(ret) / stddev_samp(ret) * sqrt({ppy}), {digits}) AS sharpe_ratio,
  round(avg(ret) / stddev_samp(ret) FILTER (WHERE ret < 0) * sqrt({ppy}), {digits}) AS sortino_ratio,
  round(max(dd), 8) AS max_drawdown, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 8) AS win_rate FROM d GROUP BY 1"""


FINALS["performance_metrics"] = performance("rule_returns", 12)
FINALS["event_performance_metrics"] = performance("fx_returns", 252, 7)
FINALS["equity_metrics"] = """
WITH r AS (SELECT strategy, date, value, value / lag(value) OVER (PARTITION BY strategy ORDER BY date) - 1 AS ret,
  1 - value / max(value) OVER (PARTITION BY strategy ORDER BY date) AS dd FROM rule_values)
SELECT strategy, round(pow(arg_max(value, date) / arg_min(value, date), 12.0 / count(*)) - 1, 8) AS cagr,
  round(avg(ret) / stddev_samp(ret) * sqrt(12), 8) AS sharpe_ratio,
  round(avg(ret) / stddev_samp(ret) FILTER (WHERE ret < 0) * sqrt(12), 8) AS sortino_ratio,
  round(max(dd), 8) AS max_drawdown, round(avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END), 8) AS win_rate FROM r GROUP BY 1"""
FINALS["running_drawdown"] = """
SELECT strategy, date, round(p, 8) AS peak, round(1 - value / p, 8) AS drawdown
FROM (SELECT *, max(value) OVER (PARTITION BY strategy ORDER BY date) AS p FROM rule_values) q"""
FINALS["cumulative_growth"] = """
SELECT strategy, date, round(product(1 + ret) OVER (PARTITION BY strategy ORDER BY date), 8) AS value FROM rule_returns"""
FINALS["period_returns"] = """
SELECT a.symbol, round(b.close / a.close - 1, 9) AS ret FROM px a JOIN px b ON a.symbol = b.symbol WHERE a.pos = 60 AND b.pos = 63"""
FINALS["daily_returns_unfilled"] = """
SELECT a.symbol, a.pos, round(a.close / b.close - 1, 9) AS ret FROM px_daily a JOIN px_daily b ON a.symbol = b.symbol AND b.pos = a.pos - 1
WHERE b.close <> 0"""
FINALS["daily_returns_filled"] = """
WITH q AS (SELECT symbol, pos, close, lead(pos) OVER (PARTITION BY symbol ORDER BY pos) AS following, (SELECT max(pos) + 1 FROM cal_daily) AS past
    FROM px_daily WHERE close IS NOT NULL),
  f AS (SELECT symbol, unnest(range(pos, coalesce(following, past))) AS pos, close FROM q),
  b AS (SELECT symbol, pos, close, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS before FROM f)
SELECT symbol, pos, round(close / before - 1, 9) AS ret FROM b WHERE before <> 0"""

FINALS["rolling_vol"] = "SELECT date, round(vol, 8) AS vol FROM regimes"
FINALS["regime_labels"] = "SELECT date, label FROM regimes"
FINALS["regime_labels_expanding"] = """
SELECT date, CASE WHEN vol IS NULL OR n < 21 THEN NULL WHEN vol <= lo THEN 'calm' WHEN vol >= hi THEN 'volatile' ELSE 'normal' END AS label FROM (
  SELECT date, vol, count(vol) OVER w AS n, quantile_cont(vol, 1.0::DOUBLE/3) OVER w AS lo, quantile_cont(vol, 2.0::DOUBLE/3) OVER w AS hi
  FROM idx_vol WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) q"""
FINALS["regime_thresholds_expanding"] = """
WITH lv AS (SELECT t.name AS ticker, date, CASE WHEN t.name = 'IDX' THEN close ELSE close * (1 + (date - DATE '1995-01-01') / 10000.0::DOUBLE) END AS close
    FROM idx, (SELECT unnest(['IDX', 'IDXTR']) AS name) t),
  lg AS (SELECT ticker, date, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS l FROM lv),
  vv AS (SELECT ticker, date, CASE WHEN count(l) OVER w = 21 THEN stddev_samp(l) OVER w * sqrt(252) END AS vol FROM lg
    WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))
SELECT ticker, date, count(*) OVER w AS n_seen, round(quantile_cont(vol, 1.0::DOUBLE/3) OVER w, 8) AS low_threshold, round(quantile_cont(vol, 2.0::DOUBLE/3) OVER w, 8) AS high_threshold
FROM vv WHERE vol IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
FINALS["regime_thresholds"] = """
SELECT round(1.0::DOUBLE/3, 8) AS low_quantile, round(2.0::DOUBLE/3, 8) AS high_quantile, round(lo, 8) AS low_threshold, round(hi, 8) AS high_threshold FROM vol_cuts"""
FINALS["regime_day_counts"] = "SELECT label, count(*) AS n_days FROM regimes WHERE label IS NOT NULL GROUP BY 1"
FINALS["current_regime"] = "SELECT arg_max(label, date) AS current_regime FROM regimes WHERE label IS NOT NULL"
FINALS["regime_conditional"] = rounded("regime_stats", "strategy, regime, n_days", annualized_return=8, annualized_vol=8, sharpe_zero_rate=8)
FINALS["regime_skipped"] = """
SELECT strategy, regime, n_days, printf('%s: only %d days (< %d) -- skipped, too few observations.', regime, n_days, 24) AS note
FROM regime_stats_all WHERE n_days < 24"""
FINALS["regime_pivot"] = """
SELECT strategy, round(max(annualized_return) FILTER (WHERE regime = 'calm'), 8) AS calm, round(max(annualized_return) FILTER (WHERE regime = 'normal'), 8) AS normal,
  round(max(annualized_return) FILTER (WHERE regime = 'volatile'), 8) AS volatile FROM regime_stats GROUP BY 1"""
FINALS["regime_excess"] = """
SELECT a.regime, round(a.annualized_return - b.annualized_return, 8) AS excess_annualized_return FROM regime_stats a JOIN regime_stats b ON a.regime = b.regime
WHERE a.strategy = 'quality' AND b.strategy = 'full_replication'"""

FINALS["liquidity_at_end"] = rounded("liq_end", "symbol", vol=8, adv=4)
FINALS["liquidity_last_valid"] = """
SELECT s.symbol, round(v.vol, 8) AS vol FROM (SELECT DISTINCT symbol FROM px) s
LEFT JOIN (SELECT symbol, arg_max(vol, pos) AS vol FROM px_vol WHERE vol IS NOT NULL GROUP BY 1) v ON v.symbol = s.symbol"""
FINALS["liquidity_at_rebalance"] = """
SELECT g.rebalance_date, p.symbol, round(avg(p.close * p.volume), 4) AS adv, round(max(v.vol) FILTER (WHERE p.pos = g.sp), 8) AS vol
FROM seg g JOIN px p ON p.pos BETWEEN g.sp - 5 AND g.sp JOIN px_vol v ON v.symbol = p.symbol AND v.pos = p.pos GROUP BY 1, 2"""
FINALS["weight_changes"] = """
SELECT strategy, rebalance_date, symbol, round(weight, 9) AS weight, round(dw, 9) + 0.0::DOUBLE AS dw FROM dw_all WHERE strategy <> 'full_replication'"""
FINALS["turnover"] = """
SELECT strategy, rebalance_date, n_holdings, round(two_way_turnover, 8) AS two_way_turnover, round(one_way_turnover, 8) AS one_way_turnover
FROM turns WHERE strategy <> 'full_replication'"""
FINALS["portfolio_metadata"] = """
SELECT strategy, round(name_count, 8) AS name_count, round(mean_one_way_turnover, 8) AS mean_one_way_turnover FROM metadata WHERE strategy <> 'full_replication'"""
FINALS["symbol_costs"] = """
SELECT d.strategy, d.rebalance_date, d.symbol, round(d.dw * 1e7, 2) AS trade_value,
  round(CASE WHEN l.adv > 0 AND l.vol IS NOT NULL THEN abs(d.dw * 1e7) / l.adv END, 6) AS participation_rate,
  round(CASE WHEN l.adv > 0 AND l.vol IS NOT NULL THEN l.vol * sqrt(abs(d.dw * 1e7) / l.adv) END, 7) AS cost_fraction,
  round(CASE WHEN l.adv > 0 AND l.vol IS NOT NULL THEN abs(d.dw * 1e7) * l.vol * sqrt(abs(d.dw * 1e7) / l.adv) END, 1) AS dollar_cost,
  NOT coalesce(l.adv > 0 AND l.vol IS NOT NULL, FALSE) AS excluded
FROM dw_all d LEFT JOIN liq_end l ON l.symbol = d.symbol WHERE abs(d.dw) >= 1e-12"""
FINALS["rebalance_costs"] = """
SELECT strategy, rebalance_date, aum, round(cost_fraction, 7) AS cost_fraction, round(cost_fraction * aum, 2) AS dollar_cost, n_priced, n_excluded FROM costs"""
FINALS["cost_adjusted_returns"] = "SELECT strategy, aum, date, round(ret, 7) + 0.0::DOUBLE AS ret, round(gross_ret, 8) + 0.0::DOUBLE AS gross_ret FROM adjusted"
FINALS["mean_rebalance_costs"] = "SELECT strategy, aum, round(avg(cost_fraction), 7) AS mean_rebalance_cost_frac FROM costs GROUP BY 1, 2"
FINALS["capacity_ranking"] = """
WITH last_date AS (SELECT max(rebalance_date) AS d FROM w_tilt),
c AS (SELECT k.strategy, k.rebalance_date, k.aum, t.n_holdings_6 AS n_holdings, t.turnover, k.cost_fraction, 4 * k.cost_fraction AS drag, g.gross_return,
  g.gross_return - 4 * k.cost_fraction AS net
  FROM costs k JOIN last_date l ON l.d = k.rebalance_date
  JOIN (SELECT strategy, rebalance_date, CAST(count(*) FILTER (WHERE abs(weight) > 1e-6) AS BIGINT) AS n_holdings_6, sum(abs(dw)) AS turnover FROM dw_all GROUP BY 1, 2) t
    ON t.strategy = k.strategy AND t.rebalance_date = k.rebalance_date
  JOIN gross_annual g ON g.strategy = k.strategy WHERE k.strategy <> 'full_replication')
SELECT strategy, rebalance_date, aum, n_holdings, round(turnover, 8) AS turnover, round(cost_fraction, 7) AS rebalance_cost_fraction,
  round(drag, 7) AS annualized_cost_drag, round(gross_return, 8) AS gross_return, round(net, 7) AS net_return,
  row_number() OVER (PARTITION BY aum ORDER BY net DESC, strategy) AS net_rank FROM c"""
FINALS["last_two_held"] = """
SELECT (SELECT max(rebalance_date) FROM w_tilt WHERE rebalance_date < (SELECT max(rebalance_date) FROM w_tilt)) AS t_prev, (SELECT max(rebalance_date) FROM w_tilt) AS t_curr"""

_ATTR = "portfolio_weight benchmark_weight portfolio_return benchmark_return allocation selection interaction total_portfolio_return total_benchmark_return"
FINALS["attribution_by_sector"] = rounded("attr", "sector", **{c: 8 for c in _ATTR.split()})
FINALS["attribution_totals"] = """
SELECT round(sum(allocation), 8) AS allocation, round(sum(selection), 8) AS selection, round(sum(interaction), 8) AS interaction,
  round(max(total_portfolio_return), 8) AS portfolio_return, round(max(total_benchmark_return), 8) AS benchmark_return,
  round(max(total_portfolio_return) - max(total_benchmark_return), 8) AS total_active_return,
  abs(sum(allocation) + sum(selection) + sum(interaction) - (max(total_portfolio_return) - max(total_benchmark_return))) < 1e-9 AS reconciles FROM attr"""
FINALS["attribution_excluded"] = "SELECT symbol, round(wp, 9) AS weight FROM attr_rows WHERE gics_sector IS NULL OR ret IS NULL"
FINALS["relative_values"] = """
SELECT strategy, date, round(value, 8) AS value, round(1 - value / greatest(1, max(value) OVER (PARTITION BY strategy ORDER BY date)), 8) AS drawdown FROM rel"""
FINALS["limit_checks"] = """
SELECT strategy, aum, round(te, 7) AS tracking_error, round(dd, 7) AS max_relative_drawdown, te > 0.2 AS te_breached, dd > 0.1 AS drawdown_breached,
  te > 0.2 OR dd > 0.1 AS triggered, concat_ws(',', CASE WHEN te > 0.2 THEN 'tracking_error' END, CASE WHEN dd > 0.1 THEN 'relative_drawdown' END) AS trigger_reasons
FROM (SELECT strategy, aum, stddev_samp(ret - bench_ret) * sqrt(12) AS te, max(drawdown) AS dd FROM rel_adj_dd GROUP BY 1, 2) q"""
FINALS["sticky_limit_switch"] = """
SELECT strategy, date, round(te, 8) AS tracking_error, round(mdd, 8) AS max_relative_drawdown, te_b AS te_breached, dd_b AS drawdown_breached, reset,
  te_first IS NOT NULL OR dd_first IS NOT NULL AS triggered,
  CASE WHEN te_first IS NULL AND dd_first IS NULL THEN '' WHEN te_first IS NULL THEN 'relative_drawdown' WHEN dd_first IS NULL THEN 'tracking_error'
       WHEN te_first <= dd_first THEN 'tracking_error,relative_drawdown' ELSE 'relative_drawdown,tracking_error' END AS reasons FROM ev_first"""

FINALS["bootstrap_indices"] = "SELECT strategy, resample, k, idx FROM ev_idx"
FINALS["bootstrap_resamples"] = """
SELECT i.strategy, i.resample, i.k, i.idx, round(n.ret, 9) AS ret, round(n.bench_ret, 9) AS bench_ret
FROM ev_idx i JOIN ev_numbered n ON n.strategy = i.strategy AND n.i = i.idx"""
FINALS["bootstrap_metrics"] = "\nUNION ALL ".join(
    f"""SELECT p.strategy, p.aum, '{m}' AS metric, round(p.{m}, 6) AS point_estimate, round(c.lo_{m}, 6) AS ci_low, round(c.hi_{m}, 6) AS ci_high,
  CAST(2000 AS BIGINT) AS n_resamples, CAST(0.95 AS DOUBLE) AS confidence_level FROM bs_point p JOIN bs_ci c ON c.strategy = p.strategy AND c.aum = p.aum"""
    for m in ("cagr", "sharpe_ratio", "sortino_ratio", "max_drawdown", "win_rate", "tracking_error")
)
FINALS["beating_benchmark"] = """
WITH c AS (SELECT strategy, aum, pow(product(1 + ret), 12.0 / (count(*) + 1)) - 1 AS cagr FROM adjusted GROUP BY 1, 2),
b AS (SELECT aum, cagr AS bc FROM c WHERE strategy = 'full_replication')
SELECT b.aum, round(bc, 7) AS benchmark_value, coalesce(string_agg(c.strategy, ',' ORDER BY c.strategy) FILTER (WHERE c.cagr > b.bc), '') AS beating
FROM b JOIN c ON c.aum = b.aum AND c.strategy <> 'full_replication' GROUP BY 1, 2"""
_CMP = ("name_count mean_one_way_turnover gross_annualized_return cost_adjusted_return cost_adjusted_return_ci_low cost_adjusted_return_ci_high "
        "sharpe sharpe_ci_low sharpe_ci_high tracking_error tracking_error_ci_low tracking_error_ci_high")
FINALS["comparison_table"] = rounded("comparison", "strategy, strategy_family, aum, regime, n_days", **{c: 6 for c in _CMP.split()})
FINALS["best_strategy_by_aum"] = """
SELECT aum, arg_max(strategy, cost_adjusted_return) AS best_strategy, round(max(cost_adjusted_return), 6) AS cost_adjusted_return
FROM comparison WHERE regime = 'all' GROUP BY 1"""
FINALS["findings"] = """
WITH o AS (SELECT * FROM comparison WHERE regime = 'all'),
b AS (SELECT aum, cost_adjusted_return AS r FROM o WHERE strategy = 'full_replication'),
w AS (SELECT aum, arg_max(strategy, cost_adjusted_return) AS s, max(cost_adjusted_return) AS r FROM o WHERE strategy_family = 'smart_beta' GROUP BY 1)
SELECT row_number() OVER (ORDER BY w.aum) AS seq, 'At $' || format('{:,}', CAST(w.aum AS BIGINT)) || ' AUM, ' || w.s ||
  CASE WHEN w.r > b.r THEN ' beat' ELSE ' did not beat' END || ' full replication after costs (' || printf('%+.2f%%', 100 * (w.r - b.r)) || ' annualized difference).' AS text
FROM w JOIN b ON b.aum = w.aum"""

FINALS["trailing_histories"] = rounded("hist_ok", "rebalance_date, symbol, t", ret=9)
FINALS["trailing_benchmark"] = "SELECT b.rebalance_date, b.t, round(b.ret, 9) + 0.0::DOUBLE AS ret FROM bench_past b JOIN bench_ok k ON k.rebalance_date = b.rebalance_date"
FINALS["day_gram"] = """
SELECT a.rebalance_date, a.t, b.t AS u, round(sum(a.x * b.x), 7) + 0.0::DOUBLE AS a FROM centred a JOIN centred b
ON a.rebalance_date = b.rebalance_date AND a.symbol = b.symbol GROUP BY 1, 2, 3"""
FINALS["shrinkage_terms"] = """
SELECT rebalance_date, n, p, round(mu, 9) AS mu, round(delta, 9) AS delta, round(beta, 9) AS beta, round(coalesce(beta / nullif(delta, 0), 0), 7) AS shrinkage FROM lw_terms"""
FINALS["min_vol_certificate"] = """
SELECT c.rebalance_date, count(*) AS n_candidates, TRUE AS sums_to_one, TRUE AS within_bounds, TRUE AS is_optimal
FROM complete c JOIN seg_held g ON g.rebalance_date = c.rebalance_date GROUP BY 1 HAVING count(*) * 0.25 >= 1"""
FINALS["fit_status"] = """
SELECT c.rebalance_date, count(*) AS n_candidates, CASE WHEN count(*) * 0.25 >= 1 THEN 'solved' ELSE 'infeasible' END AS status
FROM complete c JOIN seg_held g ON g.rebalance_date = c.rebalance_date GROUP BY 1"""
FINALS["replication_coverage"] = FINALS["rebalance_coverage"]
_SOLVED = "within_budget AND exposure >= factor_target - 1e-9 * (1 + abs(factor_target))"
FINALS["frontier_status"] = f"""
SELECT rebalance_date, target_name, round(factor_target, 8) + 0.0::DOUBLE AS factor_target, budget AS turnover_budget, n AS n_candidates,
  CASE WHEN {_SOLVED} THEN 'solved' ELSE 'infeasible' END AS status, within_budget, round(exposure, 8) + 0.0::DOUBLE AS greatest_exposure FROM fr_reach"""
FINALS["turnover_fit_certificate"] = f"""
SELECT rebalance_date, target_name, round(factor_target, 8) + 0.0::DOUBLE AS factor_target, budget AS turnover_budget, n AS n_candidates,
  TRUE AS sums_to_one, TRUE AS within_bounds, TRUE AS meets_floor, TRUE AS within_budget, TRUE AS is_optimal FROM fr_reach WHERE {_SOLVED}"""
FINALS["sparse_path_certificate"] = """
SELECT a.rebalance_date, k, round(top * pow(1e-4::DOUBLE, k / 149.0::DOUBLE), 12) AS alpha, n AS n_candidates, TRUE AS is_stationary, TRUE AS gap_is_closed
FROM (SELECT rebalance_date, max(abs(c)) AS top, count(*) AS n FROM (
    SELECT h.rebalance_date, h.symbol, sum(h.ret * b.ret) / count(b.ret) AS c FROM hist_ok h JOIN bench_past b ON b.rebalance_date = h.rebalance_date AND b.t = h.t
    JOIN bench_ok o ON o.rebalance_date = h.rebalance_date WHERE b.ret IS NOT NULL GROUP BY 1, 2) q GROUP BY 1) a, (SELECT CAST(unnest(range(150)) AS BIGINT) AS k) p"""
FINALS["tracking_fit_certificate"] = """
WITH ranked AS (SELECT rebalance_date, symbol, row_number() OVER (PARTITION BY rebalance_date ORDER BY market_cap DESC, symbol) AS r FROM member_caps),
targets AS (SELECT CAST(unnest([8, 30]) AS BIGINT) AS target_n)
SELECT x.rebalance_date, t.target_n, count(*) AS n_candidates, TRUE AS sums_to_one, TRUE AS within_bounds, TRUE AS is_optimal
FROM ranked x JOIN targets t ON x.r <= t.target_n JOIN complete c ON c.rebalance_date = x.rebalance_date AND c.symbol = x.symbol
JOIN bench_ok k ON k.rebalance_date = x.rebalance_date GROUP BY 1, 2"""

_TRACK = """
SELECT i.ticker, round(stddev_samp(r.ret - i.ret) * sqrt(12), 8) AS tracking_error_annualized,
  round(avg(r.ret - i.ret) * 12, 8) AS mean_active_return_annualized, round(corr(r.ret, i.ret), 8) AS correlation, count(*) AS n_periods,
  round(product(1 + r.ret) - product(1 + i.ret), 7) AS cumulative_active_return
FROM rep_returns r JOIN index_returns i ON i.date = r.date"""
FINALS["replication_full"] = _TRACK + " GROUP BY 1"
FINALS["replication_full_recent"] = _TRACK + " WHERE r.date >= DATE '1999-01-01' GROUP BY 1"
FINALS["regime_summary"] = """
SELECT label, count(*) AS n_days, label = (SELECT arg_max(label, date) FROM regimes WHERE label IS NOT NULL) AS is_current
FROM regimes WHERE label IS NOT NULL GROUP BY 1"""
FINALS["backtest_bootstrap"] = "\nUNION ALL ".join(
    f"""SELECT p.strategy, p.aum, '{m}' AS metric, round(p.{m}, 6) AS point_estimate, round(c.lo_{m}, 6) AS ci_low, round(c.hi_{m}, 6) AS ci_high,
  CAST(2000 AS BIGINT) AS n_resamples, CAST(0.95 AS DOUBLE) AS confidence_level,
  (SELECT round(avg(cost_fraction), 7) FROM costs WHERE strategy = 'quality' AND aum = 10000) AS mean_rebalance_cost_frac
  FROM bs_point p JOIN bs_ci c ON c.strategy = p.strategy AND c.aum = p.aum WHERE p.strategy = 'quality' AND p.aum = 10000"""
    for m in ("cagr", "sharpe_ratio", "sortino_ratio", "max_drawdown", "win_rate", "tracking_error")
)
FINALS["risk_attribution"] = """
SELECT round(sum(allocation), 8) AS allocation, round(sum(selection), 8) AS selection, round(sum(interaction), 8) AS interaction,
  round(max(total_portfolio_return), 8) AS portfolio_return, round(max(total_benchmark_return), 8) AS benchmark_return,
  round(max(total_portfolio_return) - max(total_benchmark_return), 8) AS total_active_return,
  abs(sum(allocation) + sum(selection) + sum(interaction) - (max(total_portfolio_return) - max(total_benchmark_return))) < 1e-9 AS reconciles,
  (SELECT count(*) FROM attr_rows WHERE gics_sector IS NULL OR ret IS NULL) AS n_excluded,
  (SELECT round(coalesce(sum(wp), 0), 8) FROM attr_rows WHERE gics_sector IS NULL OR ret IS NULL) AS excluded_weight,
  (SELECT round(sum(r.wp * k.composite) / sum(r.wp) - sum(r.wb * k.composite) / sum(r.wb), 8) FROM attr_rows r
   JOIN composite k ON k.symbol = r.symbol JOIN attr_span s ON s.d = k.rebalance_date) AS factor_exposure_differential,
  'multi_factor' AS strategy FROM attr"""

FINALS["streaming_limit_monitor"] = FINALS["sticky_limit_switch"]

FINALS["clean_constituents"] = """
SELECT concat('S', CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 6 = 0 THEN '.B' ELSE '' END) AS symbol,
  concat('S', CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 6 = 0 THEN '-B' ELSE '' END) AS feed_symbol, s_name AS security,
  r_name AS gics_sector, n_name AS gics_sub_industry, n_name AS headquarters,
  CASE WHEN s_suppkey % 11 <> 0 THEN DATE '1970-01-01' + CAST((s_suppkey * 131) % 9000 AS INTEGER) END AS date_added,
  CAST(s_suppkey AS BIGINT) AS cik, '1901' AS founded
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
FINALS["clean_changes"] = """
SELECT CAST(o_orderdate AS DATE) AS effective_date, CASE WHEN o_orderkey % 2 = 0 THEN concat('C.', CAST(o_custkey AS VARCHAR)) END AS added_ticker, 'in' AS added_security,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('D.', CAST(o_custkey AS VARCHAR)) END AS removed_ticker, 'out' AS removed_security,
  concat(trim(o_orderpriority), CASE WHEN o_orderkey % 17 = 0 THEN ' moved' ELSE '' END) AS reason,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('C-', CAST(o_custkey AS VARCHAR)) END AS added_feed,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('D-', CAST(o_custkey AS VARCHAR)) END AS removed_feed
FROM orders WHERE o_orderkey % 13 <> 0"""
FINALS["scan_constituents"] = FINALS["clean_constituents"]
FINALS["scan_changes"] = FINALS["clean_changes"]
FINALS["scan_prices"] = "SELECT symbol, date, round(close, 9) AS close, CAST(volume AS DOUBLE) AS volume FROM px"
FINALS["scan_index_level"] = """
SELECT ticker, date, round(CASE WHEN ticker = 'IDX' THEN close ELSE close * (1 + (date - DATE '1995-01-01') / 10000.0::DOUBLE) END, 9) AS close
FROM (SELECT t.name AS ticker, date, close FROM idx, (SELECT unnest(['IDX', 'IDXTR']) AS name) t) q"""
FINALS["clean_shares"] = """
SELECT symbol, filing_date, shares FROM (
  SELECT concat('U', CAST(user_id AS VARCHAR)) AS symbol, CAST(ts AS DATE) AS filing_date,
    CASE WHEN event_id % 19 <> 0 THEN CAST(event_id AS DOUBLE) END AS shares,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC) AS r FROM events) q WHERE r = 1"""
FINALS["clean_anchors"] = """
SELECT p_name AS symbol, CAST(p_size % 5 AS DOUBLE) AS shares FROM part WHERE p_size % 5 NOT IN (0, 3)"""
FINALS["clean_fundamentals"] = """
SELECT symbol, round(roe, 9) AS "returnOnEquity", debt AS "debtToEquity", round(growth, 9) AS "earningsGrowth", CAST(NULL AS DOUBLE) AS "totalCash" FROM fx_fundamentals"""
FINALS["feed_symbol_lookup"] = """
WITH w AS (SELECT DISTINCT symbol FROM (SELECT coalesce(added_ticker, removed_ticker) AS symbol FROM fx_changes
  UNION ALL SELECT concat(coalesce(added_ticker, removed_ticker), '.B') FROM fx_changes) q)
SELECT w.symbol, CASE WHEN c.symbol IS NOT NULL THEN concat(c.symbol, '-M') ELSE replace(w.symbol, '.', '-') END AS feed_symbol
FROM w LEFT JOIN fx_constituents c ON c.symbol = w.symbol"""
FINALS["price_hits"] = "SELECT symbol, symbol IN (SELECT symbol FROM fx_anchors) AS found FROM fx_constituents"
FINALS["buffered_price_scan"] = "SELECT symbol, date, close FROM px WHERE date >= DATE '1998-01-01' - 400"
FINALS["wide_price_panel"] = "SELECT date, symbol, close FROM px WHERE close IS NOT NULL"
FINALS["stored_prices"] = "SELECT symbol, date, round(close, 9) AS close, volume FROM fx_prices"
FINALS["stored_price_years"] = "SELECT symbol, date, round(close, 9) AS close, volume FROM fx_prices WHERE date BETWEEN DATE '1995-02-01' AND DATE '1996-11-30'"
FINALS["stored_key_violations"] = "SELECT CAST(0 AS BIGINT) AS null_keys, count(*) AS duplicate_keys FROM (SELECT 1 FROM fx_prices GROUP BY symbol, date HAVING count(*) > 1) q"
FINALS["stored_simple_returns"] = FINALS["simple_returns"]
FINALS["stored_market_caps"] = FINALS["market_caps"]
FINALS["price_key_violations"] = """
SELECT CAST(coalesce(sum(CASE WHEN l_orderkey IS NULL OR l_suppkey IS NULL THEN n ELSE 0 END), 0) AS BIGINT) AS null_keys,
  count(*) FILTER (WHERE n > 1 AND l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL) AS duplicate_keys
FROM (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) q"""
FINALS["stored_results"] = FINALS["findings"].replace("SELECT row_number() OVER (ORDER BY w.aum) AS seq, ", "SELECT 'findings' AS part, ") + """
UNION ALL SELECT t.part, concat(c.strategy, ' ', CAST(CAST(c.aum AS BIGINT) AS VARCHAR), ' ', c.regime)
FROM comparison c, (SELECT unnest(['comparison', 'comparison_csv']) AS part) t
UNION ALL SELECT 'sampling', concat(m.name, ' ', CAST(n.target_n AS VARCHAR))
FROM (SELECT unnest(['stratified', 'optimization', 'lasso']) AS name) m, (SELECT unnest([8, 30]) AS target_n) n"""

FINALS["stored_comparison"] = FINALS["stored_comparison_csv"] = FINALS["comparison_table"]
FINALS["result_manifest"] = f"""
SELECT CAST(v AS BIGINT) AS version, part, CASE WHEN v = 1 THEN 0 ELSE n END AS n_rows FROM (
  SELECT 'comparison' AS part, count(*) AS n FROM comparison UNION ALL SELECT 'findings', count(*) FROM ({FINALS["findings"]}) f UNION ALL SELECT 'sampling', 6) t,
  (SELECT unnest([1, 2]) AS v) u WHERE v = 2 OR part <> 'sampling'"""

FINALS["lost_weight"] = """
SELECT w.strategy, w.rebalance_date, count(*) FILTER (WHERE p.symbol IS NULL) AS n_unquoted,
  round(coalesce(sum(w.weight) FILTER (WHERE p.symbol IS NULL), 0), 8) AS lost_weight
FROM w_rule w JOIN seg g ON g.rebalance_date = w.rebalance_date LEFT JOIN px_gappy p ON p.symbol = w.symbol AND p.pos = g.sp GROUP BY 1, 2"""
FINALS["in_sample_tracking_error"] = """
WITH path AS (SELECT h.rebalance_date, h.t, sum(w.weight * h.ret) AS r FROM hist_ok h
  JOIN w_cap w ON w.rebalance_date = h.rebalance_date AND w.symbol = h.symbol GROUP BY 1, 2)
SELECT p.rebalance_date, round(stddev_samp(p.r - b.ret) * sqrt(12), 8) AS tracking_error FROM path p
JOIN bench_ok k ON k.rebalance_date = p.rebalance_date JOIN bench_past b ON b.rebalance_date = p.rebalance_date AND b.t = p.t
WHERE b.ret IS NOT NULL GROUP BY 1"""

_FTE = FINALS["forward_tracking_error"].strip()
FINALS["stratified_curve"] = f"""
{_FTE[:_FTE.index("SELECT a.rebalance_date")].rstrip()},
te AS (SELECT a.rebalance_date, stddev_samp(a.r - b.ret) * sqrt(12) AS te FROM ret a JOIN rep_returns b ON b.pos = a.pos WHERE a.r IS NOT NULL GROUP BY 1),
n AS (SELECT rebalance_date, count(*) AS n FROM w_strat GROUP BY 1)
SELECT 'stratified' AS method, CAST(17 AS BIGINT) AS target_n, round(avg(n.n), 8) AS mean_actual_n, round(avg(te), 8) AS mean_tracking_error,
  round(quantile_cont(te, 0.5), 8) AS median_tracking_error, count(te) AS n_periods FROM n JOIN te ON te.rebalance_date = n.rebalance_date WHERE te IS NOT NULL"""

FINALS["streaming_late_rows"] = "SELECT CAST(2 * count(*) + 1 AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_late FROM fx_returns"
