"""Named DuckDB views: the same data model written independently in SQL."""

VIEWS: dict[str, str] = {}

# --- market derived from the supplied tables ---------------------------------------------

VIEWS["fx_prices"] = """
SELECT l_suppkey AS sid, concat('S', CAST(l_suppkey AS STRING)) AS symbol,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close, sum(l_quantity) AS volume
FROM lineitem GROUP BY 1,2,3"""

VIEWS["cal"] = """
SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS pos, date
FROM (SELECT DISTINCT date FROM fx_prices) q"""

VIEWS["px"] = """
SELECT p.sid, p.symbol, p.date, c.pos, p.close, p.volume FROM fx_prices p JOIN cal c ON p.date = c.date"""

VIEWS["px_gappy"] = "SELECT * FROM px WHERE (sid*31 + pos*17) % 29 <> 0"

VIEWS["fx_daily"] = """
SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close, sum(l_quantity) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1,2"""

VIEWS["cal_daily"] = """
SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS pos, date
FROM (SELECT DISTINCT date FROM fx_daily) q"""

VIEWS["px_daily"] = "SELECT d.symbol, d.date, c.pos, d.close, d.volume FROM fx_daily d JOIN cal_daily c ON d.date = c.date"

VIEWS["idx"] = """
SELECT 'IDX' AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close
FROM lineitem GROUP BY 1,2"""

VIEWS["idx_monthly"] = """
SELECT t.ticker, q.date, CASE WHEN t.ticker = 'IDX' THEN q.close ELSE q.close * (1 + (q.date - DATE '1995-01-01') / 10000.0::DOUBLE) END AS close
FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close
FROM lineitem GROUP BY 1) q, (SELECT unnest(['IDX', 'IDXTR']) AS ticker) t"""

VIEWS["fx_shares"] = """
SELECT s.s_suppkey AS sid, concat('S', CAST(s.s_suppkey AS STRING)) AS symbol, c.date AS filing_date,
       CAST(1000 + (s.s_suppkey*37 + c.pos*11) % 500 AS DOUBLE) AS shares
FROM supplier s CROSS JOIN cal c
WHERE (c.pos + s.s_suppkey) % 3 = 0 AND c.pos >= s.s_suppkey % 5"""

VIEWS["fx_anchors"] = """
SELECT concat('S', CAST(s_suppkey AS STRING)) AS symbol, CAST(1200 + s_suppkey % 300 AS DOUBLE) AS shares
FROM supplier WHERE s_suppkey % 4 = 0"""

VIEWS["fx_constituents"] = """
SELECT concat('S', CAST(s_suppkey AS STRING)) AS symbol, s_name AS security,
       r_name AS gics_sector, n_name AS gics_sub_industry,
       DATE '1970-01-01' + CAST((s_suppkey * 131) % 9000 AS INTEGER) AS date_added
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE s_suppkey % 10 <> 0"""

VIEWS["fx_changes"] = """
SELECT c.date AS effective_date,
       CASE WHEN (s.s_suppkey*7 + c.pos) % 23 = 0  THEN concat('S', CAST(s.s_suppkey AS STRING)) END AS added_ticker,
       CASE WHEN (s.s_suppkey*7 + c.pos) % 23 <> 0 THEN concat('S', CAST(s.s_suppkey AS STRING)) END AS removed_ticker
FROM supplier s CROSS JOIN cal c
WHERE c.pos % 3 = 1 AND ((s.s_suppkey*7 + c.pos) % 23 = 0 OR (s.s_suppkey*5 + c.pos) % 29 = 0)"""

VIEWS["fx_fundamentals"] = """
SELECT concat('S', CAST(s_suppkey AS STRING)) AS symbol,
       avg(l_discount) AS roe, avg(l_tax) AS margin,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL
            ELSE sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)/sum(l_quantity) END AS growth,
       CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END AS debt,
       avg(l_extendedprice)/1000 AS eps
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_acctbal"""

VIEWS["fx_returns"] = """
SELECT e.event_type AS strategy, e.date, (e.v - 50)/1000 AS ret, (b.v - 50)/1000 AS bench_ret
FROM (SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY 1,2) e
JOIN (SELECT CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY 1) b ON e.date = b.date"""

# --- schedule and segments ---------------------------------------------------------------

VIEWS["sched"] = """
SELECT CAST(make_date(y, m, 1) + CAST((12 - dayofweek(make_date(y, m, 1))) % 7 + 14 AS INTEGER) AS DATE) AS rebalance_date
FROM (SELECT CAST(unnest(range(year(min(date) FILTER (WHERE pos >= 12)), year(max(date)) + 1)) AS INTEGER) AS y FROM cal) a,
     (SELECT CAST(unnest([3, 6, 9, 12]) AS INTEGER) AS m) b"""

VIEWS["sched_next"] = """
SELECT rebalance_date, lead(rebalance_date) OVER (ORDER BY rebalance_date) AS next_rebalance FROM sched"""

VIEWS["seg"] = """
SELECT s.rebalance_date, s.next_rebalance, s.next_rebalance IS NULL AS is_last,
       (SELECT min(c.pos) FROM cal c WHERE c.date >= s.rebalance_date) AS sp,
       (SELECT min(c.date) FROM cal c WHERE c.date >= s.rebalance_date) AS start_date,
       (SELECT max(c.pos) FROM cal c WHERE s.next_rebalance IS NULL OR c.date <= s.next_rebalance) AS ep
FROM sched_next s WHERE (SELECT max(c.date) FROM cal c) >= s.rebalance_date"""

VIEWS["seg_held"] = "SELECT * FROM seg WHERE NOT is_last"

# --- membership --------------------------------------------------------------------------

VIEWS["chg"] = """
SELECT effective_date, added_ticker AS symbol, 1 AS kind FROM fx_changes WHERE added_ticker IS NOT NULL
UNION ALL SELECT effective_date, removed_ticker, 0 FROM fx_changes WHERE removed_ticker IS NOT NULL"""

VIEWS["grid_syms"] = """
SELECT DISTINCT symbol FROM (SELECT symbol FROM fx_constituents UNION ALL SELECT symbol FROM chg) q"""

VIEWS["first_later"] = """
SELECT s.rebalance_date, c.symbol, arg_min(c.kind, (epoch(c.effective_date) * 2 + c.kind)) AS kind
FROM sched s JOIN chg c ON c.effective_date > s.rebalance_date GROUP BY 1, 2"""

VIEWS["members"] = """
SELECT s.rebalance_date, g.symbol
FROM sched s CROSS JOIN grid_syms g
LEFT JOIN first_later f ON f.rebalance_date = s.rebalance_date AND f.symbol = g.symbol
LEFT JOIN fx_constituents k ON k.symbol = g.symbol
WHERE CASE WHEN f.kind IS NOT NULL THEN f.kind = 0 ELSE k.symbol IS NOT NULL END"""

# --- prices, returns, fills --------------------------------------------------------------

VIEWS["rets"] = """
SELECT a.symbol, a.pos, a.close / nullif(b.close, 0) - 1 AS ret
FROM px a JOIN px b ON a.symbol = b.symbol AND b.pos = a.pos - 1 WHERE b.close <> 0"""

VIEWS["filled"] = """
SELECT g.symbol, g.pos, p.pos AS from_pos, p.close
FROM (SELECT s.symbol, c.pos FROM (SELECT DISTINCT symbol FROM px) s CROSS JOIN cal c) g
ASOF JOIN px p ON p.symbol = g.symbol AND p.pos <= g.pos"""

VIEWS["filled_gappy"] = """
SELECT g.symbol, g.pos, p.pos AS from_pos, p.close
FROM (SELECT s.symbol, c.pos FROM (SELECT DISTINCT symbol FROM px_gappy) s CROSS JOIN cal c) g
ASOF JOIN px_gappy p ON p.symbol = g.symbol AND p.pos <= g.pos"""

# --- caps and simple weights -------------------------------------------------------------

VIEWS["last_shares"] = "SELECT symbol, arg_max(shares, filing_date) AS last_shares FROM fx_shares GROUP BY 1"

VIEWS["caps"] = """
SELECT p.symbol, p.pos, p.date, p.close,
       p.close * (s.shares * CASE WHEN a.shares <> 0 AND l.last_shares > 0 THEN a.shares / l.last_shares ELSE 1 END) AS market_cap
FROM px p ASOF JOIN fx_shares s ON s.symbol = p.symbol AND s.filing_date <= p.date
LEFT JOIN last_shares l ON l.symbol = p.symbol LEFT JOIN fx_anchors a ON a.symbol = p.symbol"""

VIEWS["start_caps"] = """
SELECT g.rebalance_date, c.symbol, c.close, c.market_cap FROM seg g JOIN caps c ON c.pos = g.sp"""

VIEWS["member_caps"] = """
SELECT s.* FROM start_caps s JOIN members m ON m.rebalance_date = s.rebalance_date AND m.symbol = s.symbol
WHERE s.market_cap > 0"""

VIEWS["w_cap"] = """
SELECT rebalance_date, symbol, market_cap / sum(market_cap) OVER (PARTITION BY rebalance_date) AS weight FROM member_caps"""

VIEWS["w_equal"] = """
SELECT m.rebalance_date, m.symbol, 1.0 / count(*) OVER (PARTITION BY m.rebalance_date) AS weight
FROM members m JOIN seg g ON g.rebalance_date = m.rebalance_date
JOIN px p ON p.symbol = m.symbol AND p.pos = g.sp WHERE p.close > 0"""

# --- full replication --------------------------------------------------------------------

VIEWS["rep_growth"] = """
SELECT g.rebalance_date, d.pos, sum(w.weight * d.close / o.close) AS growth
FROM seg g JOIN w_cap w ON w.rebalance_date = g.rebalance_date
JOIN filled o ON o.symbol = w.symbol AND o.pos = g.sp AND o.close <> 0
JOIN filled d ON d.symbol = w.symbol AND d.pos BETWEEN g.sp AND g.ep GROUP BY 1, 2"""

VIEWS["rep_ends"] = "SELECT rebalance_date, arg_max(growth, pos) AS e FROM rep_growth GROUP BY 1"

VIEWS["rep_base"] = """
SELECT rebalance_date, coalesce(product(e) OVER (ORDER BY rebalance_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS base
FROM rep_ends"""

VIEWS["rep_values"] = """
SELECT c.pos, c.date, v.value FROM (
  SELECT g.pos, arg_min(b.base * g.growth, g.rebalance_date) AS value
  FROM rep_growth g JOIN rep_base b ON b.rebalance_date = g.rebalance_date GROUP BY 1) v JOIN cal c ON c.pos = v.pos"""

VIEWS["rep_returns"] = """
SELECT pos, date, CASE WHEN abs(ret) < 1e-12 THEN 0 ELSE ret END AS ret
FROM (SELECT pos, date, value / nullif(lag(value) OVER (ORDER BY pos), 0) - 1 AS ret FROM rep_values) q
WHERE ret IS NOT NULL"""

# --- factors (momentum 12/1, low-vol 6, IC horizon 1, IC lookback 6, 12 periods a year) ----

VIEWS["mom_raw"] = """
SELECT a.symbol, a.pos + 1 AS pos, a.close / b.close - 1 AS raw
FROM px a JOIN px b ON a.symbol = b.symbol AND b.pos = a.pos - 11 WHERE b.close <> 0 AND a.pos + 1 <= (SELECT max(pos) FROM cal)"""

VIEWS["lowvol_raw"] = """
SELECT symbol, pos, -s * sqrt(12) AS raw FROM (
  SELECT a.symbol, a.pos, stddev_samp(b.ret) AS s, count(*) AS n
  FROM rets a JOIN rets b ON a.symbol = b.symbol AND b.pos BETWEEN a.pos - 5 AND a.pos GROUP BY 1, 2) q WHERE n = 6"""

VIEWS["value_raw"] = """
SELECT p.symbol, p.pos, f.eps / nullif(p.close, 0) AS raw FROM px p JOIN fx_fundamentals f ON f.symbol = p.symbol
WHERE f.eps IS NOT NULL AND p.close <> 0"""

for _f in ("mom", "lowvol", "value"):
    VIEWS[f"{_f}_z"] = f"""
SELECT r.symbol, r.pos, (r.raw - s.m) / s.d AS score FROM {_f}_raw r
JOIN (SELECT pos, avg(raw) AS m, stddev_samp(raw) AS d FROM {_f}_raw GROUP BY 1) s ON s.pos = r.pos WHERE s.d <> 0"""

VIEWS["quality_parts"] = """
SELECT f.symbol, (roe - (SELECT avg(roe) FROM fx_fundamentals)) / (SELECT nullif(stddev_pop(roe), 0) FROM fx_fundamentals) AS z1,
       (margin - (SELECT avg(margin) FROM fx_fundamentals)) / (SELECT nullif(stddev_pop(margin), 0) FROM fx_fundamentals) AS z2,
       (growth - (SELECT avg(growth) FROM fx_fundamentals)) / (SELECT nullif(stddev_pop(growth), 0) FROM fx_fundamentals) AS z3,
       -(debt - (SELECT avg(debt) FROM fx_fundamentals)) / (SELECT nullif(stddev_pop(debt), 0) FROM fx_fundamentals) AS z4
FROM fx_fundamentals f"""

VIEWS["quality_z"] = """
SELECT symbol, (coalesce(z1, 0) + coalesce(z2, 0) + coalesce(z3, 0) + coalesce(z4, 0))
  / nullif((z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT + (z3 IS NOT NULL)::INT + (z4 IS NOT NULL)::INT, 0) AS score
FROM quality_parts"""

VIEWS["fwd"] = """
SELECT a.symbol, a.pos, b.close / a.close - 1 AS fwd FROM px a JOIN px b ON a.symbol = b.symbol AND b.pos = a.pos + 1
WHERE a.close <> 0"""

VIEWS["ic_pairs"] = """
SELECT 'momentum' AS factor, z.symbol, z.pos, z.score, f.fwd FROM mom_z z JOIN fwd f ON f.symbol = z.symbol AND f.pos = z.pos
UNION ALL SELECT 'low_vol', z.symbol, z.pos, z.score, f.fwd FROM lowvol_z z JOIN fwd f ON f.symbol = z.symbol AND f.pos = z.pos
UNION ALL SELECT 'value', z.symbol, z.pos, z.score, f.fwd FROM value_z z JOIN fwd f ON f.symbol = z.symbol AND f.pos = z.pos
UNION ALL SELECT 'quality', z.symbol, f.pos, z.score, f.fwd FROM quality_z z JOIN fwd f ON f.symbol = z.symbol WHERE z.score IS NOT NULL"""

VIEWS["ic_ranked"] = """
SELECT factor, pos,
  rank() OVER (PARTITION BY factor, pos ORDER BY score) + (count(*) OVER (PARTITION BY factor, pos, score) - 1) / 2.0 AS rs,
  rank() OVER (PARTITION BY factor, pos ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, pos, fwd) - 1) / 2.0 AS rf
FROM ic_pairs"""

VIEWS["ic_series"] = """
SELECT factor, pos, count(*) AS n_names, corr(rs, rf) AS ic FROM ic_ranked GROUP BY 1, 2 HAVING count(*) >= 10"""

VIEWS["factor_list"] = "SELECT unnest(['momentum', 'low_vol', 'value', 'quality']) AS factor"

for _name, _e in (("ic_w", 0), ("ic_w_embargo", 1)):
    VIEWS[f"{_name}_raw"] = f"""
SELECT g.rebalance_date, l.factor, greatest(0, coalesce(avg(i.ic), 0)) AS v
FROM seg g CROSS JOIN factor_list l
LEFT JOIN ic_series i ON i.factor = l.factor AND i.pos BETWEEN g.sp - 6 - {_e} AND g.sp - 1 - {_e} GROUP BY 1, 2"""
    VIEWS[_name] = f"""
SELECT rebalance_date, factor, CASE WHEN sum(v) OVER (PARTITION BY rebalance_date) > 0
  THEN v / sum(v) OVER (PARTITION BY rebalance_date) ELSE 0.25 END AS weight FROM {_name}_raw"""

VIEWS["start_scores"] = """
SELECT g.rebalance_date, 'momentum' AS factor, z.symbol, z.score FROM seg g JOIN mom_z z ON z.pos = g.sp
UNION ALL SELECT g.rebalance_date, 'low_vol', z.symbol, z.score FROM seg g JOIN lowvol_z z ON z.pos = g.sp
UNION ALL SELECT g.rebalance_date, 'value', z.symbol, z.score FROM seg g JOIN value_z z ON z.pos = g.sp
UNION ALL SELECT g.rebalance_date, 'quality', z.symbol, z.score FROM seg g CROSS JOIN quality_z z WHERE z.score IS NOT NULL"""

VIEWS["composite"] = """
SELECT * FROM (SELECT s.rebalance_date, s.symbol, sum(w.weight * s.score) / nullif(sum(w.weight), 0) AS composite
FROM start_scores s JOIN ic_w w ON w.rebalance_date = s.rebalance_date AND w.factor = s.factor GROUP BY 1, 2) q
WHERE composite IS NOT NULL"""

# --- fundamentals as they were known ------------------------------------------------------

VIEWS["fx_reports"] = """
SELECT concat('S', CAST(k AS STRING)) AS symbol, d AS period_end, CASE WHEN late = 1 THEN d + 220 ELSE d + CAST(20 + k % 30 AS INTEGER) END AS as_of,
  CASE WHEN turn % 4 <> 0 THEN CASE WHEN late = 1 THEN roe * 1.25::DOUBLE ELSE roe END END AS roe, CASE WHEN late = 0 THEN margin END AS margin,
  CASE WHEN k % 7 <> 0 THEN growth END AS growth, CASE WHEN turn % 3 <> 0 THEN CAST(n * 10 + k % 11 + 5 * late AS DOUBLE) END AS debt,
  CASE WHEN turn % 5 <> 0 OR late = 1 THEN CASE WHEN late = 1 THEN eps * 0.9::DOUBLE ELSE eps END END AS eps
FROM (SELECT *, k + month(d) AS turn, unnest(CASE WHEN k % 5 = 0 THEN [0, 1] ELSE [0] END) AS late FROM (
  SELECT l_suppkey AS k, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS d, avg(l_discount) AS roe, avg(l_tax) AS margin,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS growth,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100000 AS eps, count(*) AS n
  FROM lineitem GROUP BY 1, 2) q) t"""

_KNOWN = ", ".join(f"arg_max({c}, (r.period_end - DATE '1900-01-01') * 100000 + (r.as_of - DATE '1900-01-01')) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("roe", "margin", "growth", "debt", "eps"))
VIEWS["known_days"] = f"""
SELECT k.symbol, k.as_of AS known_from, {_KNOWN}
FROM (SELECT DISTINCT symbol, as_of FROM fx_reports) k JOIN fx_reports r ON r.symbol = k.symbol AND r.as_of <= k.as_of GROUP BY 1, 2"""
VIEWS["known_reb"] = f"SELECT s.rebalance_date AS t, r.symbol, {_KNOWN} FROM sched s JOIN fx_reports r ON r.as_of <= s.rebalance_date GROUP BY 1, 2"
VIEWS["known_pos"] = f"SELECT c.pos AS t, r.symbol, {_KNOWN} FROM cal c JOIN fx_reports r ON r.as_of <= c.date GROUP BY 1, 2"
for _v in ("reb", "pos"):
    VIEWS[f"quality_known_{_v}"] = f"""
SELECT t, symbol, (coalesce(z1, 0) + coalesce(z2, 0) + coalesce(z3, 0) + coalesce(z4, 0))
  / nullif((z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT + (z3 IS NOT NULL)::INT + (z4 IS NOT NULL)::INT, 0) AS score FROM (
  SELECT t, symbol, (roe - avg(roe) OVER w) / nullif(stddev_pop(roe) OVER w, 0) AS z1, (margin - avg(margin) OVER w) / nullif(stddev_pop(margin) OVER w, 0) AS z2,
    (growth - avg(growth) OVER w) / nullif(stddev_pop(growth) OVER w, 0) AS z3, -(debt - avg(debt) OVER w) / nullif(stddev_pop(debt) OVER w, 0) AS z4
  FROM known_{_v} WINDOW w AS (PARTITION BY t)) q"""
VIEWS["value_known_raw"] = """
SELECT p.symbol, p.pos, k.eps / p.close AS raw FROM px p JOIN known_pos k ON k.symbol = p.symbol AND k.t = p.pos WHERE k.eps IS NOT NULL AND p.close <> 0"""
VIEWS["value_known_z"] = VIEWS["value_z"].replace("value_raw", "value_known_raw")
VIEWS["ic_pairs_known"] = VIEWS["ic_pairs"].replace("value_z", "value_known_z").split("UNION ALL SELECT 'quality'")[0] + """
UNION ALL SELECT 'quality', z.symbol, f.pos, z.score, f.fwd FROM quality_known_pos z JOIN fwd f ON f.symbol = z.symbol AND f.pos = z.t WHERE z.score IS NOT NULL"""
VIEWS["ic_ranked_known"] = VIEWS["ic_ranked"].replace("ic_pairs", "ic_pairs_known")
VIEWS["ic_series_known"] = VIEWS["ic_series"].replace("ic_ranked", "ic_ranked_known")
VIEWS["ic_w_known_raw"] = VIEWS["ic_w_raw"].replace("ic_series", "ic_series_known")
VIEWS["ic_w_known"] = VIEWS["ic_w"].replace("ic_w_raw", "ic_w_known_raw")
VIEWS["start_scores_known"] = VIEWS["start_scores"].replace("value_z", "value_known_z").split("UNION ALL SELECT g.rebalance_date, 'quality'")[0] + """
UNION ALL SELECT g.rebalance_date, 'quality', z.symbol, z.score FROM seg g JOIN quality_known_pos z ON z.t = g.sp WHERE z.score IS NOT NULL"""
VIEWS["composite_known"] = VIEWS["composite"].replace("start_scores", "start_scores_known").replace("ic_w ", "ic_w_known ")
VIEWS["w_quality_known"] = """
SELECT m.rebalance_date, m.symbol,
  exp(least(3, greatest(-3, q.score))) / sum(exp(least(3, greatest(-3, q.score)))) OVER (PARTITION BY m.rebalance_date) AS weight
FROM members m JOIN seg_held g ON g.rebalance_date = m.rebalance_date JOIN quality_known_reb q ON q.symbol = m.symbol AND q.t = m.rebalance_date
WHERE q.score IS NOT NULL"""

# --- rule-based variants -----------------------------------------------------------------

VIEWS["w_quality"] = """
SELECT m.rebalance_date, m.symbol,
  exp(least(3, greatest(-3, q.score))) / sum(exp(least(3, greatest(-3, q.score)))) OVER (PARTITION BY m.rebalance_date) AS weight
FROM members m JOIN seg_held g ON g.rebalance_date = m.rebalance_date JOIN quality_z q ON q.symbol = m.symbol
WHERE q.score IS NOT NULL"""

VIEWS["w_tilt"] = """
SELECT rebalance_date, symbol, t / sum(t) OVER (PARTITION BY rebalance_date) AS weight FROM (
  SELECT c.rebalance_date, c.symbol, c.market_cap * exp(0.5 * least(3, greatest(-3, k.composite))) AS t
  FROM member_caps c JOIN seg_held g ON g.rebalance_date = c.rebalance_date
  JOIN composite k ON k.rebalance_date = c.rebalance_date AND k.symbol = c.symbol) q"""

VIEWS["w_rule"] = """
SELECT 'equal_weight' AS strategy, e.rebalance_date, e.symbol, e.weight FROM w_equal e JOIN seg_held g ON g.rebalance_date = e.rebalance_date
UNION ALL SELECT 'quality', rebalance_date, symbol, weight FROM w_quality
UNION ALL SELECT 'multi_factor', rebalance_date, symbol, weight FROM w_tilt"""

VIEWS["w_all"] = """
SELECT * FROM w_rule UNION ALL SELECT 'full_replication', rebalance_date, symbol, weight FROM w_cap"""

VIEWS["top10"] = """
SELECT * FROM (SELECT rebalance_date, symbol, row_number() OVER (PARTITION BY rebalance_date ORDER BY market_cap DESC, symbol) AS cap_rank
FROM member_caps) q WHERE cap_rank <= 10"""

VIEWS["sector_k"] = """
SELECT m.rebalance_date, greatest(1, CAST(round_even(17.0 / greatest(count(DISTINCT c.gics_sector), 1), 0) AS BIGINT)) AS k
FROM members m JOIN fx_constituents c ON c.symbol = m.symbol GROUP BY 1"""

VIEWS["sector_ranked"] = """
SELECT p.rebalance_date, c.gics_sector, p.symbol, p.market_cap,
  row_number() OVER (PARTITION BY p.rebalance_date, c.gics_sector ORDER BY p.market_cap DESC, p.symbol) - 1 AS r,
  count(*) OVER (PARTITION BY p.rebalance_date, c.gics_sector) AS n
FROM member_caps p JOIN fx_constituents c ON c.symbol = p.symbol"""

VIEWS["tier_edges"] = """
SELECT rebalance_date, gics_sector, symbol, market_cap, r,
  unnest(range(1, least(k, n))) AS j, least(k, n) AS kk, n
FROM sector_ranked JOIN sector_k USING (rebalance_date)"""

VIEWS["tier_positions"] = """
SELECT *, ((j * (1.0::DOUBLE / kk)) * 100.0::DOUBLE / 100.0::DOUBLE) * (n - 1) AS v FROM tier_edges"""

VIEWS["tier_counts"] = """
SELECT rebalance_date, gics_sector, symbol, CAST(count(*) AS BIGINT) AS tier FROM tier_positions
WHERE r > CASE WHEN v - floor(v) < 0.5 THEN floor(v) + (v - floor(v)) * (least(floor(v) + 1, n - 1) - floor(v))
               ELSE least(floor(v) + 1, n - 1) - (1 - (v - floor(v))) * (least(floor(v) + 1, n - 1) - floor(v)) END
GROUP BY 1, 2, 3"""

VIEWS["buckets"] = """
SELECT s.rebalance_date, s.gics_sector, s.symbol, s.market_cap, coalesce(t.tier, 0) AS tier
FROM sector_ranked s LEFT JOIN tier_counts t ON t.rebalance_date = s.rebalance_date AND t.symbol = s.symbol"""

VIEWS["w_strat"] = """
SELECT rebalance_date, symbol, cap / sum(cap) OVER (PARTITION BY rebalance_date) AS weight FROM (
  SELECT rebalance_date, gics_sector, tier, arg_max(symbol, market_cap) AS symbol, sum(market_cap) AS cap
  FROM buckets GROUP BY 1, 2, 3) q"""

# --- valuation of variants ---------------------------------------------------------------

VIEWS["rule_growth_raw"] = """
SELECT w.strategy, g.rebalance_date, d.pos, sum(w.weight * d.close / o.close) AS growth
FROM seg g JOIN w_rule w ON w.rebalance_date = g.rebalance_date
JOIN px o ON o.symbol = w.symbol AND o.pos = g.sp AND o.close <> 0
JOIN filled d ON d.symbol = w.symbol AND d.pos BETWEEN g.sp AND g.ep GROUP BY 1, 2, 3"""

VIEWS["rule_growth"] = """
SELECT strategy, rebalance_date, pos, growth / first_value(growth) OVER (PARTITION BY strategy, rebalance_date ORDER BY pos) AS growth
FROM rule_growth_raw"""

VIEWS["rule_ends"] = "SELECT strategy, rebalance_date, arg_max(growth, pos) AS e FROM rule_growth GROUP BY 1, 2"

VIEWS["rule_base"] = """
SELECT strategy, rebalance_date, coalesce(product(e) OVER (PARTITION BY strategy ORDER BY rebalance_date
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS base FROM rule_ends"""

VIEWS["rule_values"] = """
SELECT v.strategy, c.pos, c.date, v.value FROM (
  SELECT g.strategy, g.pos, arg_min(b.base * g.growth, g.rebalance_date) AS value
  FROM rule_growth g JOIN rule_base b ON b.strategy = g.strategy AND b.rebalance_date = g.rebalance_date GROUP BY 1, 2) v
JOIN cal c ON c.pos = v.pos"""

VIEWS["rule_returns"] = """
SELECT strategy, pos, date, CASE WHEN abs(ret) < 1e-12 THEN 0 ELSE ret END AS ret FROM (SELECT strategy, pos, date, value / nullif(lag(value) OVER (PARTITION BY strategy ORDER BY pos), 0) - 1 AS ret
  FROM rule_values) q WHERE ret IS NOT NULL
UNION ALL SELECT 'full_replication', pos, date, ret FROM rep_returns"""

VIEWS["rule_pairs"] = """
SELECT r.strategy, r.pos, r.date, r.ret, b.ret AS bench_ret FROM rule_returns r JOIN rep_returns b ON b.date = r.date"""

VIEWS["index_returns"] = """
SELECT * FROM (SELECT i.ticker, i.date, i.close / nullif(lag(i.close) OVER w, 0) - 1 AS ret, c.pos - lag(c.pos) OVER w AS step
FROM idx_monthly i JOIN cal c ON c.date = i.date WINDOW w AS (PARTITION BY i.ticker ORDER BY c.pos)) q WHERE ret IS NOT NULL AND step = 1"""

# --- regimes -----------------------------------------------------------------------------

VIEWS["idx_logs"] = """
SELECT row_number() OVER (ORDER BY date) - 1 AS p, date, ln(close / lag(close) OVER (ORDER BY date)) AS l FROM idx"""

VIEWS["idx_vol"] = """
SELECT date, CASE WHEN n = 21 THEN s * sqrt(252) END AS vol FROM (
  SELECT date, stddev_samp(l) OVER w AS s, count(l) OVER w AS n FROM idx_logs
  WINDOW w AS (ORDER BY p ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) q"""

VIEWS["vol_cuts"] = "SELECT quantile_cont(vol, 1.0::DOUBLE/3) AS lo, quantile_cont(vol, 2.0::DOUBLE/3) AS hi FROM idx_vol"

VIEWS["regimes"] = """
SELECT date, vol, CASE WHEN vol IS NULL THEN NULL WHEN vol <= lo THEN 'calm' WHEN vol >= hi THEN 'volatile' ELSE 'normal' END AS label
FROM idx_vol, vol_cuts"""

VIEWS["regime_stats_all"] = """
SELECT r.strategy, g.label AS regime, pow(1 + avg(r.ret), 12) - 1 AS annualized_return, stddev_samp(r.ret) * sqrt(12) AS annualized_vol, count(*) AS n_days
FROM rule_returns r JOIN regimes g ON g.date = r.date WHERE g.label IS NOT NULL GROUP BY 1, 2"""

VIEWS["regime_stats"] = """
SELECT *, CASE WHEN annualized_vol > 0 THEN annualized_return / annualized_vol END AS sharpe_zero_rate
FROM regime_stats_all WHERE n_days >= 5"""

# --- liquidity and costs (volume window 6, vol window 6) ---------------------------------

VIEWS["px_logs"] = """
SELECT p.symbol, p.pos, p.close, p.volume, ln(p.close / b.close) AS l
FROM px p LEFT JOIN px b ON b.symbol = p.symbol AND b.pos = p.pos - 1 AND b.close > 0"""

VIEWS["px_vol"] = """
SELECT symbol, pos, CASE WHEN n = 6 THEN s * sqrt(12) END AS vol FROM (
  SELECT a.symbol, a.pos, stddev_samp(b.l) AS s, count(b.l) AS n
  FROM px_logs a JOIN px_logs b ON b.symbol = a.symbol AND b.pos BETWEEN a.pos - 5 AND a.pos GROUP BY 1, 2) q"""

VIEWS["adv_end"] = "SELECT symbol, avg(close * volume) AS adv FROM px WHERE pos > (SELECT max(pos) FROM cal) - 6 GROUP BY 1"

VIEWS["vol_end"] = "SELECT symbol, vol FROM px_vol WHERE pos = (SELECT max(pos) FROM cal)"

VIEWS["liq_end"] = """
SELECT coalesce(v.symbol, a.symbol) AS symbol, v.vol, a.adv FROM vol_end v FULL JOIN adv_end a ON a.symbol = v.symbol"""

VIEWS["held_next"] = """
SELECT strategy, rebalance_date, lag(rebalance_date) OVER (PARTITION BY strategy ORDER BY rebalance_date) AS prev
FROM (SELECT DISTINCT strategy, rebalance_date FROM w_all) q"""

VIEWS["dw_all"] = """
SELECT strategy, rebalance_date, symbol, sum(w) AS weight, sum(w) - sum(pw) AS dw FROM (
  SELECT strategy, rebalance_date, symbol, weight AS w, 0.0::DOUBLE AS pw FROM w_all
  UNION ALL SELECT w.strategy, h.rebalance_date, w.symbol, 0.0::DOUBLE, w.weight FROM held_next h
  JOIN w_all w ON w.strategy = h.strategy AND w.rebalance_date = h.prev) q GROUP BY 1, 2, 3"""

VIEWS["turns"] = """
SELECT strategy, rebalance_date, CAST(count(*) FILTER (WHERE abs(weight) > 1e-8) AS BIGINT) AS n_holdings,
  sum(abs(dw)) AS two_way_turnover, sum(abs(dw)) / 2 AS one_way_turnover FROM dw_all GROUP BY 1, 2"""

VIEWS["metadata"] = """
SELECT t.strategy, avg(n_holdings) AS name_count, avg(one_way_turnover) FILTER (WHERE h.prev IS NOT NULL) AS mean_one_way_turnover
FROM turns t JOIN held_next h ON h.strategy = t.strategy AND h.rebalance_date = t.rebalance_date GROUP BY 1"""

VIEWS["aums"] = "SELECT CAST(unnest([1000, 10000, 100000]) AS DOUBLE) AS aum"

VIEWS["trades"] = """
SELECT d.strategy, d.rebalance_date, d.symbol, a.aum, abs(d.dw) >= 1e-12 AS traded, d.dw * a.aum AS trade_value, l.vol, l.adv,
  CASE WHEN l.adv > 0 AND l.vol IS NOT NULL THEN l.vol * sqrt(abs(d.dw * a.aum) / l.adv) END AS fraction
FROM dw_all d CROSS JOIN aums a LEFT JOIN liq_end l ON l.symbol = d.symbol"""

VIEWS["costs"] = """
SELECT strategy, rebalance_date, aum, coalesce(sum(abs(trade_value) * fraction) FILTER (WHERE traded), 0) / aum AS cost_fraction,
  count(fraction) FILTER (WHERE traded) AS n_priced, count(*) FILTER (WHERE traded AND fraction IS NULL) AS n_excluded
FROM trades GROUP BY 1, 2, 3"""

VIEWS["hits"] = """
SELECT c.strategy, c.aum, (SELECT min(r.date) FROM rule_returns r WHERE r.strategy = c.strategy AND r.date >= c.rebalance_date) AS date,
  c.cost_fraction FROM costs c"""

VIEWS["adjusted"] = """
SELECT r.strategy, a.aum, r.pos, r.date, r.ret AS gross_ret, r.ret - coalesce(h.c, 0) AS ret
FROM rule_returns r CROSS JOIN aums a
LEFT JOIN (SELECT strategy, aum, date, sum(cost_fraction) AS c FROM hits GROUP BY 1, 2, 3) h
  ON h.strategy = r.strategy AND h.aum = a.aum AND h.date = r.date"""

VIEWS["adj_pairs"] = """
SELECT a.strategy, a.aum, a.pos, a.date, a.ret, a.gross_ret, b.ret AS bench_ret FROM adjusted a JOIN rep_returns b ON b.date = a.date"""

VIEWS["gross_annual"] = "SELECT strategy, pow(1 + avg(ret), 12) - 1 AS gross_return FROM rule_returns GROUP BY 1"

# --- attribution -------------------------------------------------------------------------

VIEWS["attr_span"] = """
SELECT max(d) FILTER (WHERE k = 2) AS d, max(sp) FILTER (WHERE k = 2) AS a, max(sp) FILTER (WHERE k = 1) AS b FROM (
  SELECT t.rebalance_date AS d, g.sp, row_number() OVER (ORDER BY t.rebalance_date DESC) AS k
  FROM (SELECT DISTINCT rebalance_date FROM w_tilt) t JOIN seg g ON g.rebalance_date = t.rebalance_date) q"""

VIEWS["attr_rows"] = """
SELECT coalesce(p.symbol, b.symbol) AS symbol, coalesce(p.weight, 0) AS wp, coalesce(b.weight, 0) AS wb, c.gics_sector, y.close / x.close - 1 AS ret
FROM (SELECT w.* FROM w_tilt w, attr_span s WHERE w.rebalance_date = s.d) p
FULL JOIN (SELECT w.* FROM w_cap w, attr_span s WHERE w.rebalance_date = s.d) b ON b.symbol = p.symbol
LEFT JOIN fx_constituents c ON c.symbol = coalesce(p.symbol, b.symbol)
LEFT JOIN (SELECT q.* FROM px q, attr_span s WHERE q.pos = s.a) x ON x.symbol = coalesce(p.symbol, b.symbol)
LEFT JOIN (SELECT q.* FROM px q, attr_span s WHERE q.pos = s.b) y ON y.symbol = coalesce(p.symbol, b.symbol)"""

VIEWS["attr_known"] = """
SELECT gics_sector AS sector, wp / sum(wp) OVER () AS wp, wb / sum(wb) OVER () AS wb, ret
FROM attr_rows WHERE gics_sector IS NOT NULL AND ret IS NOT NULL"""

VIEWS["attr_sector"] = """
SELECT sector, sum(wp) AS pw, sum(wb) AS bw, coalesce(sum(wp * ret) / nullif(sum(wp), 0), 0) AS pr, coalesce(sum(wb * ret) / nullif(sum(wb), 0), 0) AS br,
  (SELECT sum(wp * ret) FROM attr_known) AS tp, (SELECT sum(wb * ret) FROM attr_known) AS tb FROM attr_known GROUP BY 1"""

VIEWS["attr"] = """
SELECT sector, pw AS portfolio_weight, bw AS benchmark_weight, pr AS portfolio_return, br AS benchmark_return,
  (pw - bw) * (br - tb) AS allocation, bw * (pr - br) AS selection, (pw - bw) * (pr - br) AS interaction,
  tp AS total_portfolio_return, tb AS total_benchmark_return FROM attr_sector"""

# --- limits ------------------------------------------------------------------------------

VIEWS["rel"] = """
SELECT strategy, date, ret, bench_ret, product(1 + ret) OVER w / product(1 + bench_ret) OVER w AS value FROM rule_pairs
WINDOW w AS (PARTITION BY strategy ORDER BY date)"""

VIEWS["rel_adj"] = """
SELECT strategy, aum, date, ret, bench_ret, product(1 + ret) OVER w / product(1 + bench_ret) OVER w AS value FROM adj_pairs
WINDOW w AS (PARTITION BY strategy, aum ORDER BY date)"""

VIEWS["rel_adj_dd"] = """
SELECT *, 1 - value / greatest(1, max(value) OVER (PARTITION BY strategy, aum ORDER BY date)) AS drawdown FROM rel_adj"""

VIEWS["ev_rel"] = """
SELECT strategy, date, ret, bench_ret, product(1 + ret) OVER w / product(1 + bench_ret) OVER w AS value,
  stddev_samp(ret - bench_ret) OVER w * sqrt(252) AS te FROM fx_returns WINDOW w AS (PARTITION BY strategy ORDER BY date)"""

VIEWS["ev_dd"] = """
SELECT *, 1 - value / greatest(1, max(value) OVER (PARTITION BY strategy ORDER BY date)) AS dd FROM ev_rel"""

VIEWS["ev_checks"] = """
SELECT strategy, date, te, max(dd) OVER (PARTITION BY strategy ORDER BY date) AS mdd, day(date) = 16 AS reset,
  sum(CASE WHEN day(date) = 16 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy ORDER BY date) AS epoch FROM ev_dd"""

VIEWS["ev_first"] = """
SELECT *, coalesce(te > 0.05, FALSE) AS te_b, mdd > 0.004 AS dd_b,
  min(CASE WHEN te > 0.05 THEN date END) OVER w AS te_first, min(CASE WHEN mdd > 0.004 THEN date END) OVER w AS dd_first
FROM ev_checks WINDOW w AS (PARTITION BY strategy, epoch ORDER BY date)"""

# --- bootstrap ---------------------------------------------------------------------------

VIEWS["ev_numbered"] = """
SELECT strategy, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n, ret, bench_ret FROM fx_returns"""

VIEWS["ev_idx"] = """
SELECT s.strategy, r.r AS resample, b.b * 7 + o.o AS k,
  (((r.r * 1103515245 + b.b * 12345 + 42) % 2147483647) % s.n + o.o) % s.n AS idx
FROM (SELECT DISTINCT strategy, n FROM ev_numbered) s, range(0, 20) r(r), range(0, 100) b(b), range(0, 7) o(o)
WHERE b.b * 7 + o.o < s.n"""

VIEWS["all_cells"] = """
SELECT p.strategy, p.aum, x.regime, p.date, p.ret, p.bench_ret, p.gross_ret
FROM adj_pairs p JOIN (SELECT date, 'all' AS regime FROM rep_returns UNION ALL SELECT date, label FROM regimes WHERE label IS NOT NULL) x ON x.date = p.date"""

for _name, _src, _keys in (("bs", "adj_pairs", "strategy, aum"), ("cmp", "all_cells", "strategy, aum, regime")):
    _on = " AND ".join(f"p.{k.strip()} = s.{k.strip()}" for k in _keys.split(","))
    _sk = ", ".join(f"s.{k.strip()}" for k in _keys.split(","))
    VIEWS[f"{_name}_num"] = f"""
SELECT {_keys}, row_number() OVER (PARTITION BY {_keys} ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY {_keys}) AS n, ret, bench_ret, date FROM {_src}"""
    VIEWS[f"{_name}_rows"] = f"""
SELECT {_sk}, r.r AS resample, b.b * 6 + o.o AS k, p.ret, p.bench_ret
FROM (SELECT DISTINCT {_keys}, n FROM {_name}_num WHERE n >= 6) s, range(0, 2000) r(r), range(0, 100) b(b), range(0, 6) o(o), {_name}_num p
WHERE b.b * 6 + o.o < s.n AND {_on}
  AND p.i = (((r.r * 1103515245 + b.b * 12345 + 42) % 2147483647) % s.n + o.o) % s.n"""
    VIEWS[f"{_name}_path"] = f"""
SELECT {_keys}, resample, ret, bench_ret, v, 1 - v / greatest(1, max(v) OVER (PARTITION BY {_keys}, resample ORDER BY k)) AS dd FROM (
  SELECT *, product(1 + ret) OVER (PARTITION BY {_keys}, resample ORDER BY k) AS v FROM {_name}_rows) q"""
    VIEWS[f"{_name}_metrics"] = f"""
SELECT {_keys}, resample, pow(product(1 + ret), 12.0 / (count(*) + 1)) - 1 AS cagr, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) AS sharpe_ratio,
  avg(ret) / nullif(stddev_samp(ret) FILTER (WHERE ret < 0), 0) * sqrt(12) AS sortino_ratio, max(dd) AS max_drawdown,
  avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, stddev_samp(ret - bench_ret) * sqrt(12) AS tracking_error FROM {_name}_path GROUP BY {_keys}, resample"""
    VIEWS[f"{_name}_pathpoint"] = f"""
SELECT {_keys}, ret, bench_ret, 1 - v / greatest(1, max(v) OVER (PARTITION BY {_keys} ORDER BY date)) AS dd FROM (
  SELECT *, product(1 + ret) OVER (PARTITION BY {_keys} ORDER BY date) AS v FROM {_name}_num) q"""
    VIEWS[f"{_name}_point"] = f"""
SELECT {_keys}, pow(product(1 + ret), 12.0 / (count(*) + 1)) - 1 AS cagr, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) AS sharpe_ratio,
  avg(ret) / nullif(stddev_samp(ret) FILTER (WHERE ret < 0), 0) * sqrt(12) AS sortino_ratio, max(dd) AS max_drawdown,
  avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, stddev_samp(ret - bench_ret) * sqrt(12) AS tracking_error FROM {_name}_pathpoint GROUP BY {_keys}"""
    _q = ", ".join(f"quantile_cont({m}, 0.025) AS lo_{m}, quantile_cont({m}, 0.975) AS hi_{m}" for m in
                   ("cagr", "sharpe_ratio", "sortino_ratio", "max_drawdown", "win_rate", "tracking_error"))
    VIEWS[f"{_name}_ci"] = f"SELECT {_keys}, {_q} FROM {_name}_metrics GROUP BY {_keys}"

VIEWS["comparison"] = """
SELECT c.strategy, CASE WHEN c.strategy = 'full_replication' THEN 'benchmark' ELSE 'smart_beta' END AS strategy_family, c.aum, c.regime,
  m.name_count, m.mean_one_way_turnover, c.n_days, c.gross_annualized_return, p.cagr AS cost_adjusted_return,
  i.lo_cagr AS cost_adjusted_return_ci_low, i.hi_cagr AS cost_adjusted_return_ci_high, p.sharpe_ratio AS sharpe,
  i.lo_sharpe_ratio AS sharpe_ci_low, i.hi_sharpe_ratio AS sharpe_ci_high, p.tracking_error,
  i.lo_tracking_error AS tracking_error_ci_low, i.hi_tracking_error AS tracking_error_ci_high
FROM (SELECT strategy, aum, regime, count(*) AS n_days, pow(1 + avg(gross_ret), 12) - 1 AS gross_annualized_return
      FROM all_cells GROUP BY 1, 2, 3 HAVING count(*) >= 6) c
JOIN cmp_point p ON p.strategy = c.strategy AND p.aum = c.aum AND p.regime = c.regime
JOIN cmp_ci i ON i.strategy = c.strategy AND i.aum = c.aum AND i.regime = c.regime
LEFT JOIN metadata m ON m.strategy = c.strategy"""

# --- fits (lookback 12) ------------------------------------------------------------------

VIEWS["hist"] = """
SELECT g.rebalance_date, r.symbol, r.pos - (g.sp - 12) AS t, r.ret FROM seg g
JOIN rets r ON r.pos BETWEEN g.sp - 12 AND g.sp - 1
JOIN members m ON m.rebalance_date = g.rebalance_date AND m.symbol = r.symbol WHERE g.sp >= 12"""

VIEWS["complete"] = "SELECT rebalance_date, symbol FROM hist GROUP BY 1, 2 HAVING count(*) = 12"

VIEWS["hist_ok"] = "SELECT h.* FROM hist h JOIN complete c ON c.rebalance_date = h.rebalance_date AND c.symbol = h.symbol"

VIEWS["bench_past"] = """
SELECT g.rebalance_date, c.pos - (g.sp - 12) AS t, b.ret FROM seg_held g JOIN cal c ON c.pos BETWEEN g.sp - 12 AND g.sp - 1
LEFT JOIN rep_returns b ON b.pos = c.pos WHERE g.sp >= 12"""

VIEWS["bench_ok"] = """
SELECT rebalance_date FROM bench_past GROUP BY 1 HAVING avg(CASE WHEN ret IS NULL THEN 1.0 ELSE 0.0 END) <= 0.2
INTERSECT SELECT g.rebalance_date FROM seg_held g JOIN rep_returns b ON b.pos > g.sp AND b.pos <= g.ep GROUP BY 1 HAVING count(*) >= 2"""

VIEWS["centred"] = """
SELECT rebalance_date, symbol, t, ret - avg(ret) OVER (PARTITION BY rebalance_date, symbol) AS x FROM hist_ok"""

VIEWS["cov"] = """
SELECT a.rebalance_date, a.symbol AS i, b.symbol AS j, sum(a.x * b.x) / 12 AS s, sum(a.x * a.x * b.x * b.x) / 12 AS e
FROM centred a JOIN centred b ON a.rebalance_date = b.rebalance_date AND a.t = b.t GROUP BY 1, 2, 3"""

VIEWS["lw"] = """
SELECT rebalance_date, count(DISTINCT i) AS p, sum(s) FILTER (WHERE i = j) AS tr, sum(s * s) AS s2, sum(e) AS e2 FROM cov GROUP BY 1"""

VIEWS["lw_terms"] = """
SELECT rebalance_date, CAST(12 AS BIGINT) AS n, p, tr / p AS mu, (s2 - 2 * tr / p * tr + p * (tr / p) * (tr / p)) / p AS delta,
  least((e2 - s2) / (p * 12), (s2 - 2 * tr / p * tr + p * (tr / p) * (tr / p)) / p) AS beta FROM lw"""

# --- turnover frontier ---------------------------------------------------------------------

VIEWS["fr_dates"] = "SELECT max(rebalance_date) AS t_curr, max(rebalance_date) FILTER (WHERE rebalance_date < (SELECT max(rebalance_date) FROM w_tilt)) AS t_prev FROM w_tilt"
VIEWS["fr_names"] = """
SELECT c.rebalance_date, c.symbol, k.composite AS f, coalesce(w.weight, 0) AS q
FROM fr_dates d JOIN complete c ON c.rebalance_date = d.t_curr JOIN composite k ON k.rebalance_date = c.rebalance_date AND k.symbol = c.symbol
LEFT JOIN w_tilt w ON w.rebalance_date = d.t_prev AND w.symbol = c.symbol"""
VIEWS["fr_floors"] = """
SELECT rebalance_date, 'unconstrained' AS target_name, -10.0::DOUBLE AS factor_target FROM fr_dates, (SELECT DISTINCT rebalance_date FROM fr_names) q
UNION ALL SELECT rebalance_date, 'median', quantile_cont(f, 0.5) FROM fr_names GROUP BY 1
UNION ALL SELECT rebalance_date, 'p75', quantile_cont(f, 0.75) FROM fr_names GROUP BY 1"""
VIEWS["fr_knap"] = """
SELECT *, greatest(0, least(1, 1 - filled)) AS best FROM (
  SELECT *, 1 - q AS room, row_number() OVER (ORDER BY f DESC, symbol) - 1 AS filled,
    coalesce(sum(1 - q) OVER (ORDER BY f DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bought,
    coalesce(sum(q) OVER (ORDER BY f, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sold FROM fr_names) t"""
VIEWS["fr_points"] = """
SELECT p.*, budget >= abs(1 - own) - 1e-9 AS within_budget, least((budget + 1 - own) / 2, enough) AS buy, 1 - own AS lack, held, n
FROM (SELECT f.*, unnest([0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0]::DOUBLE[]) AS budget FROM fr_floors f) p,
  (SELECT sum(q) AS own, sum(f * q) AS held, sum(greatest(best - q, 0)) AS enough, count(*) AS n FROM fr_knap) t"""
VIEWS["fr_reach"] = """
SELECT p.rebalance_date, p.target_name, p.factor_target, p.budget, p.n, p.within_budget,
  p.held + sum(k.f * (greatest(0, least(p.buy - k.bought, k.room)) - greatest(0, least(p.buy - p.lack - k.sold, k.q)))) AS exposure
FROM fr_points p CROSS JOIN fr_knap k GROUP BY p.rebalance_date, p.target_name, p.factor_target, p.budget, p.n, p.within_budget, p.held"""
