import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import bootstrap as BS, comparison as Q, costs as K, factors as X, regime as R, risk as L, stats as G
from basketry.sources import cleaning, results
from tests.helpers import as_dict, days, series


def test_turnover_and_holdings(spark):
    d = days(2)
    w = spark.createDataFrame(
        [("s", d[0], "A", 0.5), ("s", d[0], "B", 0.5), ("s", d[1], "A", 0.25), ("s", d[1], "C", 0.75)],
        "strategy STRING, rebalance_date DATE, symbol STRING, weight DOUBLE",
    )
    out = as_dict(K.turnover(K.weight_changes(w, 10)), "strategy", "rebalance_date")
    assert out[("s", d[1])] == (2, pytest.approx(1.5), pytest.approx(0.75))
    assert out[("s", d[0])][1] == pytest.approx(1.0)
    meta = K.portfolio_metadata(K.turnover(K.weight_changes(w, 10))).first()
    assert meta.name_count == 2.0 and meta.mean_one_way_turnover == pytest.approx(0.75)


def test_cost_fraction_grows_with_root_of_size(spark):
    d = days(1)
    changes = spark.createDataFrame([("s", d[0], "A", 0.6, 0.6), ("s", d[0], "B", 0.4, 0.4), ("s", d[0], "Z", 0.1, 0.1)], "strategy STRING, rebalance_date DATE, symbol STRING, weight DOUBLE, dw DOUBLE")
    liquid = spark.createDataFrame([("A", 0.2, 5e6), ("B", 0.2, 5e6), ("Z", None, 5e6)], "symbol STRING, vol DOUBLE, adv DOUBLE")
    out = {r.aum: r for r in K.trade_costs(changes, liquid, [1e6, 1e8]).collect()}
    assert out[1e8].cost_fraction == pytest.approx(10 * out[1e6].cost_fraction)
    want = sum(w * 0.2 * math.sqrt(w * 1e6 / 5e6) for w in (0.6, 0.4))
    assert out[1e6].cost_fraction == pytest.approx(want)
    assert (out[1e6].n_priced, out[1e6].n_excluded) == (2, 1)


def test_costs_hit_first_later_return_day(spark):
    d = days(6)
    r = series(spark, {"s": [(x, i, 0.01) for i, x in enumerate(d[2:5])]}, "date DATE, pos INT, ret DOUBLE")
    costs = spark.createDataFrame([("s", d[0], 1e6, 0.002), ("s", d[1], 1e6, 0.003), ("s", d[5], 1e6, 0.5)], "strategy STRING, rebalance_date DATE, aum DOUBLE, cost_fraction DOUBLE")
    got = as_dict(K.apply_costs(r, costs).select("date", "ret"), "date")
    assert got == {d[2]: pytest.approx(0.005), d[3]: pytest.approx(0.01), d[4]: pytest.approx(0.01)}


def test_performance_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0.0005, 0.01, 300)
    d = days(300)
    got = G.performance(series(spark, {"s": [(a, float(b)) for a, b in zip(d, x)]})).first()
    curve = np.concatenate([[1.0], np.cumprod(1 + x)])
    assert got.cagr == pytest.approx(curve[-1] ** (252 / 301) - 1)
    assert got.sharpe_ratio == pytest.approx(x.mean() / x.std(ddof=1) * 252 ** 0.5)
    assert got.sortino_ratio == pytest.approx(x.mean() / x[x < 0].std(ddof=1) * 252 ** 0.5)
    assert got.max_drawdown == pytest.approx((1 - curve / np.maximum.accumulate(curve)).max())
    assert got.win_rate == pytest.approx((x > 0).mean())


def test_flat_returns_have_no_sharpe(spark):
    got = G.performance(series(spark, {"s": [(a, 0.0) for a in days(10)]})).first()
    assert got.sharpe_ratio is None and got.sortino_ratio is None and got.max_drawdown == 0.0


def test_tracking_error_needs_two_pairs(spark):
    d = days(4)
    own = series(spark, {"s": [(d[0], 0.01), (d[1], None), (d[2], 0.03), (d[3], 0.0)], "t": [(d[0], 0.01)]})
    bench = spark.createDataFrame([(d[0], 0.0), (d[1], 0.0), (d[2], 0.01), (d[3], None)], "date DATE, ret DOUBLE")
    got = as_dict(G.tracking_error(G.align(own, bench)), "strategy")
    assert got["s"] == pytest.approx(np.std([0.01, 0.02], ddof=1) * 252 ** 0.5) and got["t"] is None


def test_attribution_reconciles_and_reports_excluded(spark):
    w = "symbol STRING, weight DOUBLE"
    p = spark.createDataFrame([("A", 0.5), ("B", 0.3), ("C", 0.1), ("Q", 0.1)], w)
    b = spark.createDataFrame([("A", 0.2), ("B", 0.3), ("C", 0.3), ("D", 0.2)], w)
    r = spark.createDataFrame([("A", 0.1), ("B", -0.05), ("C", 0.02), ("D", 0.2), ("Q", 0.3)], "symbol STRING, ret DOUBLE")
    s = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y"), ("D", "y")], "symbol STRING, gics_sector STRING")
    total = L.attribution_totals(L.attribution_by_sector(p, b, r, s)).first()
    assert total.reconciles
    assert total.portfolio_return == pytest.approx((0.5 * 0.1 - 0.3 * 0.05 + 0.1 * 0.02) / 0.9)
    assert [tuple(x) for x in L.attribution_excluded(p, b, r, s).collect()] == [("Q", 0.1)]


def _pairs(spark, rets):
    return series(spark, {"s": [(a, r, 0.0) for a, r in zip(days(len(rets)), rets)]}, "date DATE, ret DOUBLE, bench_ret DOUBLE")


def test_drawdown_limit_remembers_recovery_and_first_day(spark):
    recovered = L.limit_checks(_pairs(spark, [0.0, -0.12, 0.15, 0.0]), te_limit=99).first()
    assert recovered.drawdown_breached and recovered.trigger_reasons == ["relative_drawdown"]
    first = L.limit_checks(_pairs(spark, [-0.11, 0.0, 0.0, 0.0]), te_limit=99).first()
    assert first.drawdown_breached and first.max_relative_drawdown == pytest.approx(0.11)
    calm = L.limit_checks(_pairs(spark, [0.001, 0.0, 0.0, 0.0]), te_limit=99).first()
    assert not calm.triggered and calm.trigger_reasons == []


def test_limits_are_validated(spark):
    with pytest.raises(ValueError):
        L.limit_checks(_pairs(spark, [0.0]), te_limit=-1)
    with pytest.raises(ValueError):
        L.limit_checks(_pairs(spark, [0.0]), drawdown_limit=1.0)
    with pytest.raises(Exception, match="-100 %"):
        L.limit_checks(_pairs(spark, [-1.0, 0.0])).collect()


def test_switch_is_sticky_until_reset(spark):
    d = days(5)
    checks = series(spark, {"s": [(d[0], False, True, False), (d[1], True, False, False), (d[2], False, False, False), (d[3], False, False, True), (d[4], True, False, False)]},
                    "date DATE, te_breached BOOLEAN, drawdown_breached BOOLEAN, reset BOOLEAN")
    got = [(r.triggered, r.reasons) for r in L.sticky_switch(checks, reset="reset").orderBy("date").collect()]
    both = "relative_drawdown,tracking_error"
    assert got == [(True, "relative_drawdown"), (True, both), (True, both), (False, ""), (True, "tracking_error")]


def test_regime_stats_skip_short_regimes(spark):
    d = days(40)
    r = series(spark, {"s": [(x, 0.001 * (i % 3)) for i, x in enumerate(d)]})
    labels = spark.createDataFrame([(x, "calm" if i < 33 else "volatile" if i < 38 else None) for i, x in enumerate(d)], "date DATE, label STRING")
    assert [x.regime for x in R.conditional_stats(r, labels).collect()] == ["calm"]
    note = R.skipped_regimes(r, labels).first()
    assert note.n_days == 5 and "too few" in note.note


def test_quality_ignores_missing_fields(spark):
    f = spark.createDataFrame([("A", 0.1, 0.2, 10.0), ("B", 0.2, 0.1, None), ("C", 0.3, 0.3, 30.0)], "symbol STRING, returnOnEquity DOUBLE, profitMargins DOUBLE, debtToEquity DOUBLE")
    got = as_dict(X.quality_scores(f), "symbol")
    z = lambda v: (np.array(v) - np.mean(v)) / np.std(v)
    roe, margin, debt = z([0.1, 0.2, 0.3]), z([0.2, 0.1, 0.3]), -z([10.0, 30.0])
    assert got["A"] == pytest.approx((roe[0] + margin[0] + debt[0]) / 3)
    assert got["B"] == pytest.approx((roe[1] + margin[1]) / 2)


def test_bootstrap_keeps_pairing_and_autocorrelation(spark):
    rng = np.random.default_rng(2)
    x = [0.0]
    for e in rng.normal(0, 0.01, 1500):
        x.append(0.7 * x[-1] + e)
    d = days(len(x))
    p = series(spark, {"s": [(a, float(b), float(10 * b)) for a, b in zip(d, x)]}, "date DATE, ret DOUBLE, bench_ret DOUBLE")
    rows = BS.resample_rows(p, ["strategy"], 20, 4).toPandas().sort_values(["resample", "k"])
    assert np.allclose(rows.bench_ret, 10 * rows.ret)
    assert (rows.groupby("resample").size() == len(x)).all()
    kept = rows.groupby("resample").ret.apply(lambda v: v.autocorr(1)).mean()
    naive = BS.resample_rows(p, ["strategy"], 1, 4).toPandas().sort_values(["resample", "k"])
    lost = naive.groupby("resample").ret.apply(lambda v: v.autocorr(1)).mean()
    assert kept > 0.55 and abs(lost) < 0.1


def test_bootstrap_interval_covers_point_and_rejects_short(spark):
    rng = np.random.default_rng(7)
    p = series(spark, {"s": [(a, float(b), 0.0) for a, b in zip(days(250), rng.normal(0.0005, 0.01, 250))]}, "date DATE, ret DOUBLE, bench_ret DOUBLE")
    out = {r.metric: r for r in BS.bootstrap_metrics(p, ["strategy"], 10, 120).collect()}
    assert set(out) == set(BS.METRICS)
    for m in ("cagr", "sharpe_ratio", "tracking_error", "win_rate"):
        assert out[m].ci_low <= out[m].point_estimate <= out[m].ci_high
    with pytest.raises(Exception, match="does not fit"):
        BS.bootstrap_metrics(p, ["strategy"], 300, 5).collect()


def test_findings_text(spark):
    cols = "strategy STRING, strategy_family STRING, aum DOUBLE, regime STRING, cost_adjusted_return DOUBLE"
    table = spark.createDataFrame([
        ("full_replication", "benchmark", 1e7, "all", 0.10), ("quality", "smart_beta", 1e7, "all", 0.13), ("min_vol", "smart_beta", 1e7, "all", 0.05),
        ("full_replication", "benchmark", 1e7, "volatile", 0.10), ("min_vol", "smart_beta", 1e7, "volatile", 0.02),
    ], cols)
    curve = spark.createDataFrame([("lasso", 30, 0.12), ("optimization", 30, 0.03)], "method STRING, target_n INT, mean_tracking_error DOUBLE")
    got = [r.text for r in Q.findings(table, curve).orderBy("seq").collect()]
    assert got[0] == "At $10,000,000 AUM, quality beat full replication after costs (+3.00% annualized difference)."
    assert "underperformed full replication by -8.00%" in got[1]
    assert got[2].startswith("At target 30 names, optimization had the lowest") and "+9.00%" in got[2]


def test_change_log_needs_a_reason_column(spark):
    five = spark.createDataFrame([("a", "b", "c", "d", "e")], "c0 STRING, c1 STRING, c2 STRING, c3 STRING, c4 STRING")
    with pytest.raises(ValueError):
        cleaning.clean_changes(five)
    seven = spark.createDataFrame([("2024-01-02", "A.B", "x", None, None, " one ", "two"), ("soon", "C", "x", None, None, "r", None)],
                                  "c0 STRING, c1 STRING, c2 STRING, c3 STRING, c4 STRING, c5 STRING, c6 STRING")
    row = cleaning.clean_changes(seven).collect()
    assert len(row) == 1 and row[0].reason == "one two" and row[0].added_feed == "A-B" and row[0].effective_date == dt.date(2024, 1, 2)


def test_absent_results_are_an_error_row(spark, tmp_path):
    out = results.read_results(spark, str(tmp_path / "none"))
    assert "not found" in out["comparison"].first().error


def test_a_failed_write_leaves_the_earlier_results(spark, tmp_path):
    path = str(tmp_path / "set")
    table = lambda x: spark.createDataFrame([("s", 1e6, x), ("t", 1e7, x)], "strategy STRING, aum DOUBLE, value DOUBLE")
    said = lambda *lines: spark.createDataFrame(list(enumerate(lines)), "seq INT, text STRING")
    assert results.write_results(path, table(1.0), table(1.5), said("one", "two"), {"flat": table(1.0)}) == 1
    broken = said("three").withColumn("text", F.expr("raise_error('stopped')"))
    with pytest.raises(Exception, match="stopped"):
        results.write_results(path, table(2.0), table(2.5), broken)
    got = results.read_results(spark, path)
    assert {r.value for r in got["comparison"].collect()} == {1.0} and {r.value for r in got["sampling"].collect()} == {1.5}
    assert [r.text for r in got["findings"].collect()] == ["one", "two"] and results.read_csv(spark, path, "flat").count() == 2
    assert results.write_results(path, table(3.0), None, said("four")) == 2
    got = results.read_results(spark, path)
    assert {r.value for r in got["comparison"].collect()} == {3.0} and "not found" in got["sampling"].first().error
    results.prune(spark, path, keep=1)
    assert {r.value for r in results.read_results(spark, path)["comparison"].collect()} == {3.0} and results.published(spark, path).count() == 2
    assert "not found" in results.read_csv(spark, str(tmp_path / "no"), "flat").first().error


def test_forward_window_prices_do_not_change_past_coefficients(spark):
    from tests.helpers import numbered

    rng = np.random.default_rng(0)
    d = days(60)
    walk = {f"S{i}": (np.cumprod(1 + rng.normal(0, 0.02, 60)) * 10).tolist() for i in range(12)}
    moved = {k: v[:40] + [p * 5 for p in v[40:]] for k, v in walk.items()}
    seen = []
    for closes in (walk, moved):
        prices, cal = numbered(spark, d, closes)
        pairs = X.pair_with_forward(X.stack_scores({"m": X.momentum_scores(prices, cal, 10, 2)}), {}, X.forward_returns(prices, 3))
        seen.append(as_dict(X.information_coefficients(pairs, 10, 12).where("pos < 37").select("pos", "ic"), "pos"))
    assert seen[0] == pytest.approx(seen[1]) and len(seen[0]) > 10
