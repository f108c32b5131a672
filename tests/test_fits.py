import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import fits, kernels
from basketry.plans import studies
from basketry.sizing import Schedule

DAY = dt.date(2020, 3, 20)


def _fit(x, b, upper=1.0, f=None, q=None, proven=False, **limits):
    scale = np.sqrt((x ** 2).sum(1).mean())
    zero = np.zeros(len(x))
    spec = kernels.Spec(b / scale, len(x), upper=upper, **limits)
    return kernels.fit_in_task(x / scale, zero if f is None else f, zero if q is None else q, spec, proven)


@pytest.mark.parametrize("names,days,upper", [(2, 60, 1.0), (5, 100, 1.0), (20, 200, 0.2), (60, 40, 0.05), (10, 300, 0.15)])
def test_tracking_fit_is_optimal(names, days, upper):
    rng = np.random.default_rng(names)
    x = rng.normal(0, 0.01, (names, days))
    b = x.T @ rng.dirichlet(np.ones(names)) + rng.normal(0, 0.002, days)
    w = _fit(x, b, upper)
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= upper + 1e-9
    g = x @ (x.T @ w - b)
    assert g[w > 1e-9].max() <= g[w < upper - 1e-9].min() + 1e-7 * np.abs(g).max()


@pytest.mark.parametrize("distinct,seed", [(20, 71), (25, 118)])
def test_tracking_fit_of_copied_names_settles(distinct, seed):
    """Equal names leave their bounds together, which bends the dual too sharply for a step search of few trials."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.15, (distinct, 12))
    x = x[np.concatenate([np.arange(distinct), rng.integers(0, distinct, 30 - distinct)])]
    b = rng.normal(0, 0.02, 12)
    w = _fit(x, b, proven=True)
    g = x @ (x.T @ w - b)
    assert w.sum() == pytest.approx(1) and g[w > 1e-9].max() <= g.min() + 1e-7 * np.abs(g).max()


def test_nearly_flat_direction_is_followed_to_its_end():
    """With equal proximal weights each step would move by the same little amount, and 60 of them end nowhere."""
    x = np.array([[1.0, 0.0], [1.0, 3e-4]])
    spec = kernels.Spec(np.array([1.0, 3e-5]), 2)
    w = kernels.fit_in_task(x, np.zeros(2), np.zeros(2), spec, proven=True)
    assert w == pytest.approx([0.9, 0.1], abs=1e-5)


def test_tracking_fit_recovers_known_portfolio():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.01, (5, 100))
    true = np.array([0.4, 0.3, 0.2, 0.1, 0.0])
    assert np.allclose(_fit(x, x.T @ true), true, atol=1e-6)


def test_wider_budget_never_tracks_worse_and_limits_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.01, (15, 200))
    b = x.mean(0) + rng.normal(0, 0.001, 200)
    f, q = rng.normal(size=15), np.full(15, 1 / 15)
    previous = np.inf
    for budget in (0.05, 0.1, 0.3, 0.6, 1.0, 2.0):
        w = _fit(x, b, f=f, q=q, budget=budget, target=-10.0)
        assert np.abs(w - q).sum() <= budget + 1e-6
        miss = ((x.T @ w - b) ** 2).sum()
        assert miss <= previous * (1 + 1e-9)
        previous = miss
    w = _fit(x, b, upper=0.2, f=f, q=q, budget=1.0, target=0.3)
    assert f @ w >= 0.3 - 1e-6 and w.max() <= 0.2 + 1e-9
    assert _fit(x, b, f=f, q=q, budget=0.01, target=f.max()) is None
    assert _fit(x, b, upper=0.05) is None


def test_lasso_path_is_optimal_at_every_penalty():
    rng = np.random.default_rng(4)
    for names, days in ((5, 100), (60, 40), (40, 200)):
        x = rng.normal(0, 0.01, (names, days))
        y = x.mean(0) + rng.normal(0, 0.002, days)
        top = np.abs(x @ y).max() / days
        alphas, w = kernels.lasso_path(x, y, 150, 1e-4, top)
        for k in range(150):
            c = x @ (y - w[k] @ x) / days
            assert c.max() <= alphas[k] + 1e-9 * top
            assert np.allclose(c[w[k] > 0], alphas[k], atol=1e-9 * top)


def _names(spark, x):
    rows = [(DAY, f"N{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "rebalance_date DATE, symbol STRING, x ARRAY<DOUBLE>")


def _bench(spark, b):
    return spark.createDataFrame([(DAY, [None if v is None else float(v) for v in b])], "rebalance_date DATE, b ARRAY<DOUBLE>")


def test_shrinkage_matches_direct_formula(spark):
    x = np.random.default_rng(1).normal(0, 0.01, (7, 20))
    got = fits.shrinkage(_names(spark, x), 20).first()
    c = x - x.mean(1, keepdims=True)
    n, p = 20, 7
    s = c @ c.T / n
    mu = np.trace(s) / p
    delta = ((s ** 2).sum() - 2 * mu * np.trace(s) + p * mu ** 2) / p
    beta = min(((c ** 2) @ (c ** 2).T / n - s ** 2).sum() / (p * n), delta)
    assert (got.mu, got.delta, got.beta, got.shrinkage) == pytest.approx((mu, delta, beta, beta / delta))


def test_distributed_fits_equal_in_task_fits(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 0.01, (40, 12))
    b = list(x.mean(0) + rng.normal(0, 0.002, 12))
    b[3] = None  # a day without a benchmark return drops out for everyone
    names, bench, sched = _names(spark, x), _bench(spark, b), Schedule(None, 1)
    shrunk = fits.shrinkage(names, 12)
    problem = fits.minimum_variance_problems(names, shrunk, 0.06, 12, sched)
    read = lambda df: {(*[r[c] for c in df.columns if c not in ("symbol", "weight")], r.symbol): r.weight for r in df.collect()}
    inside = read(fits.solve_quadratic(*problem, 40, 12))
    assert len(inside) == 40 and max(inside.values()) <= 0.06 + 1e-9
    assert inside == pytest.approx(read(fits.solve_quadratic(*problem, None, 12)), abs=1e-8)

    ones = read(fits.solve_lasso(names, bench, [3, 6], 40, 12, sched))
    many = read(fits.solve_lasso(names, bench, [3, 6], None, 12, sched))
    assert ones == pytest.approx(many, abs=1e-8)
    assert sum(v for k, v in ones.items() if k[1] == 3) == pytest.approx(1)


def test_turnover_fit_in_both_ways(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 0.01, (20, 15))
    names, bench = _names(spark, x), _bench(spark, x.mean(0))
    f, q = rng.normal(size=20), rng.dirichlet(np.ones(20))
    table = lambda v, c: spark.createDataFrame([(DAY, f"N{i:03d}", float(z)) for i, z in enumerate(v)], f"rebalance_date DATE, symbol STRING, {c} DOUBLE")
    goals = spark.createDataFrame([(DAY, -10.0), (DAY, float(np.median(f)))], "rebalance_date DATE, factor_target DOUBLE")
    problem = fits.turnover_problems(names, bench, table(q, "weight"), table(f, "composite"), goals, [0.2, 1.0], Schedule(None, 1))
    a = {tuple(r)[:4]: r.weight for r in fits.solve_quadratic(*problem, 20, 15).collect()}
    b = {tuple(r)[:4]: r.weight for r in fits.solve_quadratic(*problem, None, 15).collect()}
    assert len(a) == 80 and a == pytest.approx(b, abs=1e-6)


def test_infeasible_cap_raises_or_skips(spark):
    x = np.random.default_rng(2).normal(0, 0.01, (3, 12))
    names = _names(spark, x)
    problem = fits.minimum_variance_problems(names, fits.shrinkage(names, 12), 0.2, 12, Schedule(None, 1))
    assert fits.solve_quadratic(*problem, 3, 12).count() == 0
    with pytest.raises(Exception, match="infeasible"):
        fits.solve_quadratic(*problem, 3, 12, infeasible="error").count()


def _dual_bound(f, q, u, budget):
    """Greatest exposure by duality: the least dual value over all pairs of marginal names (exact, as a best pair is among them)."""
    own, best = np.minimum(q, u), np.inf
    for a in f:
        for b in f[f <= a]:
            level, trade = (a + b) / 2, (a - b) / 2
            z = np.stack([np.zeros(len(f)), own, np.full(len(f), u)])
            best = min(best, level + trade * budget + ((f - level) * z - trade * np.abs(z - q)).max(axis=0).sum())
    return best


@pytest.mark.parametrize("task_rows", [1_000_000, 1])
def test_greatest_exposure_is_exact(spark, task_rows):
    rng = np.random.default_rng(5)
    names, specs, want = [], [], {}
    for k in range(12):
        day = DAY + dt.timedelta(days=k)
        n, u = int(rng.integers(3, 9)), float(rng.choice([1.0, 0.5, 0.4]))
        f = np.round(rng.normal(size=n), 1)  # ties
        q = rng.dirichlet(np.ones(n)) * rng.choice([1.0, 0.7])
        names += [(day, f"N{i}", float(f[i]), float(q[i])) for i in range(n)]
        for budget in (0.1, 0.35, 0.8, 2.0):
            specs.append((day, budget, u, n, -10.0, [0.0, 0.0]))
            lack, left = 1 - np.minimum(q, u).sum(), budget - np.maximum(q - u, 0).sum()
            want[day, budget] = (left >= abs(lack) - 1e-9, _dual_bound(f, q, u, budget))
    nf = spark.createDataFrame(names, "rebalance_date DATE, symbol STRING, f DOUBLE, q DOUBLE")
    sf = spark.createDataFrame(specs, "rebalance_date DATE, budget DOUBLE, upper DOUBLE, n_names INT, target DOUBLE, b ARRAY<DOUBLE>").withColumn("turnover_budget", F.col("budget"))
    got = fits.greatest_exposure(nf, sf, ["rebalance_date", "turnover_budget"], 9, task_rows).collect()
    assert len(got) == 48 and {r.within_budget for r in got} == {True, False}
    for r in got:
        ok, best = want[r.rebalance_date, r.turnover_budget]
        assert r.within_budget == ok
        if ok:
            assert r.exposure == pytest.approx(best, abs=1e-9)


def test_certificate_tells_a_worse_portfolio(spark):
    rng = np.random.default_rng(13)
    n, days = 15, 30
    x, f, q = rng.normal(0, 0.01, (n, days)), rng.normal(size=n), rng.dirichlet(np.ones(n))
    b = x.T @ rng.dirichlet(np.ones(n))
    table = lambda v, c: spark.createDataFrame([(DAY, f"N{i:03d}", float(z)) for i, z in enumerate(v)], f"rebalance_date DATE, symbol STRING, {c} DOUBLE")
    goals = spark.createDataFrame([(DAY, "none", -10.0), (DAY, "high", float(np.quantile(f, 0.7))), (DAY, "beyond", float(f.max()) + 1)], "rebalance_date DATE, target_name STRING, factor_target DOUBLE")
    names, bench, exposure = _names(spark, x), _bench(spark, b), table(f, "composite")
    problem = fits.turnover_problems(names, bench, table(q, "weight"), exposure, goals, [0.2, 0.6, 2.0], Schedule(None, 1))
    fr = studies.Frontier(*problem, table(q, "weight"), exposure, names, bench)
    status = {(r.target_name, r.turnover_budget): r.status for r in fits.fit_status(*problem, n).collect()}
    assert len(status) == 9 and all(v == "infeasible" for k, v in status.items() if k[0] == "beyond")
    w = fits.solve_quadratic(*problem, n, days, multipliers=True).persist()
    good = studies.certified(w, fr).collect()
    assert {(r.target_name, r.turnover_budget) for r in good} == {k for k, v in status.items() if v == "solved"} and len(good) >= 5
    assert all(r.is_optimal and r.sums_to_one and r.within_bounds and r.meets_floor and r.within_budget and r.n_candidates == n for r in good)
    # A portfolio that is half the one held before meets every limit but the floor, and is never the best.
    held = spark.createDataFrame([(f"N{i:03d}", float(v)) for i, v in enumerate(q)], "symbol STRING, q DOUBLE")
    mixed = w.join(held, "symbol").withColumn("weight", (F.col("weight") + F.col("q")) / 2).drop("q")
    assert not any(r.is_optimal for r in studies.certified(mixed, fr).collect() if r.turnover_budget < 2)
    # Wrong multipliers prove nothing.
    wrong = w.withColumn("turnover_multiplier", F.col("turnover_multiplier") + 1.0)
    assert not any(r.is_optimal for r in studies.certified(wrong, fr).collect() if r.turnover_budget == 2.0)
    w.unpersist()
    outside = {tuple(r)[:5]: r for r in fits.solve_quadratic(*problem, None, days, multipliers=True).collect()}
    inside = {tuple(r)[:5]: r for r in fits.solve_quadratic(*problem, n, days, multipliers=True).collect()}
    assert outside.keys() == inside.keys()
    assert all(outside[k].weight == pytest.approx(inside[k].weight, abs=1e-6) for k in inside)


def test_certificate_counts_a_last_digit_of_a_multiplier_once(spark):
    rng = np.random.default_rng(13)
    copies, days = 60, 12
    n = 10 * copies
    x, f, q = np.repeat(rng.normal(0, 0.01, (10, days)), copies, 0), np.repeat(rng.normal(size=10), copies), np.full(n, 1 / n)
    b = x.T @ np.repeat(rng.dirichlet(np.ones(10)), copies) / copies
    table = lambda v, c: spark.createDataFrame([(DAY, f"N{i:03d}", float(z)) for i, z in enumerate(v)], f"rebalance_date DATE, symbol STRING, {c} DOUBLE")
    goals = spark.createDataFrame([(DAY, -10.0)], "rebalance_date DATE, factor_target DOUBLE")
    names, bench, exposure = _names(spark, x), _bench(spark, b), table(f, "composite")
    problem = fits.turnover_problems(names, bench, table(q, "weight"), exposure, goals, [0.3, 2.0], Schedule(None, 1))
    fr = studies.Frontier(*problem, table(q, "weight"), exposure, names, bench)
    w = fits.solve_quadratic(*problem, n, days, multipliers=True).persist()
    off = lambda by: [r.is_optimal for r in studies.certified(w.withColumn("sum_multiplier", F.col("sum_multiplier") + by), fr).collect()]
    assert off(0.0) == off(1e-8) == [True, True]
    assert off(-1e-2) == [False, False]
    w.unpersist()


def test_sparse_paths_certificate_and_picks(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(0, 0.01, (30, 14))
    b = list(x[:5].mean(0) + rng.normal(0, 0.002, 14))
    b[2] = None
    names, bench, sched = _names(spark, x), _bench(spark, b), Schedule(None, 1)
    paths = fits.lasso_paths(names, bench, 30, 14, sched).persist()
    wide = {(r.k, r.symbol): r.coefficient for r in fits.lasso_paths(names, bench, None, 14, sched).collect()}
    assert {(r.k, r.symbol): r.coefficient for r in paths.collect()} == pytest.approx(wide, abs=1e-8)
    good = studies.sparse_path_certificate(paths, names, bench).collect()
    assert len(good) == 150 and all(r.is_stationary and r.gap_is_closed and r.n_candidates == 30 for r in good)
    assert good and {r.k: r.n_held for r in good}[0] == 0  # nothing is held at the greatest penalty
    off = paths.withColumn("coefficient", F.col("coefficient") * 1.01)
    bad = [r for r in studies.sparse_path_certificate(off, names, bench).collect() if r.n_held > 0]
    assert not any(r.is_stationary and r.gap_is_closed for r in bad)
    dropped = paths.where("NOT symbol <=> 'N000' OR k < 20")
    assert not all(r.is_stationary for r in studies.sparse_path_certificate(dropped, names, bench).collect())
    # What the sampling fit takes is the penalty whose support is nearest the target, the first on a tie.
    support = {r.k: r.n_held for r in good}
    for target in (3, 6, 12):
        k = min(support, key=lambda i: (abs(support[i] - target), i))
        held = {r.symbol: r.coefficient for r in paths.where(F.col("k") == k).collect()}
        total = sum(held.values())
        got = {r.symbol: r.weight for r in fits.solve_lasso(names, bench, [target], 30, 14, sched).collect()}
        assert got == pytest.approx({s: c / total for s, c in held.items()}, abs=1e-12)
    paths.unpersist()


def test_a_grid_in_one_group_equals_its_points_solved_alone(spark):
    rng = np.random.default_rng(17)
    n, days = 25, 16  # more names than days: the best portfolio is not unique
    x, f, q = rng.normal(0, 0.01, (n, days)), rng.normal(size=n), rng.dirichlet(np.ones(n))
    b = x.T @ rng.dirichlet(np.ones(n)) + rng.normal(0, 0.003, days)
    table = lambda v, c: spark.createDataFrame([(DAY, f"N{i:03d}", float(z)) for i, z in enumerate(v)], f"rebalance_date DATE, symbol STRING, {c} DOUBLE")
    floors, budgets = (-10.0, float(np.median(f)), float(np.quantile(f, 0.7))), (0.1, 0.3, 0.6, 1.2, 2.0)
    goals = spark.createDataFrame([(DAY, v) for v in floors], "rebalance_date DATE, factor_target DOUBLE")
    problem = fits.turnover_problems(_names(spark, x), _bench(spark, b), table(q, "weight"), table(f, "composite"), goals, budgets, Schedule(None, 1))
    fitted = fits.solve_quadratic(*problem, n, days)
    got = {(r.factor_target, r.turnover_budget, r.symbol): r.weight for r in fitted.collect()}
    solved = {k[:2] for k in got}
    assert len(solved) >= 10
    for floor, budget in solved:
        w = _fit(x, b, f=f, q=q, target=floor, budget=budget)
        assert [got[floor, budget, f"N{i:03d}"] for i in range(n)] == pytest.approx(w.tolist(), abs=1e-8)
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas [rebalance_date" in plan and "turnover_budget" not in plan.split("FlatMapCoGroupsInPandas")[1].split("]")[0]


@pytest.mark.parametrize("noise", [0.0, 1e-14, 1e-10])
def test_lasso_path_of_copied_names_reaches_its_end(noise):
    """Copies of an active name fall with it to the last digit and used to join and leave without end."""
    for seed in range(12):
        rng = np.random.default_rng(seed)
        x = np.repeat(rng.normal(0, 0.15, (200, 12)), 20, 0)
        x, y = x * (1 + noise * rng.normal(size=x.shape)), rng.normal(0, 0.02, 12)
        top = np.abs(x @ y).max() / 12
        alphas, w = kernels.lasso_path(x, y, 150, 1e-4, top)
        for k in range(0, 150, 10):
            c = x @ (y - w[k] @ x) / 12
            assert c.max() <= alphas[k] + 1e-9 * top and np.allclose(c[w[k] > 0], alphas[k], atol=1e-9 * top)
