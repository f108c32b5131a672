"""Walk-forward sampling study, turnover frontier and optimality certificates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from basketry.operators import costs, factors, fits, stats, valuation, weights
from basketry.plans.market import Market
from basketry.session import materialize
from basketry.sizing import small

UNCONSTRAINED = -10.0


# --- sampling ----------------------------------------------------------------------------

def sampling_weights(m: Market, targets: Sequence[int]) -> DataFrame:
    """``(method, target_n, rebalance_date, symbol, weight)`` of the three methods at every evaluated rebalance."""
    s, targets = m.settings, sorted(int(t) for t in targets)
    evaluated = m.schedule.hint(m.fit_benchmark.select("rebalance_date"))
    members = m.members.join(evaluated, "rebalance_date", "left_semi")
    buckets = weights.size_buckets(
        members, m.start_caps, m.sectors, weights.buckets_per_sector(members, m.sectors, targets), m.schedule, m.n_symbols
    )
    stratified = weights.stratified_weights(buckets, m.schedule, ("rebalance_date", "target_n"))
    ranked = weights.top_by_cap(members, m.start_caps, max(targets))
    names, specs, keys = fits.tracking_problems(m.histories, ranked, m.fit_benchmark, targets, m.schedule)
    optimised = fits.solve_quadratic(names, specs, keys, max(targets), s.lookback)
    lasso = fits.solve_lasso(m.histories, m.fit_benchmark, targets, m.n_symbols, s.lookback, m.schedule)
    cols = ["rebalance_date", "target_n", "symbol", "weight"]
    parts = [df.select(F.lit(name).alias("method"), *cols) for name, df in
             (("stratified", stratified), ("optimization", optimised), ("lasso", lasso))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sampling_study(m: Market, targets: Sequence[int]) -> DataFrame:
    """Out-of-sample tracking error of every (rebalance, method, target); null when a method gave no weights."""
    w = materialize(sampling_weights(m, targets), "sampling_weights")
    label = F.concat_ws("|", "method", F.col("target_n").cast("string"))
    growth = valuation.segment_growth(
        w.select(label.alias("strategy"), "rebalance_date", "symbol", "weight"), m.spans, normalize=True
    )
    te = valuation.forward_tracking_error(growth, m.benchmark_returns, ["strategy"], m.settings.periods_per_year).select(
        "rebalance_date", F.split("strategy", r"\|")[0].alias("method"), F.split("strategy", r"\|")[1].cast("bigint").alias("target_n"), "tracking_error"
    )
    counts = w.groupBy("rebalance_date", "method", "target_n").agg(F.count(F.lit(1)).alias("actual_n"))
    grid = m.fit_benchmark.select("rebalance_date", F.explode(F.array(*[F.lit(x) for x in ("stratified", "optimization", "lasso")])).alias("method")).select(
        "*", F.explode(F.array(*[F.lit(int(t)) for t in targets]).cast("array<bigint>")).alias("target_n")
    )
    keys = ["rebalance_date", "method", "target_n"]
    return grid.join(counts, keys, "left").join(te, keys, "left").na.fill(0, ["actual_n"])


# --- turnover frontier -------------------------------------------------------------------

@dataclass
class Frontier:
    """Inputs of the frontier at the last held rebalance: problems, the portfolio held before, candidates and benchmark."""

    names: DataFrame
    specs: DataFrame
    keys: list[str]
    previous: DataFrame
    exposure: DataFrame
    histories: DataFrame
    bench: DataFrame


def too_short(m: Market, strategy: str = "multi_factor") -> str | None:
    """Why the last held rebalance of a strategy cannot be studied, if so."""
    pair = costs.last_two_held(m.weights_of(strategy), strategy).first()
    if pair["t_prev"] is None:
        return "fewer than two held rebalances"
    start = m.segments.where(F.col("rebalance_date") == F.lit(pair["t_curr"])).first()
    if start is None or start["sp"] < m.settings.lookback:
        return f"fewer than {m.settings.lookback} trading rows before the last held rebalance"
    return None


def frontier_problems(m: Market, budgets: Sequence[float], max_weight: float = 1.0) -> Frontier:
    """The grid of floors (none, median and upper quartile of the candidates' composite) and turnover budgets."""
    s = m.settings
    dates = costs.last_two_held(m.weights_of("multi_factor"), "multi_factor")
    tilted = m.weights_of("multi_factor")
    pair = dates.select(F.struct("t_prev", "t_curr"))
    current = F.col("_d.t_curr")
    at = lambda df: df.withColumn("_d", pair.scalar()).where(F.col("rebalance_date") == current).drop("_d")
    previous = materialize(
        tilted.withColumn("_d", pair.scalar()).where(F.col("rebalance_date") == F.col("_d.t_prev")).select(current.alias("rebalance_date"), "symbol", "weight"),
        "previous",
    )
    histories = materialize(at(m.histories).join(at(m.composite), ["rebalance_date", "symbol"], "left_semi"), "candidates")
    exposure = at(m.composite)
    # Fixed cap weights times trailing returns, missing returns contributing nothing.
    days = small(fits.trailing_days(m.segments.where(F.col("sp") >= s.lookback), s.lookback).select("rebalance_date", "pos"), m.schedule.n * s.lookback)
    bench_days = at(m.cap_weights).join(m.returns, "symbol").join(days, ["rebalance_date", "pos"]).groupBy("rebalance_date", "pos").agg(
        F.sum(F.col("weight") * F.col("ret")).alias("b")
    )
    bench = materialize(bench_days.groupBy("rebalance_date").agg(F.sort_array(F.collect_list(F.struct("pos", "b"))).alias("_s")).select("rebalance_date", F.col("_s.b").alias("b")), "frontier_benchmark")
    scored = exposure.join(histories.select("rebalance_date", "symbol"), ["rebalance_date", "symbol"], "left_semi")
    cuts = factors.composite_quantiles(scored, {"median": 0.5, "p75": 0.75}, m.n_symbols)
    floor = lambda name, value: F.struct(F.lit(name).alias("target_name"), value.alias("factor_target"))
    floors = F.array(floor("unconstrained", F.lit(UNCONSTRAINED)), floor("median", F.col("median")), floor("p75", F.col("p75")))
    targets = materialize(cuts.select("rebalance_date", F.explode(floors).alias("t")).select("rebalance_date", "t.*"), "targets")
    names, specs, keys = fits.turnover_problems(histories, bench, previous, exposure, targets, budgets, m.schedule, max_weight)
    return Frontier(names, materialize(specs, "frontier_specs"), keys, previous, exposure, histories, bench)


def frontier(m: Market, budgets: Sequence[float], max_weight: float = 1.0) -> DataFrame:
    """Tracking error against turnover at the last held rebalance, starting from the previous tilted portfolio.

    One row per feasible (named factor target, turnover budget), with the number of candidates.
    """
    s, fr = m.settings, frontier_problems(m, budgets, max_weight)
    keys = fr.keys
    w = materialize(fits.solve_quadratic(fr.names, fr.specs, keys, m.n_symbols, s.lookback), "frontier_weights")

    points = w.select(*keys).distinct()
    booked = w.select(*keys, "symbol", F.col("weight").alias("dw")).unionByName(
        points.join(fr.previous, "rebalance_date").select(*keys, "symbol", (-F.col("weight")).alias("dw"))
    )
    turnover = booked.groupBy(*keys, "symbol").agg(F.sum("dw").alias("dw")).groupBy(*keys).agg(F.sum(F.abs("dw")).alias("realized_turnover"))
    held = w.join(fr.exposure, ["rebalance_date", "symbol"]).groupBy(*keys).agg(
        F.sum(F.col("weight") * F.col("composite")).alias("realized_factor_exposure"), F.count_if(F.col("weight") > 1e-6).alias("n_holdings"),
        F.count(F.lit(1)).alias("n_candidates"),
    )
    te = in_sample_tracking_error(w, fr.histories, fr.bench, keys, s.periods_per_year)
    return turnover.join(held, keys).join(te, keys).select(
        *keys, "realized_turnover", "realized_factor_exposure", "tracking_error", "n_holdings", "n_candidates"
    )


def frontier_status(m: Market, budgets: Sequence[float], max_weight: float = 1.0) -> DataFrame:
    """Every point of the grid: candidates, the greatest exposure within the budget, and whether the point has a solution."""
    fr = frontier_problems(m, budgets, max_weight)
    reach = fits.greatest_exposure(fr.names, fr.specs, fr.keys, m.n_symbols)
    return fits.fit_status(fr.names, fr.specs, fr.keys, m.n_symbols).join(reach, fr.keys).select(
        *fr.keys, "n_candidates", "status", "within_budget", F.col("exposure").alias("greatest_exposure")
    )


def turnover_fit_certificate(m: Market, budgets: Sequence[float], tolerance: float = 1e-6, max_weight: float = 1.0) -> DataFrame:
    """Checks every solved grid point by a bound: ``(keys..., n_candidates, sums_to_one, within_bounds, meets_floor, within_budget,
    is_optimal)``.

    With the multipliers of the sum, the floor and the budget, the least value that any portfolio of the grid point can have
    under the gradient at the fit is a sum of one minimum per name, taken at zero, at the weight held before or at the greatest
    weight. The fit is optimal when it lies above that bound by ``tolerance`` of the objective at most; a wrong multiplier can only lower the
    bound. So the better of two is taken: with the sum's multiplier as it is, and lowered until no name gains at the greatest
    weight, which keeps a last digit of the multiplier from counting once for every name.
    """
    fr = frontier_problems(m, budgets, max_weight)
    w = materialize(fits.solve_quadratic(fr.names, fr.specs, fr.keys, m.n_symbols, m.settings.lookback, multipliers=True), "turnover_fit")
    return certified(w, fr, tolerance, max_weight)


def certified(w: DataFrame, fr: Frontier, tolerance: float = 1e-6, max_weight: float = 1.0) -> DataFrame:
    """The checks of ``turnover_fit_certificate`` on weights with multipliers."""
    keys = fr.keys
    scale = fr.specs.select(*keys, "scale")
    days = w.join(fr.histories, ["rebalance_date", "symbol"]).select(*keys, "symbol", "weight", F.posexplode("x").alias("t", "r"))
    target = fr.bench.select("rebalance_date", F.posexplode("b").alias("t", "b")).where("b IS NOT NULL")
    resid = days.groupBy(*keys, "t").agg(F.sum(F.col("weight") * F.col("r")).alias("fit")).join(target, ["rebalance_date", "t"]).select(
        *keys, "t", (F.col("fit") - F.col("b")).alias("e"), "b"
    )
    size = resid.join(scale, keys).groupBy(*keys).agg((F.sum(F.col("e") * F.col("e") + F.col("b") * F.col("b")) / F.first("scale") ** 2).alias("_size"))
    grads = days.join(resid, [*keys, "t"]).join(scale, keys).groupBy(*keys, "symbol").agg((F.sum(F.col("r") * F.col("e")) / F.first("scale") ** 2).alias("g"))
    own = fr.names.select("rebalance_date", "symbol", "f", "q")
    graded = w.join(grads, [*keys, "symbol"]).join(own, ["rebalance_date", "symbol"])
    floor = F.greatest("exposure_multiplier", F.lit(0.0))
    trade = F.greatest("turnover_multiplier", F.lit(0.0))
    price = F.col("g") - F.col("sum_multiplier") - floor * F.col("f")
    graded = materialize(graded.withColumn("_price", price), "graded")
    lowered = graded.groupBy(*keys).agg(F.greatest(F.max(-trade - F.col("_price")), F.lit(0.0)).alias("_lower"))  # a row per grid point
    graded = graded.join(F.broadcast(lowered), keys)

    def least(paid: Column) -> Column:
        at = lambda z: paid * z + trade * F.abs(z - F.col("q"))
        return F.least(at(F.lit(0.0)), at(F.least("q", F.lit(float(max_weight)))), at(F.lit(float(max_weight))))

    sums = graded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_candidates"), (F.abs(F.sum("weight") - 1) < 1e-9).alias("sums_to_one"),
        ((F.min("weight") >= 0) & (F.max("weight") <= max_weight + 1e-9)).alias("within_bounds"),
        F.sum(F.col("weight") * F.col("f")).alias("_exposure"), F.sum(F.abs(F.col("weight") - F.col("q"))).alias("_trade"),
        F.sum(F.col("g") * F.col("weight")).alias("_value"),
        F.greatest(F.sum(least(F.col("_price"))), F.sum(least(F.col("_price") + F.col("_lower"))) - F.first("_lower")).alias("_least"),
        F.first("sum_multiplier").alias("_s"), F.first(floor).alias("_f"), F.first(trade).alias("_t"),
    ).join(size, keys)
    bound = F.col("_s") + F.col("_f") * F.col("factor_target") - F.col("_t") * F.col("turnover_budget") + F.col("_least")
    return sums.select(
        *keys, "n_candidates", "sums_to_one", "within_bounds", (F.col("_exposure") >= F.col("factor_target") - 1e-6).alias("meets_floor"),
        (F.col("_trade") <= F.col("turnover_budget") + 1e-6).alias("within_budget"), (F.col("_value") - bound <= tolerance * F.col("_size")).alias("is_optimal"),
    )


def in_sample_tracking_error(w: DataFrame, histories: DataFrame, bench: DataFrame, keys: Sequence[str], periods_per_year: float) -> DataFrame:
    """Annualised deviation of ``sum(w r) - b`` over the fitting window."""
    paths = w.join(histories, ["rebalance_date", "symbol"]).select(*keys, "weight", F.posexplode("x").alias("t", "r")).groupBy(*keys, "t").agg(
        F.sum(F.col("weight") * F.col("r")).alias("ret")
    )
    target = bench.select("rebalance_date", F.posexplode("b").alias("t", "bench_ret")).where("bench_ret IS NOT NULL")
    return paths.join(target, ["rebalance_date", "t"]).groupBy(*keys).agg(stats.tracking_error_col(periods_per_year).alias("tracking_error"))


# --- optimality certificates -------------------------------------------------------------

def _certificate(graded: DataFrame, keys: Sequence[str], upper: float, tolerance: float) -> DataFrame:
    """A fit is optimal when no held name has a larger gradient than a name that could still take weight."""
    worst_held = F.max(F.when(F.col("weight") > 1e-9, F.col("g")))
    best_open = F.min(F.when(F.col("weight") < upper - 1e-9, F.col("g")))
    size = F.max(F.abs("g")) + F.max("scale")
    return graded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_candidates"), (F.abs(F.sum("weight") - 1) < 1e-9).alias("sums_to_one"),
        ((F.min("weight") >= 0) & (F.max("weight") <= upper + 1e-9)).alias("within_bounds"),
        F.coalesce(worst_held <= best_open + tolerance * size, F.lit(True)).alias("is_optimal"),
    )


def tracking_fit_certificate(m: Market, targets: Sequence[int], tolerance: float = 1e-6) -> DataFrame:
    ranked = weights.top_by_cap(m.members, m.start_caps, max(targets))
    names, specs, keys = fits.tracking_problems(m.histories, ranked, m.fit_benchmark, targets, m.schedule)
    w = materialize(fits.solve_quadratic(names, specs, keys, max(targets), m.settings.lookback), "fit")
    days = w.join(m.histories, ["rebalance_date", "symbol"]).select(*keys, "symbol", "weight", F.posexplode("x").alias("t", "r"))
    target = m.fit_benchmark.select("rebalance_date", F.posexplode("b").alias("t", "b")).where("b IS NOT NULL")
    resid = days.groupBy(*keys, "t").agg(F.sum(F.col("weight") * F.col("r")).alias("fit")).join(target, ["rebalance_date", "t"]).select(
        *keys, "t", (F.col("fit") - F.col("b")).alias("e")
    )
    graded = days.join(resid, [*keys, "t"]).groupBy(*keys, "symbol", "weight").agg(
        F.sum(F.col("r") * F.col("e")).alias("g"), F.avg(F.col("r") * F.col("r")).alias("scale")
    )
    return _certificate(graded, keys, 1.0, tolerance)


def min_vol_certificate(m: Market, tolerance: float = 1e-6) -> DataFrame:
    keys = ["rebalance_date"]
    days = m.min_vol_weights.join(m.histories, ["rebalance_date", "symbol"]).select(
        *keys, "symbol", "weight", F.posexplode(fits.demeaned()).alias("t", "r")
    )
    path = days.groupBy(*keys, "t").agg(F.sum(F.col("weight") * F.col("r")).alias("v"))
    shrunk = m.shrunk.select("rebalance_date", "n", "mu", "shrinkage")
    sample = (1 - F.col("shrinkage")) / F.col("n") * F.col("_rv")
    graded = days.join(path, [*keys, "t"]).groupBy(*keys, "symbol", "weight").agg(F.sum(F.col("r") * F.col("v")).alias("_rv")).join(
        m.schedule.hint(shrunk), "rebalance_date"
    ).select(*keys, "symbol", "weight", (sample + F.col("shrinkage") * F.col("mu") * F.col("weight")).alias("g"), (F.col("mu") * 1e-3).alias("scale"))
    return _certificate(graded, keys, m.settings.max_weight, tolerance)


def sparse_path_certificate(paths: DataFrame, histories: DataFrame, benchmark: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """``(rebalance_date, k, alpha, n_candidates, n_held, is_stationary, gap_is_closed)`` for every penalty of ``fits.lasso_paths``.

    Over all candidates, none correlates with the residual above the penalty and those held do so at the penalty, to
    ``tolerance`` of the greatest penalty; and the objective lies no further above its dual bound (the residual scaled into the feasible set) than ``tolerance`` of its size.
    The residuals, one array a penalty, come to the candidates; no candidate is paired with another.
    """
    keys = ["rebalance_date", "k"]
    held = paths.where("symbol IS NOT NULL")
    fitted = held.join(histories, ["rebalance_date", "symbol"]).select(*keys, "coefficient", F.posexplode("x").alias("t", "r")).groupBy(*keys, "t").agg(
        F.sum(F.col("coefficient") * F.col("r")).alias("fit")
    )
    penalties = paths.groupBy(*keys).agg(F.first("alpha").alias("alpha"), F.sum("coefficient").alias("_total"), F.count("symbol").alias("n_held"))
    penalties = penalties.withColumn("_top", F.max("alpha").over(W.partitionBy("rebalance_date")))  # a row a penalty
    days = benchmark.select("rebalance_date", F.posexplode("b").alias("t", "b")).where("b IS NOT NULL")
    grid = penalties.join(days, "rebalance_date").join(fitted, [*keys, "t"], "left").withColumn("e", F.col("b") - F.coalesce("fit", F.lit(0.0)))
    resid = grid.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("t", "e"))).alias("_e"), F.count(F.lit(1)).alias("_days"), F.sum(F.col("e") * F.col("e")).alias("_ee"),
        F.sum(F.col("e") * F.col("b")).alias("_eb"), F.sum(F.col("b") * F.col("b")).alias("_bb"),
        *[F.first(c).alias(c) for c in ("alpha", "_total", "n_held", "_top")],
    )
    whole = resid.withColumn("_r", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_e"))), lambda t: F.coalesce(F.try_element_at("_e", t), F.lit(0.0))))
    dot = F.aggregate(F.zip_with("x", "_r", lambda a, c: F.coalesce(a * c, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v) / F.col("_days")
    graded = histories.join(materialize(whole.drop("_e"), "residuals"), "rebalance_date").withColumn("_c", dot).join(
        held.select(*keys, "symbol", F.lit(True).alias("_in")), [*keys, "symbol"], "left"
    )
    sums = graded.groupBy(*keys, "alpha", "n_held", "_top", "_total", "_days", "_ee", "_eb", "_bb").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.max("_c").alias("_most"), F.max(F.when(F.col("_in"), F.abs(F.col("_c") - F.col("alpha")))).alias("_off"),
    )
    n, a = F.col("_days"), F.col("alpha")
    size = F.col("_top")
    primal = F.col("_ee") / (2 * n) + a * F.col("_total")
    part = F.when(F.col("_most") > a, a / F.col("_most")).otherwise(1.0)
    bound = (2 * part * F.col("_eb") - part * part * F.col("_ee")) / (2 * n)
    return sums.select(
        *keys, "alpha", "n_candidates", "n_held", ((F.col("_most") <= a + tolerance * size) & (F.coalesce("_off", F.lit(0.0)) <= tolerance * size)).alias("is_stationary"),
        (primal - bound <= tolerance * F.col("_bb") / (2 * n)).alias("gap_is_closed"),
    )
