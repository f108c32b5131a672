"""Fitting jobs: one optimisation problem per (rebalance, parameters), fanned out over Spark.

``names`` tables hold one row per problem and candidate with the trailing returns as
an array of ``lookback`` values, so their size grows with candidates, never with pairs
of candidates. While a problem fits in a task (candidates x lookback, known from the
counted symbols) it is solved there. Beyond that the same solver runs on its dual: every
step is one Spark aggregation over the names and only a few numbers per trading day come
back. Both ways give the same weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from basketry.operators import kernels
from basketry.operators.calendar import trailing_days
from basketry.session import materialize
from basketry.sizing import TASK_ROWS, Calendar, Schedule, small, sum_before

TASK_CELLS = 20_000_000  # candidates x days of one problem that one task may hold (160 MB)
SALTS = 32  # places where the blocks of one key are added before they meet
FIT_COLUMNS = ("b", "n_names", "scale", "ridge", "proximal", "upper", "target", "budget")


# --- problem tables ----------------------------------------------------------------------

def trailing_histories(returns: DataFrame, members: DataFrame, segments: DataFrame, schedule: Schedule, lookback: int) -> DataFrame:
    """``(rebalance_date, symbol, x)``: members with a return on every one of the ``lookback`` rows before the start."""
    eligible = segments.where(F.col("sp") >= lookback)
    days = small(trailing_days(eligible, lookback).select("rebalance_date", "pos"), schedule.n * lookback)
    series = F.sort_array(F.collect_list(F.struct("pos", "ret")))
    return (
        returns.join(days, "pos").join(members, ["rebalance_date", "symbol"], "left_semi")
        .groupBy("rebalance_date", "symbol").agg(series.alias("_s"))
        .where(F.size("_s") == lookback).select("rebalance_date", "symbol", F.col("_s.ret").alias("x"))
    )


def trailing_benchmark(segments: DataFrame, benchmark: DataFrame, cal: Calendar, schedule: Schedule, lookback: int, max_missing: float = 0.2, min_forward: int = 5) -> DataFrame:
    """``(rebalance_date, b)`` for rebalances that pass the window guards; days without a benchmark return are null.

    Skipped: starts before ``lookback`` rows, too many missing trailing days, or fewer
    than ``min_forward`` benchmark returns in the period ahead.
    """
    bench = benchmark.select("pos", "date", F.col("ret").alias("b"))
    eligible = segments.where((F.col("sp") >= lookback) & ~F.col("is_last"))
    past = (
        small(trailing_days(eligible, lookback).select("rebalance_date", "pos"), schedule.n * lookback)
        .join(bench.select("pos", "b"), "pos", "left").groupBy("rebalance_date")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "b"))).alias("_s"), F.avg(F.col("b").isNull().cast("double")).alias("_missing"))
        .where(F.col("_missing") <= max_missing)
    )
    ahead = (
        eligible.select("rebalance_date", "next_rebalance", "sp", "ep", F.explode(F.sequence("sp", "ep")).alias("pos"))
        .where("pos > sp").join(bench.where("b IS NOT NULL"), "pos").groupBy("rebalance_date").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_forward)
    )
    return past.join(ahead, "rebalance_date").select("rebalance_date", F.col("_s.b").alias("b"))


def demeaned(x: str = "x") -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    return F.transform(x, lambda v: v - mean)


def squares(x: str = "x") -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def added(blocks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Element-wise sums of equally long arrays per key. Blocks of one key are added in SALTS places first, so what a
    shuffle carries is whole blocks, one per task and key, and no group gathers more than SALTS of them at the end."""
    schema = StructType([*[blocks.schema[k] for k in keys], StructField(value, ArrayType(DoubleType()))])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf[value].to_numpy()), axis=0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, value: [total]})

    salted = blocks.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy(*keys, "_salt")
    return salted.applyInPandas(add, schema).groupBy(*keys).applyInPandas(add, schema)


def greatest_exposure(names: DataFrame, specs: DataFrame, keys: Sequence[str], names_bound: int | None, task_rows: int = TASK_ROWS) -> DataFrame:
    """``(keys..., within_budget, exposure)``: whether a portfolio can be reached within the turnover budget, and the
    greatest exposure of one that can.

    Buying the names of greatest exposure and selling those of least is a fractional knapsack: with the names in order of
    their exposure, running sums of the room to buy and of what can be sold tell how much of each name trades for any
    budget. What one can gain stops where the portfolio of greatest exposure without a budget is reached.
    Weights above the limit must be sold first.
    """
    shared = [k for k in keys if k in names.columns]
    group = [*shared, "upper"]
    u = F.col("upper")
    rows = names.select(*shared, "symbol", "f", "q").join(specs.select(*group).distinct(), shared)
    rows = rows.select(*group, "symbol", "f", F.least("q", u).alias("own"), F.greatest(F.col("q") - u, F.lit(0.0)).alias("excess"), u.cast("double").alias("_one"))
    rows = rows.withColumn("room", u - F.col("own"))
    down, up = [F.desc("f"), F.col("symbol")], [F.col("f"), F.col("symbol")]
    for order, value, out in ((down, "_one", "_filled"), (down, "room", "_bought"), (up, "own", "_sold")):
        rows = sum_before(rows, group, order, value, names_bound, out, task_rows)
    rows = materialize(rows.withColumn("best", F.greatest(F.lit(0.0), F.least(u, 1 - F.col("_filled")))), "knapsack")
    totals = rows.groupBy(*group).agg(
        F.sum("own").alias("_own"), F.sum("excess").alias("_excess"), F.sum(F.col("f") * F.col("own")).alias("_held"),
        F.sum(F.greatest(F.col("best") - F.col("own"), F.lit(0.0))).alias("_enough"),
    )
    lack, left = 1 - F.col("_own"), F.col("budget") - F.col("_excess")
    bounds = specs.select(*keys, "upper", "budget").join(totals, group).select(
        *keys, "upper", "_held", (left >= F.abs(lack) - 1e-9).alias("within_budget"), F.least((left + lack) / 2, F.col("_enough")).alias("_buy"), lack.alias("_lack")
    )
    part = lambda total, start, size: F.greatest(F.lit(0.0), F.least(total - F.col(start), F.col(size)))
    bought, sold = part(F.col("_buy"), "_bought", "room"), part(F.col("_buy") - F.col("_lack"), "_sold", "own")
    return rows.join(bounds, group).groupBy(*keys).agg(
        F.first("within_budget").alias("within_budget"), (F.first("_held") + F.sum(F.col("f") * (bought - sold))).alias("exposure")
    )


def feasibility(names: DataFrame, specs: DataFrame, keys: Sequence[str], names_bound: int | None, task_rows: int = TASK_ROWS) -> DataFrame:
    """The specs with ``feasible``, told before anything is solved: enough names for the greatest weight, two days, and
    where there is a budget and a floor, an exposure that reaches the floor within the budget."""
    keys = list(keys)
    days = F.size(F.filter("b", lambda v: v.isNotNull() & ~F.isnan(v)))
    enough = (F.col("n_names") * F.col("upper") >= 1) & (days >= 2)
    if not {"f", "q"} <= set(names.columns):
        return specs.withColumn("feasible", enough)
    reach = greatest_exposure(names, specs, keys, names_bound, task_rows)
    met = F.col("within_budget") & (F.col("exposure") >= F.col("target") - 1e-9 * (1 + F.abs("target")))
    return specs.join(reach, keys).withColumn("feasible", enough & met).drop("within_budget", "exposure")


def fit_status(names: DataFrame, specs: DataFrame, keys: Sequence[str], names_bound: int | None) -> DataFrame:
    """``(keys..., n_candidates, status)`` of every problem: ``solved``, or ``infeasible`` where that is proved.

    A problem with a solution that the solver does not reach raises instead.
    """
    keys = list(keys)
    shared_keys = [k for k in keys if k in names.columns]
    counted = names.groupBy(*shared_keys).agg(F.count(F.lit(1)).alias("n_candidates"))
    told = feasibility(names, specs, keys, names_bound).select(*keys, F.when(F.col("feasible"), "solved").otherwise("infeasible").alias("status"))
    return told.join(counted, shared_keys)


# --- shrunk covariance -------------------------------------------------------------------

def day_gram(histories: DataFrame) -> DataFrame:
    """``(rebalance_date, t, u, a)``: sums over names of ``x_t x_u`` of demeaned returns.

    The Gram matrix is taken over days, which the lookback bounds. Each task adds up its
    own names first, so the shuffle carries one small block per task.
    """
    schema = StructType([StructField("rebalance_date", histories.schema["rebalance_date"].dataType), StructField("a", ArrayType(DoubleType()))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for date, part in pdf.groupby("rebalance_date"):
                x = np.stack(part["x"].to_numpy())
                x = x - x.mean(axis=1, keepdims=True)
                sums[date] = sums.get(date, 0.0) + x.T @ x
        for date, block in sums.items():
            yield pd.DataFrame({"rebalance_date": [date], "a": [block.ravel()]})

    blocks = histories.select("rebalance_date", "x").mapInPandas(partial, schema)
    cells = added(blocks, ["rebalance_date"], "a").select("rebalance_date", F.size("a").alias("_n"), F.posexplode("a").alias("_i", "a"))
    side = F.sqrt("_n").cast("int")
    return cells.select("rebalance_date", F.floor(F.col("_i") / side).alias("t"), (F.col("_i") % side).cast("bigint").alias("u"), "a")


def shrinkage(histories: DataFrame, lookback: int) -> DataFrame:
    """Ledoit-Wolf (2004) terms per rebalance: ``n, p, mu, delta, beta, shrinkage``.

    Sums over pairs of names equal sums over pairs of days of the squared day Gram, so no
    pair of names is formed.
    """
    gram = day_gram(histories)
    p = histories.groupBy("rebalance_date").agg(F.count(F.lit(1)).alias("p"))
    n = float(lookback)
    terms = gram.groupBy("rebalance_date").agg(
        (F.sum(F.when(F.col("t") == F.col("u"), F.col("a"))) / n).alias("_tr"), (F.sum(F.col("a") * F.col("a")) / (n * n)).alias("_s2"),
        (F.sum(F.when(F.col("t") == F.col("u"), F.col("a") * F.col("a"))) / n).alias("_e2"),
    ).join(p, "rebalance_date")
    mu = F.col("_tr") / F.col("p")
    delta = (F.col("_s2") - 2 * mu * F.col("_tr") + F.col("p") * mu * mu) / F.col("p")
    beta = F.least((F.col("_e2") - F.col("_s2")) / (F.col("p") * n), delta)
    return terms.select(
        "rebalance_date", F.lit(lookback).cast("bigint").alias("n"), "p", mu.alias("mu"), delta.alias("delta"), beta.alias("beta"),
        F.coalesce(F.try_divide(beta, delta), F.lit(0.0)).alias("shrinkage"),
    )


# --- quadratic fits ----------------------------------------------------------------------

def tracking_problems(histories: DataFrame, ranked: DataFrame, benchmark: DataFrame, targets: Sequence[int], schedule: Schedule):
    """Names and specs of the tracking fits over the ``n`` largest members, per rebalance and ``n``."""
    wanted = F.filter(F.array(*[F.lit(int(n)) for n in targets]).cast("array<bigint>"), lambda n: F.col("cap_rank") <= n)
    names = ranked.select("rebalance_date", "symbol", F.explode(wanted).alias("target_n")).join(
        histories, ["rebalance_date", "symbol"]
    )
    keys = ["rebalance_date", "target_n"]
    return _with_specs(names, keys, benchmark, schedule)


def minimum_variance_problems(histories: DataFrame, shrunk: DataFrame, max_weight: float, lookback: int, schedule: Schedule):
    """Names (demeaned returns) and specs of the shrunk-covariance fits, scaled so that the mean variance is 1."""
    names = histories.select("rebalance_date", "symbol", demeaned().alias("x"))
    s = F.least(F.greatest(F.col("shrinkage"), F.lit(1e-8)), F.lit(1 - 1e-8))
    specs = shrunk.select(
        "rebalance_date", F.array_repeat(F.lit(0.0), lookback).alias("b"), F.col("p").alias("n_names"),
        F.sqrt(F.col("n") * F.col("mu") / (1 - s)).alias("scale"), s.alias("ridge"), F.lit(False).alias("proximal"),
        F.lit(float(max_weight)).alias("upper"), F.lit(None).cast("double").alias("target"), F.lit(None).cast("double").alias("budget"),
    )
    return names, specs, ["rebalance_date"]


def turnover_problems(
    histories: DataFrame, benchmark: DataFrame, previous: DataFrame, exposure: DataFrame, targets: DataFrame, budgets: Sequence[float],
    schedule: Schedule, max_weight: float = 1.0,
):
    """Names and specs of the tracking fits under turnover budgets and exposure floors.

    ``targets`` has ``rebalance_date, factor_target`` rows and may have columns that tell them apart; candidates are names with a
    complete history and an exposure, and previous weights outside them are ignored.
    """
    named = [c for c in targets.columns if c != "rebalance_date"]
    grid = targets.select("rebalance_date", *named, F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("turnover_budget"))
    prior = previous.select("rebalance_date", "symbol", F.col("weight").alias("q"))
    names = (
        histories.join(exposure.where("composite IS NOT NULL").select("rebalance_date", "symbol", F.col("composite").alias("f")), ["rebalance_date", "symbol"])
        .join(prior, ["rebalance_date", "symbol"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    )
    names, specs, keys = _with_specs(names, ["rebalance_date"], benchmark, schedule)
    points = small(grid, schedule.n * len(budgets) * 8)
    specs = specs.join(points, "rebalance_date").withColumns(
        {"target": F.col("factor_target"), "budget": F.col("turnover_budget"), "upper": F.lit(float(max_weight))}
    )
    return names, specs, [*keys, *named, "turnover_budget"]


def _with_specs(names: DataFrame, keys: list[str], benchmark: DataFrame, schedule: Schedule):
    """Attach the benchmark and drop problems without one. Scale makes the mean name a unit vector."""
    names = names.join(schedule.hint(benchmark.select("rebalance_date")), "rebalance_date", "left_semi")
    none = F.lit(None).cast("double")
    specs = (
        names.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_names"), F.sqrt(F.avg(squares())).alias("scale"))
        .join(small(benchmark, schedule.n), "rebalance_date").select(
            *keys, "b", "n_names", "scale", F.lit(0.0).alias("ridge"), F.lit(True).alias("proximal"), F.lit(1.0).alias("upper"),
            none.alias("target"), none.alias("budget"),
        )
    )
    return names, specs, keys


def _spec(row) -> tuple[kernels.Spec, np.ndarray]:
    """Kernel spec of a spec row and the mask of days that take part."""
    b = np.array([np.nan if v is None else v for v in row["b"]], dtype=float)
    days = ~np.isnan(b)
    limit = lambda v: None if v is None or np.isnan(v) else float(v)
    return kernels.Spec(
        b=b[days] / row["scale"], n_names=int(row["n_names"]), ridge=float(row["ridge"]), proximal=bool(row["proximal"]),
        upper=float(row["upper"]), target=limit(row["target"]), budget=limit(row["budget"]),
    ), days


def _arrays(pdf: pd.DataFrame, days: np.ndarray, scale: float):
    x = np.stack(pdf["x"].to_numpy()).astype(float)[:, days] / scale
    zero = np.zeros(len(pdf))
    return x, (pdf["f"].to_numpy(float) if "f" in pdf else zero), (pdf["q"].to_numpy(float) if "q" in pdf else zero)


def _nothing(schema: StructType) -> pd.DataFrame:
    return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})


MULTIPLIERS = ("sum_multiplier", "exposure_multiplier", "turnover_multiplier")


def _weight_schema(specs: DataFrame, keys: Sequence[str]) -> StructType:
    numbers = [StructField(c, DoubleType()) for c in ("weight", *MULTIPLIERS)]
    return StructType([specs.schema[k] for k in keys] + [StructField("symbol", StringType()), *numbers])


def solve_quadratic(
    names: DataFrame, specs: DataFrame, keys: Sequence[str], names_bound: int | None, lookback: int, infeasible: str = "skip",
    task_cells: int = TASK_CELLS, multipliers: bool = False,
) -> DataFrame:
    """``(keys..., symbol, weight)``: every candidate of every feasible problem.

    Whether a problem has a solution is proved first; one that has and is not solved raises. ``multipliers`` adds those of
    the weights' sum, the exposure floor and the turnover budget, in units of the scaled objective.

    ``names`` may be keyed by some of ``keys`` only; problems that differ in the others
    share their candidates, which meet them in one group and are never copied for each.

    ``names_bound`` is a proven bound on candidates per problem; beyond ``task_cells``
    values the distributed way is taken. ``infeasible='error'`` raises instead of
    leaving a problem out.
    """
    keys = list(keys)
    told = materialize(feasibility(names, specs, keys, names_bound), "specs")  # a row per problem; also keeps the two sides of the cogroup apart
    if infeasible == "error" and (bad := told.where("NOT feasible").limit(1).collect()):
        raise ValueError(f"infeasible fit: {bad[0]['n_names']} candidates, upper weight {bad[0]['upper']}")
    specs = told.where("feasible").drop("feasible")
    out = [*keys, "symbol", "weight", *(MULTIPLIERS if multipliers else ())]
    if names_bound is None or names_bound * lookback > task_cells:
        return _solve_distributed(names, specs, keys).select(*out)
    schema = _weight_schema(specs, keys)
    shared_keys = [k for k in keys if k in names.columns]
    order = [c for c in ("target", "budget") if c in specs.columns]

    def fit(pdf: pd.DataFrame, spec_pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_nothing(schema)]
        if not pdf.empty and not spec_pdf.empty:
            pdf, cold = pdf.sort_values("symbol"), None
            # Problems over the same names differ in their limits alone: from the widest on, each starts where its neighbour did.
            for _, row in spec_pdf.sort_values(order, ascending=[True, False][:len(order)]).iterrows():
                spec, days = _spec(row)
                w, prices, cold = kernels.fit_with_multipliers(*_arrays(pdf, days, row["scale"]), spec, proven=True, start=cold)
                parts.append(pd.DataFrame({**{k: [row[k]] * len(pdf) for k in keys}, "symbol": pdf["symbol"].to_numpy(), "weight": w, **dict(zip(MULTIPLIERS, prices))}))
        return pd.concat(parts[1:], ignore_index=True) if len(parts) > 1 else parts[0]

    return names.groupBy(*shared_keys).cogroup(specs.groupBy(*shared_keys)).applyInPandas(fit, schema).select(*out)


def _solve_distributed(names: DataFrame, specs: DataFrame, keys: list[str]) -> DataFrame:
    """The dual solver with its sums added up by Spark, all open problems in one job per step."""
    spark = names.sparkSession
    shared_keys = [k for k in keys if k in names.columns]
    numbered = materialize(
        specs.select(
            "*", F.row_number().over(W.orderBy(*keys)).cast("bigint").alias("_problem"),
            F.dense_rank().over(W.orderBy(*shared_keys)).cast("bigint").alias("_group"),
        ), "specs",
    )  # one row per problem: rebalances x parameters
    rows = {r["_problem"]: r for r in numbered.collect()}
    members: dict[int, list[int]] = {}
    for p, r in rows.items():
        members.setdefault(r["_group"], []).append(p)
    groups = numbered.select(*shared_keys, "_group").distinct()
    tagged = materialize(names.join(small(groups, len(rows)), shared_keys), "names")
    specs_by = {p: (*_spec(r), float(r["scale"])) for p, r in rows.items()}
    solvers, points, final = {}, {}, {}
    for p, (spec, days, _) in specs_by.items():
        solvers[p] = kernels.solve(spec)
        points[p] = next(solvers[p])
    while points:
        sums = _sum_names(tagged, specs_by, members, points)
        following = {}
        for p in points:
            try:
                following[p] = solvers[p].send(sums[p])
            except StopIteration as done:
                point, met = done.value
                if not met:
                    raise kernels.unsettled(specs_by[p][0])
                final[p] = point
        points = following
    schema = _weight_schema(specs, keys)
    shared = spark.sparkContext.broadcast((specs_by, members, final, {p: [rows[p][k] for k in keys] for p in final}))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        specs_now, problems, solved, values = shared.value
        for pdf in batches:
            for g, part in pdf.groupby("_group"):
                for p in problems[g]:
                    if p in solved:
                        spec, days, scale = specs_now[p]
                        w = kernels.name_weights(*_arrays(part, days, scale), solved[p], spec)[0]
                        prices = dict(zip(MULTIPLIERS, kernels.multipliers(solved[p], spec)))
                        yield pd.DataFrame({**dict(zip(keys, values[p])), "symbol": part["symbol"].to_numpy(), "weight": w, **prices})

    raw = tagged.mapInPandas(weigh, schema)
    total = raw.groupBy(*keys).agg(F.sum("weight").alias("_total"))
    return raw.join(small(total, len(rows)), keys).withColumn("weight", F.col("weight") / F.col("_total")).drop("_total")


def _sum_names(tagged: DataFrame, specs_by: dict, members: dict, points: dict) -> dict:
    """One job: the solver's sums for every open problem, added up per task and then across tasks."""
    shared = tagged.sparkSession.sparkContext.broadcast((specs_by, members, points))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        specs_now, problems, open_points = shared.value
        sums: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby("_group"):
                for p in problems[g]:
                    if p in open_points:
                        spec, days, scale = specs_now[p]
                        sums[p] = sums.get(p, 0.0) + kernels.name_sums(*_arrays(part, days, scale), open_points[p], spec)
        for p, s in sums.items():
            yield pd.DataFrame({"_problem": [p], "s": [s]})

    schema = StructType([StructField("_problem", LongType()), StructField("s", ArrayType(DoubleType()))])
    totals = added(tagged.mapInPandas(partial, schema), ["_problem"], "s")
    out = {r["_problem"]: np.array(r["s"]) for r in totals.collect()}  # days squared per problem
    shared.destroy()
    return out


# --- sparse regression -------------------------------------------------------------------

def _pick(coefficients: np.ndarray, target: int) -> np.ndarray:
    """Coefficients at the penalty whose support size is nearest the target, the first on a tie."""
    return coefficients[int(np.argmin(np.abs((coefficients != 0).sum(axis=1) - target)))]


def solve_lasso(
    histories: DataFrame, benchmark: DataFrame, targets: Sequence[int], names_bound: int | None, lookback: int, schedule: Schedule,
    n_alphas: int = 150, eps: float = 1e-4, task_cells: int = TASK_CELLS,
) -> DataFrame:
    """``(rebalance_date, target_n, symbol, weight)`` from the non-negative lasso path over all histories.

    Beyond ``task_cells`` the path is followed on a working set of names; all other names
    are then checked against every penalty's optimality condition and violators join,
    until none is left. The result is the path over all names.
    """
    names, specs = _lasso_inputs(histories, benchmark, names_bound, lookback, schedule, n_alphas, eps, task_cells)
    schema = StructType([
        names.schema["rebalance_date"], StructField("target_n", LongType()), StructField("symbol", StringType()), StructField("weight", DoubleType()),
    ])

    def picks(pdf: pd.DataFrame, alphas: np.ndarray, coefficients: np.ndarray) -> Iterator[pd.DataFrame]:
        for target in targets:
            w = _pick(coefficients, target)
            on = w > 0
            if on.any():
                yield pd.DataFrame({
                    "rebalance_date": pdf["rebalance_date"].to_numpy()[on], "target_n": int(target),
                    "symbol": pdf["symbol"].to_numpy()[on], "weight": w[on] / w[on].sum(),
                })

    return _lasso_groups(names, specs, schema, picks, n_alphas, eps)


def lasso_paths(
    histories: DataFrame, benchmark: DataFrame, names_bound: int | None, lookback: int, schedule: Schedule, n_alphas: int = 150,
    eps: float = 1e-4, task_cells: int = TASK_CELLS,
) -> DataFrame:
    """``(rebalance_date, k, alpha, symbol, coefficient)``: the coefficients above zero at every penalty, numbered from the
    greatest; a penalty without any has one row without symbol. A penalty holds no more names than the window has days."""
    names, specs = _lasso_inputs(histories, benchmark, names_bound, lookback, schedule, n_alphas, eps, task_cells)
    schema = StructType([
        names.schema["rebalance_date"], StructField("k", LongType()), StructField("alpha", DoubleType()), StructField("symbol", StringType()),
        StructField("coefficient", DoubleType()),
    ])

    def rows(pdf: pd.DataFrame, alphas: np.ndarray, coefficients: np.ndarray) -> Iterator[pd.DataFrame]:
        day, symbols = pdf["rebalance_date"].iloc[0], pdf["symbol"].to_numpy()
        for k, (alpha, w) in enumerate(zip(alphas, coefficients)):
            on = np.flatnonzero(w)
            yield pd.DataFrame({
                "rebalance_date": day, "k": k, "alpha": alpha, "symbol": symbols[on] if len(on) else [None], "coefficient": w[on] if len(on) else [0.0],
            })

    return _lasso_groups(names, specs, schema, rows, n_alphas, eps)


def _lasso_inputs(histories, benchmark, names_bound, lookback, schedule, n_alphas, eps, task_cells) -> tuple[DataFrame, DataFrame]:
    """Names whose path is the path over all names, and the benchmark with the greatest penalty where it is known."""
    names = histories.join(schedule.hint(benchmark.select("rebalance_date")), "rebalance_date", "left_semi")
    if names_bound is None or names_bound * lookback > task_cells:
        return _lasso_working_set(names, benchmark, lookback, schedule, n_alphas, eps)
    return names, benchmark.select("rebalance_date", "b", F.lit(None).cast("double").alias("alpha_max"))


def _lasso_path_of(pdf: pd.DataFrame, row, n_alphas: int, eps: float):
    b = np.array([np.nan if v is None else v for v in row["b"]], dtype=float)
    days = ~np.isnan(b)
    x, y = np.stack(pdf["x"].to_numpy()).astype(float)[:, days], b[days]
    top = row["alpha_max"]
    top = np.abs(x @ y).max() / len(y) if top is None or np.isnan(top) else top
    alphas, coefficients = kernels.lasso_path(x, y, n_alphas, eps, top)
    return alphas, coefficients, y - coefficients @ x


def _lasso_groups(names: DataFrame, specs: DataFrame, schema: StructType, emit, n_alphas: int, eps: float) -> DataFrame:
    """What ``emit`` makes of the path of each rebalance."""

    def fit(pdf: pd.DataFrame, spec_pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or spec_pdf.empty:
            return _nothing(schema)
        pdf = pdf.sort_values("symbol")
        alphas, coefficients, _ = _lasso_path_of(pdf, spec_pdf.iloc[0], n_alphas, eps)
        parts = list(emit(pdf, alphas, coefficients))
        return pd.concat(parts, ignore_index=True) if parts else _nothing(schema)

    return names.groupBy("rebalance_date").cogroup(specs.groupBy("rebalance_date")).applyInPandas(fit, schema)


def _lasso_working_set(
    names: DataFrame, benchmark: DataFrame, lookback: int, schedule: Schedule, n_alphas: int, eps: float, tolerance: float = 1e-9
) -> tuple[DataFrame, DataFrame]:
    spark = names.sparkSession
    names = materialize(names, "names")
    batch = 2 * lookback
    dot = F.aggregate(F.zip_with("x", "b", lambda a, c: F.coalesce(a * c, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    used = F.size(F.filter("b", lambda v: v.isNotNull()))
    corr = names.join(small(benchmark, schedule.n), "rebalance_date").select("rebalance_date", "symbol", (dot / used).alias("c"))
    first = W.partitionBy("rebalance_date").orderBy(F.desc("c"), "symbol")
    working = materialize(corr.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= batch).select("rebalance_date", "symbol"), "working")
    specs = materialize(
        benchmark.join(corr.groupBy("rebalance_date").agg(F.max(F.abs("c")).alias("alpha_max")), "rebalance_date"), "specs"
    )
    date = names.schema["rebalance_date"]
    path_schema = StructType([date, StructField("alphas", ArrayType(DoubleType())), StructField("resid", ArrayType(DoubleType())), StructField("days", ArrayType(LongType()))])

    def path(pdf: pd.DataFrame, spec_pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or spec_pdf.empty:
            return _nothing(path_schema)
        row = spec_pdf.iloc[0]
        alphas, _, resid = _lasso_path_of(pdf.sort_values("symbol"), row, n_alphas, eps)
        days = np.flatnonzero([v is not None and not np.isnan(v) for v in row["b"]])
        return pd.DataFrame({"rebalance_date": [row["rebalance_date"]], "alphas": [alphas], "resid": [resid.ravel()], "days": [days]})

    score_schema = StructType([date, StructField("symbol", StringType()), StructField("excess", DoubleType())])
    while True:
        chosen = names.join(working, ["rebalance_date", "symbol"], "left_semi")
        residuals = chosen.groupBy("rebalance_date").cogroup(specs.groupBy("rebalance_date")).applyInPandas(path, path_schema)
        # rebalances x penalties x lookback numbers
        shared = spark.sparkContext.broadcast({
            r["rebalance_date"]: (np.array(r["alphas"]), np.array(r["resid"]).reshape(n_alphas, -1), np.array(r["days"])) for r in residuals.collect()
        })

        def excess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for day, part in pdf.groupby("rebalance_date"):
                    alphas, resid, days = shared.value[day]
                    grad = np.stack(part["x"].to_numpy())[:, days] @ resid.T / len(days)
                    over = ((grad - alphas) / alphas[0]).max(axis=1)
                    keep = over > tolerance
                    yield pd.DataFrame({"rebalance_date": part["rebalance_date"].to_numpy()[keep], "symbol": part["symbol"].to_numpy()[keep], "excess": over[keep]})

        outside = names.join(working, ["rebalance_date", "symbol"], "left_anti")
        worst = W.partitionBy("rebalance_date").orderBy(F.desc("excess"), "symbol")
        joining = materialize(
            outside.mapInPandas(excess, score_schema).withColumn("_r", F.row_number().over(worst)).where(F.col("_r") <= batch)
            .select("rebalance_date", "symbol"), "joining",
        )
        if joining.isEmpty():
            return chosen, specs
        working = materialize(working.unionByName(joining), "working")
