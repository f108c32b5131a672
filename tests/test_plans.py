"""Plans keep the shape they were designed for, alternative settings work, and a user's own tables do."""

import datetime as dt
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import valuation as V, weights as B
from basketry.plans import named
from basketry.plans.market import MONTHLY, Settings, build_market, supplied_market
from basketry.session import materialize
from basketry.sizing import Schedule
from tests.helpers import as_dict, days

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def market(spark):
    return supplied_market(spark, SF)


def plan_of(df) -> str:
    """Final plan after a run, without what lies inside cached tables."""
    df.collect()
    lines, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if "Initial Plan" in line:
            break
        if skip is not None and depth > skip:
            continue
        skip = depth if "InMemoryTableScan" in line else None
        lines.append(line)
    return "\n".join(lines)


def test_panel_is_never_exchanged_by_symbol(spark, market):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(V.segment_growth(market.rule_weights, market.spans, True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One exchange for the weights, one for the aggregate, one for the rebasing window.
    assert plan.count("Exchange hashpartitioning(symbol") == 1
    assert plan.count("Exchange hashpartitioning(strategy") == 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_days_are_written_out_for_holdings_alone(spark, market):
    w = market.rule_weights.where("strategy = 'equal_weight'")
    days = V.held_days(V.units_held(w, market.spans, True), market.spans)
    plan = plan_of(days)
    assert plan.index("explode(sequence(first") < plan.index("Join")  # the days come last, behind the join with what is held
    # One row for each day of each name that is held and quoted at the start; nothing for any other.
    starts = market.start_prices.select("rebalance_date", "symbol")
    held = w.join(starts, ["rebalance_date", "symbol"]).join(market.segments, "rebalance_date").agg(F.sum(F.col("ep") - F.col("sp") + 1)).first()[0]
    assert days.count() == held
    # Quotes cross as they are: once, and once more for each boundary day and each gap that a segment start falls into.
    spans, quotes, boundaries = market.spans.count(), market.prices.count(), market.segments.count() * market.n_symbols
    assert spans <= quotes + boundaries


def test_short_histories_give_an_error_row(spark, market):
    first = market.segments.agg(F.min("rebalance_date")).first()[0]
    two = market.schedule.rows.where(F.col("rebalance_date") >= F.lit(first)).orderBy("rebalance_date").limit(2)
    short = replace(market, schedule=Schedule(materialize(two, "two"), 2))
    assert short.rule_weights.select("rebalance_date").distinct().count() == 1
    assert "fewer than two" in named.multi_objective(short).first().error
    assert "fewer than two" in named.liquidity(short, 1e5).first().error
    assert "fewer than two" in named.risk_attribution(short).first().error
    assert "is not one of" in named.risk_attribution(market, "nope").first().error
    assert "trading rows" in named.multi_objective(market.with_settings(lookback=market.cal.n)).first().error


def test_top_names_are_pruned_before_the_shuffle(market):
    plan = plan_of(B.top_by_cap(market.members, market.start_caps, 5))
    assert plan.count("WindowGroupLimit") == 2


def test_alternative_settings(market):
    late = market.with_settings(liquidity_as_of="rebalance", vol_basis="daily")
    costs = late.costs_of(market.rule_weights)
    assert costs.where("cost_fraction IS NULL").count() == 0 and costs.agg(F.max("cost_fraction")).first()[0] > 0
    bridged = market.with_settings(bridge_gaps=True)
    assert bridged.benchmark_values.count() == market.benchmark_values.count()
    assert bridged.benchmark_returns.where("ret = 0").count() < market.benchmark_returns.where("ret = 0").count()
    uncharged = market.with_settings(adjust_benchmark=False)
    own = uncharged.all_adjusted.where("strategy = 'full_replication'")
    assert own.where("ret <> gross_ret").count() == 0
    assert market.all_adjusted.where("strategy = 'full_replication' AND ret <> gross_ret").count() > 0


def test_comparison_records_its_settings(market):
    table = named.full_comparison(market.with_settings(n_resamples=20))
    row = table.first()
    assert row.settings["embargo"] == str(MONTHLY.embargo) and row.settings["n_resamples"] == "20"
    assert {r[0] for r in table.select("strategy").distinct().collect()} <= {*named.STRATEGIES, "full_replication"}


def test_query_parameters_are_checked(market):
    assert "is not one of" in named.backtest_bootstrap(market, "nope").first().error
    with pytest.raises(ValueError):
        named.backtest_bootstrap(market, "quality", n_resamples=5001)
    with pytest.raises(ValueError):
        named.liquidity(market, aum=0)


def test_own_tables_with_class_symbols(spark):
    rng = np.random.default_rng(8)
    dates, names = days(420, "2019-06-03"), ["AA", "BRK-B", "CC", "DD", "EE", "FF"]
    walk = {n: (100 * np.cumprod(1 + rng.normal(0.0004, 0.01, 420))).tolist() for n in names}
    prices = spark.createDataFrame([(n, d, c, 1e6) for n in names for d, c in zip(dates, walk[n])], "symbol STRING, date DATE, close DOUBLE, volume DOUBLE")
    m = build_market(
        prices,
        spark.createDataFrame([(n.replace("-", "."), "x" if i % 2 else "y") for i, n in enumerate(names)], "symbol STRING, gics_sector STRING"),
        spark.createDataFrame([(dt.date(2020, 8, 3), "FF", "AA")], "effective_date DATE, added_ticker STRING, removed_ticker STRING"),
        spark.createDataFrame([(n, dates[0], 1e6 * (i + 1)) for i, n in enumerate(names)], "symbol STRING, filing_date DATE, shares DOUBLE"),
        spark.createDataFrame([(n, 0.1 * i, 0.2, 1.0, float(i), 5.0 + i) for i, n in enumerate(names)],
                              "symbol STRING, returnOnEquity DOUBLE, profitMargins DOUBLE, earningsGrowth DOUBLE, debtToEquity DOUBLE, trailingEps DOUBLE"),
        spark.createDataFrame([("IX", d, float(1000 + i)) for i, d in enumerate(dates)], "ticker STRING, date DATE, close DOUBLE"),
        "2019-09-01", "2020-12-31", settings=Settings(ic_min_names=4, lookback=60, max_weight=0.5, momentum_lookback=60, low_vol_window=30, aums=(1e5,), n_resamples=30),
    )
    members = m.members.where("rebalance_date < '2020-08-03'")
    assert members.where("symbol = 'BRK-B'").count() > 0 and members.where("symbol = 'FF'").count() == 0
    table = as_dict(named.smartbeta(m).select("strategy", "annualized_vol"), "strategy")
    assert set(table) == set(named.STRATEGIES) and min(table.values()) == pytest.approx(table["min_vol"])
    curve = named.replication_sampling(m, "3,5").collect()
    assert {r.method for r in curve} == {"stratified", "optimization", "lasso"}
    full = [r.mean_tracking_error for r in curve if r.method == "optimization"]
    assert all(x < 0.2 for x in full)
    assert named.risk_kill_switch(m, 1e5).count() == 4
