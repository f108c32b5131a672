"""Liquidity inputs, market-impact trading costs, turnover and cost-adjusted returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from basketry.functions.columns import impact_fraction, ratio
from basketry.operators.calendar import as_of
from basketry.operators.regime import rolling_vol
from basketry.sizing import Calendar, small

MIN_TRADE = 1e-12
MIN_HOLDING = 1e-8


def dollar_volume(prices: DataFrame, cal: Calendar, window: int = 63) -> DataFrame:
    """``(symbol, adv)``: mean close x volume over the last ``window`` calendar rows, nulls skipped."""
    recent = prices.where(F.col("pos") > cal.last - window)
    return recent.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"))


def latest_vol(
    prices: DataFrame, cal: Calendar, window: int = 21, periods_per_year: float = 252, last_valid: bool = False,
    basis: str = "annual",
) -> DataFrame:
    """``(symbol, vol)``: realised volatility on the last calendar row, or the last valid one.

    ``basis='annual'`` passes the annualised figure to the cost model as published;
    ``'daily'`` gives the per-period volatility the square-root law is stated in.
    """
    vols = rolling_vol(prices.select("symbol", "pos", "close"), "symbol", window, periods_per_year if basis == "annual" else 1)
    if last_valid:
        return vols.groupBy("symbol").agg(F.max_by("vol", F.when(F.col("vol").isNotNull(), F.col("pos"))).alias("vol"))
    return vols.where(F.col("pos") == cal.last).select("symbol", "vol")


def liquidity_at_end(prices: DataFrame, cal: Calendar, volume_window: int = 63, vol_window: int = 21, periods_per_year: float = 252, last_valid: bool = False, basis: str = "annual") -> DataFrame:
    """``(symbol, vol, adv)`` measured once at the end of the sample."""
    return latest_vol(prices, cal, vol_window, periods_per_year, last_valid, basis).join(
        dollar_volume(prices, cal, volume_window), "symbol", "full_outer"
    )


def liquidity_at_rebalance(
    prices: DataFrame, segments: DataFrame, cal: Calendar, volume_window: int = 63, vol_window: int = 21,
    periods_per_year: float = 252, basis: str = "annual",
) -> DataFrame:
    """``(rebalance_date, symbol, vol, adv)`` from rows up to each rebalance, free of later data."""
    days = segments.select(
        "rebalance_date", F.col("sp"), F.explode(F.sequence(F.greatest(F.col("sp") - volume_window + 1, F.lit(0)), "sp")).alias("pos")
    )
    bound = cal.n * volume_window
    vols = rolling_vol(prices.select("symbol", "pos", "close", "volume"), "symbol", vol_window, periods_per_year if basis == "annual" else 1)
    return (
        vols.join(small(days, bound), "pos").groupBy("rebalance_date", "symbol")
        .agg(
            F.avg(F.col("close") * F.col("volume")).alias("adv"),
            F.max(F.when(F.col("pos") == F.col("sp"), F.col("vol"))).alias("vol"),
        )
    )


def weight_changes(weights: DataFrame, row_bound: int) -> DataFrame:
    """``(strategy, rebalance_date, symbol, weight, dw)`` against the previous held rebalance, the first from zero.

    Each weight is booked positively on its own date and negatively on the strategy's
    next held date, so one partially aggregated sum replaces a full outer join.
    """
    held = weights.select("strategy", "rebalance_date").distinct()
    following = held.withColumn("next_held", F.lead("rebalance_date").over(W.partitionBy("strategy").orderBy("rebalance_date")))
    booked = weights.join(small(following, row_bound), ["strategy", "rebalance_date"])
    entries = F.array(
        F.struct(F.col("rebalance_date").alias("d"), F.col("weight").alias("dw"), F.col("weight").alias("w")),
        F.struct(F.col("next_held").alias("d"), (-F.col("weight")).alias("dw"), F.lit(0.0).alias("w")),
    )
    return (
        booked.select("strategy", "symbol", F.explode(entries).alias("e")).where("e.d IS NOT NULL")
        .groupBy("strategy", F.col("e.d").alias("rebalance_date"), "symbol")
        .agg(F.sum("e.w").alias("weight"), F.sum("e.dw").alias("dw"))
    )


def turnover(changes: DataFrame, min_holding: float = MIN_HOLDING) -> DataFrame:
    """Per rebalance: holdings and two-way and one-way turnover."""
    return changes.groupBy("strategy", "rebalance_date").agg(
        F.count_if(F.abs("weight") > min_holding).alias("n_holdings"),
        F.sum(F.abs("dw")).alias("two_way_turnover"), (F.sum(F.abs("dw")) / 2).alias("one_way_turnover"),
    )


def portfolio_metadata(per_rebalance: DataFrame) -> DataFrame:
    """Mean holdings and mean one-way turnover, the establishing trade left out."""
    first = F.min("rebalance_date").over(W.partitionBy("strategy"))
    return (
        per_rebalance.withColumn("_first", first).groupBy("strategy").agg(
            F.avg("n_holdings").alias("name_count"),
            F.avg(F.when(F.col("rebalance_date") > F.col("_first"), F.col("one_way_turnover"))).alias("mean_one_way_turnover"),
        )
    )


def trade_costs(changes: DataFrame, liquidity: DataFrame, aums: Sequence[float], y: float = 1.0) -> DataFrame:
    """Per (strategy, rebalance, aum): cost fraction, dollar cost, and trades left out for want of liquidity.

    The square-root law makes a trade's cost fraction proportional to ``sqrt(aum)``, so
    the symbols are summed once at aum 1 and scaled, instead of repeating every trade
    per fund size.
    """
    keys = [k for k in ("rebalance_date", "symbol") if k in liquidity.columns]
    # Rows too small to trade stay in, costing nothing, so that every held rebalance gets a row.
    is_trade = F.abs("dw") >= MIN_TRADE
    unit = F.when(is_trade, impact_fraction("dw", "vol", "adv", y) * F.abs("dw"))
    full = changes.join(liquidity, keys, "left").groupBy("strategy", "rebalance_date").agg(
        F.coalesce(F.sum(unit), F.lit(0.0)).alias("_unit"), F.count(unit).alias("n_priced"),
        F.count_if(is_trade & unit.isNull()).alias("n_excluded"),
    )
    grid = full.withColumn("aum", F.explode(F.array(*[F.lit(float(a)) for a in aums])))
    fraction = F.when(F.col("aum") > 0, F.col("_unit") * F.sqrt("aum"))
    return grid.select(
        "strategy", "rebalance_date", "aum", fraction.alias("cost_fraction"),
        (F.col("aum") * fraction).alias("dollar_cost"), "n_priced", "n_excluded",
    )


def symbol_costs(changes: DataFrame, liquidity: DataFrame, aum: float, y: float = 1.0) -> DataFrame:
    """One row per trade: value, participation, cost; ``excluded`` marks unusable liquidity."""
    keys = [k for k in ("rebalance_date", "symbol") if k in liquidity.columns]
    traded = changes.where(F.abs("dw") >= MIN_TRADE).join(liquidity, keys, "left")
    value = F.col("dw") * float(aum)
    fraction = impact_fraction(value, "vol", "adv", y)
    return traded.select(
        "strategy", "rebalance_date", "symbol", value.alias("trade_value"),
        F.when(fraction.isNotNull(), F.abs(value) / F.col("adv")).alias("participation_rate"),
        fraction.alias("cost_fraction"), (F.abs(value) * fraction).alias("dollar_cost"), fraction.isNull().alias("excluded"),
    )


def apply_costs(returns: DataFrame, costs: DataFrame) -> DataFrame:
    """``(strategy, aum, pos, date, ret, gross_ret)``: each cost hits the first return day on or after its rebalance.

    Costs with no later return day are dropped; several on one day add up.
    """
    aums = costs.select("strategy", "aum").distinct()
    charged = as_of(
        costs.select("strategy", "aum", "rebalance_date", "cost_fraction"),
        returns.join(aums, "strategy").select("strategy", "aum", F.col("date").alias("hit_date")),
        "rebalance_date", "hit_date", ["hit_date"], by=["strategy", "aum"], direction="forward",
    ).where("hit_date IS NOT NULL").groupBy("strategy", "aum", F.col("hit_date").alias("date")).agg(
        F.sum("cost_fraction").alias("_cost")
    )
    return (
        returns.join(aums, "strategy").join(charged, ["strategy", "aum", "date"], "left")
        .select(
            "strategy", "aum", "pos", "date", (F.col("ret") - F.coalesce("_cost", F.lit(0.0))).alias("ret"),
            F.col("ret").alias("gross_ret"),
        )
    )


def mean_costs(costs: DataFrame) -> DataFrame:
    return costs.groupBy("strategy", "aum").agg(F.avg("cost_fraction").alias("mean_rebalance_cost_frac"))


def last_two_held(weights: DataFrame, strategy: str, skip_last: int = 0) -> DataFrame:
    """One row ``(t_prev, t_curr)``: the last two held rebalances of a strategy."""
    dates = weights.where(F.col("strategy") == strategy).select("rebalance_date").distinct()
    ranked = dates.withColumn("_r", F.row_number().over(W.orderBy(F.desc("rebalance_date"))) - skip_last)
    return ranked.where("_r IN (1, 2)").agg(
        F.max(F.when(F.col("_r") == 2, F.col("rebalance_date"))).alias("t_prev"),
        F.max(F.when(F.col("_r") == 1, F.col("rebalance_date"))).alias("t_curr"),
    )


def capacity_table(changes: DataFrame, costs: DataFrame, gross: DataFrame | None = None, min_holding: float = 1e-6) -> DataFrame:
    """Per (strategy, rebalance, aum): holdings, turnover, cost, yearly drag = 4 x cost, net return and its rank."""
    per = turnover(changes, min_holding).select("strategy", "rebalance_date", "n_holdings", F.col("two_way_turnover").alias("turnover"))
    out = costs.join(per, ["strategy", "rebalance_date"]).select(
        "strategy", "rebalance_date", "aum", "n_holdings", "turnover",
        F.col("cost_fraction").alias("rebalance_cost_fraction"), (4 * F.col("cost_fraction")).alias("annualized_cost_drag"),
    )
    if gross is None:
        return out
    net = F.col("gross_return") - F.col("annualized_cost_drag")
    ranked = F.row_number().over(W.partitionBy("rebalance_date", "aum").orderBy(F.desc("net_return"), "strategy"))
    return out.join(gross, "strategy").withColumn("net_return", net).withColumn("net_rank", ranked.cast("bigint"))


def two_way_between(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two-way turnover between two weight tables on the union of their symbols."""
    both = current.select(*keys, "symbol", F.col("weight").alias("dw")).unionByName(
        previous.select(*keys, "symbol", (-F.col("weight")).alias("dw"))
    )
    return both.groupBy(*keys, "symbol").agg(F.sum("dw").alias("dw")).groupBy(*keys).agg(F.sum(F.abs("dw")).alias("turnover"))
