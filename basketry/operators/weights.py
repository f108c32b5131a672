"""Portfolio weights that need no fitting: long ``(rebalance_date, symbol, weight)`` summing to one per rebalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from basketry.functions.columns import clip
from basketry.sizing import Schedule, position_in_group, share_of_group

SCORE_CLIP = 3.0
TILT_STRENGTH = 0.5
KEYS = ["rebalance_date"]
OUT = ["rebalance_date", "symbol", "weight"]


def tradeable(members: DataFrame, start_rows: DataFrame, value: str) -> DataFrame:
    """Members whose ``value`` on the segment's first trading row is present and positive."""
    return start_rows.where(F.col(value) > 0).join(members, ["rebalance_date", "symbol"], "left_semi")


def cap_weights(members: DataFrame, start_caps: DataFrame, schedule: Schedule) -> DataFrame:
    held = tradeable(members, start_caps, "market_cap").select("rebalance_date", "symbol", "market_cap")
    return share_of_group(held, KEYS, "market_cap", schedule.n).select(*OUT)


def equal_weights(members: DataFrame, start_prices: DataFrame, schedule: Schedule) -> DataFrame:
    held = tradeable(members, start_prices, "close").select("rebalance_date", "symbol", F.lit(1.0).alias("one"))
    return share_of_group(held, KEYS, "one", schedule.n).select(*OUT)


def quality_weights(members: DataFrame, scores: DataFrame, schedule: Schedule) -> DataFrame:
    """Proportional to ``exp`` of the clipped score over scored members; a quote is not required.

    Scores are per symbol, or per rebalance and symbol.
    """
    keys = [c for c in KEYS if c in scores.columns] + ["symbol"]
    held = members.join(scores.where("score IS NOT NULL").select(*keys, "score"), keys).withColumn(
        "raw", F.exp(clip("score", -SCORE_CLIP, SCORE_CLIP))
    )
    return share_of_group(held, KEYS, "raw", schedule.n).select(*OUT)


def tilt_weights(
    members: DataFrame, composite: DataFrame, start_caps: DataFrame, schedule: Schedule, strength: float = TILT_STRENGTH
) -> DataFrame:
    """Cap weights multiplied by ``exp(strength * clipped composite)`` and renormalised."""
    held = (
        tradeable(members, start_caps, "market_cap").select("rebalance_date", "symbol", "market_cap")
        .join(composite.where("composite IS NOT NULL").select("rebalance_date", "symbol", "composite"), ["rebalance_date", "symbol"])
        .withColumn("raw", F.col("market_cap") * F.exp(F.lit(float(strength)) * clip("composite", -SCORE_CLIP, SCORE_CLIP)))
    )
    return share_of_group(held, KEYS, "raw", schedule.n).select(*OUT)


def top_by_cap(members: DataFrame, start_caps: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest tradeable members per rebalance, ties by symbol.

    ``row_number() <= n`` is pruned to ``n`` rows per group inside every task before
    the shuffle, so the final sort sees few rows however large the universe is.
    """
    order = W.partitionBy(*KEYS).orderBy(F.desc("market_cap"), "symbol")
    return (
        tradeable(members, start_caps, "market_cap").select("rebalance_date", "symbol", "market_cap")
        .withColumn("cap_rank", F.row_number().over(order)).where(F.col("cap_rank") <= n)
        .withColumn("cap_rank", F.col("cap_rank").cast("bigint"))
    )


def size_tier(rank0: Column, n: Column, k: Column) -> Column:
    """Quantile-bin tier of a zero-based rank among ``n`` when cut into ``k`` bins.

    Counts the interior bin edges below the rank. Edges are interpolated positions
    ``q * (n - 1)``, computed in the same double steps as a quantile binner so that
    ranks on an edge fall on the same side.
    """
    def edge(j: Column) -> Column:
        at = ((j * (F.lit(1.0) / k)) * F.lit(100.0) / F.lit(100.0)) * (n - 1)
        lo = F.floor(at).cast("double")
        hi = F.least(lo + 1, (n - 1).cast("double"))
        frac = at - lo
        return F.when(frac < 0.5, lo + frac * (hi - lo)).otherwise(hi - (1 - frac) * (hi - lo))

    edges = F.when(k > 1, F.transform(F.sequence(F.lit(1), (k - 1).cast("int")), edge)).otherwise(
        F.array().cast("array<double>")
    )
    return F.size(F.filter(edges, lambda e: rank0 > e)).cast("bigint")


def buckets_per_sector(members: DataFrame, sectors: DataFrame, n: int | list[int]) -> DataFrame:
    """``(rebalance_date[, target_n], k)`` with ``k = max(1, n / sectors present)``, rounded half to even."""
    present = (
        members.join(sectors.where("gics_sector IS NOT NULL").select("symbol", "gics_sector"), "symbol")
        .groupBy("rebalance_date").agg(F.countDistinct("gics_sector").alias("_sectors"))
    )
    per = lambda target: F.greatest(F.lit(1), F.bround(target / F.greatest(F.col("_sectors"), F.lit(1)))).cast("bigint").alias("k")
    if isinstance(n, int):
        return present.select("rebalance_date", per(F.lit(float(n))))
    grid = present.select("rebalance_date", "_sectors", F.explode(F.array(*[F.lit(t) for t in n]).cast("array<bigint>")).alias("target_n"))
    return grid.select("rebalance_date", "target_n", per(F.col("target_n").cast("double")))


def size_buckets(
    members: DataFrame, start_caps: DataFrame, sectors: DataFrame, buckets: DataFrame, schedule: Schedule,
    n_symbols: int | None,
) -> DataFrame:
    """Tradeable members with a known sector, labelled by sector and size tier (0 = largest)."""
    held = (
        tradeable(members, start_caps, "market_cap").select("rebalance_date", "symbol", "market_cap")
        .join(sectors.where("gics_sector IS NOT NULL").select("symbol", "gics_sector"), "symbol")
    )
    placed = position_in_group(
        held, ["rebalance_date", "gics_sector"], [F.desc("market_cap"), F.col("symbol")], n_symbols
    )
    k = F.least("k", "n")
    extra = [c for c in buckets.columns if c not in ("rebalance_date", "k")]
    return placed.join(schedule.hint(buckets, 64), "rebalance_date").select(
        "rebalance_date", *extra, "gics_sector", "symbol", "market_cap", size_tier(F.col("rank0"), F.col("n"), k).alias("tier")
    )


def stratified_weights(bucketed: DataFrame, schedule: Schedule, keys: tuple[str, ...] = ("rebalance_date",)) -> DataFrame:
    """The largest name of each bucket carries the bucket's whole cap; ties by symbol."""
    reps = bucketed.groupBy(*keys, "gics_sector", "tier").agg(
        F.min_by("symbol", F.struct(-F.col("market_cap"), F.col("symbol"))).alias("symbol"),
        F.sum("market_cap").alias("bucket_cap"),
    )
    return share_of_group(reps, list(keys), "bucket_cap", schedule.n * 64).select(*keys, "symbol", "weight")
