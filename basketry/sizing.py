"""Size rules: what may be broadcast, and what may sit in one task.

Three axes bound everything in this domain. The calendar and the rebalance
schedule are counted when they are built, and so are the symbols. A table keyed
by date or rebalance therefore has a known row bound and may be broadcast; one
keyed by symbol never gets a forced broadcast, Spark decides from its statistics.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from basketry.session import materialize

BROADCAST_ROWS = 2_000_000   # rows of a few numbers each: tens of MB at most
TASK_ROWS = 1_000_000        # rows of one group that one task may sort


@dataclass(frozen=True)
class Calendar:
    """Trading calendar ``(pos, date)`` with its counted length."""

    rows: DataFrame
    n: int

    @property
    def last(self) -> int:
        return self.n - 1

    def hint(self, df: DataFrame, per_date: int = 1) -> DataFrame:
        return small(df, self.n * per_date)


@dataclass(frozen=True)
class Schedule:
    """Rebalance dates with a row bound known from the rule that made them."""

    rows: DataFrame
    n: int

    def hint(self, df: DataFrame, per_rebalance: int = 1) -> DataFrame:
        return small(df, self.n * per_rebalance)


def small(df: DataFrame, row_bound: int) -> DataFrame:
    """Broadcast ``df`` when its proven row bound is low, else leave it to a shuffle join."""
    return F.broadcast(df) if row_bound <= BROADCAST_ROWS else df


def share_of_group(df: DataFrame, keys: Sequence[str], value: str, group_bound: int, out: str = "weight") -> DataFrame:
    """``value`` divided by its group total; groups whose total is not positive vanish.

    The total is a partially aggregated ``groupBy`` joined back, not a window, so a
    group that holds a large part of the rows never lands in one task.
    """
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total")).where("_total > 0")
    joined = df.join(small(totals, group_bound), list(keys))
    return joined.withColumn(out, F.col(value) / F.col("_total")).drop("_total")


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], group_rows: int | None, out: str = "rank0",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Zero-based position of every row in its group plus the group size ``n``.

    ``group_rows`` is a proven bound on rows per group. Within ``task_rows`` a plain
    window does it. Beyond that (or unknown) the rows are range-partitioned by
    (keys, order) so that a large group spreads over many slices; a slice's offset
    is the sum of the sizes of the slices before it.
    """
    keys = list(keys)
    sizes = F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("n")
    if group_rows is not None and group_rows <= task_rows:
        local = W.partitionBy(*keys).orderBy(*order)
        return df.select("*", (F.row_number().over(local) - 1).cast("bigint").alias(out), sizes)

    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = materialize(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slice",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(W.partitionBy(*keys)).alias("n"),
    )
    local = W.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.join(offsets, [*keys, "_slice"])
        .withColumn(out, (F.col("_offset") + F.row_number().over(local) - 1).cast("bigint"))
        .drop("_slice", "_offset")
    )


def sum_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, group_rows: int | None, out: str, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Sum of ``value`` over the rows of the group that come before each row; ``order`` has no ties.

    A group beyond ``task_rows`` (or of unknown size) spreads over range slices, as in ``position_in_group``.
    """
    keys = list(keys)
    earlier = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    if group_rows is not None and group_rows <= task_rows:
        return df.withColumn(out, earlier(W.partitionBy(*keys).orderBy(*order)))
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = materialize(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    offsets = sums.select(*keys, "_slice", before.alias("_offset"))
    local = earlier(W.partitionBy(*keys, "_slice").orderBy(*order))
    return sliced.join(offsets, [*keys, "_slice"]).withColumn(out, F.col("_offset") + local).drop("_slice", "_offset")


def mean_rank_in_group(
    df: DataFrame, keys: Sequence[str], value: str, group_rows: int | None, out: str, task_rows: int = TASK_ROWS
) -> DataFrame:
    """One-based rank of ``value`` in its group, ties sharing the mean of their ranks; null values keep their row and get no rank."""
    keys = list(keys)
    if group_rows is not None and group_rows <= task_rows:
        # Lowest and highest rank of a tie share one window: the default frame ends with the current row's peers.
        in_order = W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        rank = (F.rank().over(in_order) + F.count(F.lit(1)).over(in_order)) / 2.0
        return df.withColumn(out, F.when(F.col(value).isNotNull(), rank))
    # Ties are collapsed first, so one repeated value cannot fill a slice.
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = materialize(
        distinct.repartitionByRange(parts, *keys, value).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    counts = sliced.groupBy(*keys, "_slice").agg(F.sum("_ties").alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    earlier = W.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.withColumnsRenamed({c: f"_o_{c}" for c in [*keys, "_slice"]})
    ranks = sliced.join(offsets, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*keys, "_slice"]])).select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], F.col(value).alias("_r_value"),
        (F.col("_offset") + F.coalesce(F.sum("_ties").over(earlier), F.lit(0)) + (F.col("_ties") + 1) / 2.0).alias(out),
    )
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]) & (F.col(value) == F.col("_r_value"))
    return df.join(ranks, on, "left").select(*df.columns, out)


def quantiles_in_group(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], group_rows: int | None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``."""
    keys = list(keys)
    valid = df.where(F.col(value).isNotNull())
    if group_rows is not None and group_rows <= task_rows:
        return valid.groupBy(*keys).agg(*[F.percentile(value, F.lit(float(p))).alias(c) for c, p in probs.items()])
    placed = position_in_group(valid.select(*keys, value), keys, [F.col(value)], group_rows, task_rows=task_rows)
    aggs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo = F.max(F.when(F.col("rank0") == F.floor(at), F.col(value)))
        hi = F.max(F.when(F.col("rank0") == F.ceil(at), F.col(value)))
        frac = F.max(at - F.floor(at))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return placed.groupBy(*keys).agg(*aggs)
