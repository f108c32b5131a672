"""Exact quantiles of everything seen so far, for every row of a long series.

The rows of a series are cut into blocks by time and into slices by value, each of about the root of the series' length.
Counts of each slice before each block are running sums; within a block they go on row by row. They tell in which slice an
order statistic lies and at which place there, and the slice's own rows give its value. A series of n rows costs n to the
power 1.5, spread over root n tasks of root n rows; no task holds a series.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from basketry.session import materialize
from basketry.sizing import TASK_ROWS, position_in_group


def running_quantiles(
    df: DataFrame, key: str, order: str, value: str, probs: Mapping[str, float], rows_bound: int | None, task_rows: int = TASK_ROWS
) -> DataFrame:
    """``(key, order, n_seen, *names)``: interpolated quantiles of ``value`` over the rows of ``key`` up to each ``order``.

    Rows without a value are left out; ``order`` has no ties within a key. ``rows_bound`` is a proven bound on rows a key.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    timed = position_in_group(known, ["k"], [F.col("o")], rows_bound, "t", task_rows).select("k", "o", "v", "t", "n")
    ranked = position_in_group(timed.drop("n"), ["k"], [F.col("v"), F.col("t")], rows_bound, "r", task_rows)
    longest = known.groupBy("k").count().agg(F.max("count")).first()[0] or 1
    size = max(1, math.isqrt(longest - 1) + 1)
    cells = materialize(
        ranked.select("k", "o", "v", "t", "n", F.floor(F.col("t") / size).alias("block"), F.floor(F.col("r") / size).alias("slice"), "r"), "cells"
    )
    # Rows of each slice before each block: a grid of as many cells as the series has rows.
    last = F.floor((F.col("n") - 1) / size)
    grid = cells.select("k", "n").distinct().select("k", F.explode(F.sequence(F.lit(0), last)).alias("block"), last.alias("_last"))
    grid = grid.select("k", "block", F.explode(F.sequence(F.lit(0), "_last")).alias("slice"))
    counts = grid.join(cells.groupBy("k", "block", "slice").agg(F.count(F.lit(1)).alias("c")), ["k", "block", "slice"], "left")
    earlier = F.coalesce(F.sum("c").over(W.partitionBy("k", "slice").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("k", "block", "slice", earlier.alias("c")).groupBy("k", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("slice", "c"))), lambda x: x["c"]).alias("before")
    )
    before = materialize(before, "before")  # keeps the two sides of the cogroup apart
    names = list(probs)
    wanted = np.array([probs[x] for x in names])

    def place(members: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("t")
        t, own = members["t"].to_numpy(), members["slice"].to_numpy()
        below = np.array(start["before"].iloc[0])
        seen = np.cumsum(below + np.cumsum(np.arange(len(below)) == own[:, None], axis=0), axis=1)  # rows x slices
        at = wanted * t[:, None]  # place of the quantile among the t + 1 values seen
        rank = np.stack([np.floor(at), np.ceil(at)], axis=2).reshape(len(t), -1).astype(np.int64)
        found = np.stack([np.searchsorted(row, need, side="right") for row, need in zip(seen, rank)])
        first = np.take_along_axis(np.concatenate([np.zeros((len(t), 1), np.int64), seen], axis=1), found, axis=1)
        shape = (len(t), len(wanted), 2)
        numbers = np.broadcast_to(np.arange(len(wanted))[None, :, None], shape)
        shares = np.broadcast_to((at - np.floor(at))[:, :, None], shape)
        return pd.DataFrame({
            "k": members["k"].iloc[0], "t": np.repeat(t, 2 * len(wanted)), "q": numbers.ravel(), "upper": np.broadcast_to([False, True], shape).ravel(),
            "share": shares.ravel(), "slice": found.ravel(), "inner": (rank - first).ravel(),
        })

    kind = cells.schema["k"].dataType.simpleString()
    schema = f"k {kind}, t long, q long, upper boolean, share double, slice long, inner long"
    asked = cells.select("k", "t", "block", "slice").groupBy("k", "block").cogroup(before.groupBy("k", "block")).applyInPandas(place, schema)
    slices = cells.groupBy("k", "slice").agg(F.sort_array(F.collect_list(F.struct("r", "t", "v"))).alias("members"))
    # One row for each slice; a slice that many rows ask for is met by a join that Spark may split or broadcast.
    told = asked.join(slices, ["k", "slice"]).select("k", "t", "q", "upper", "share", F.get(F.filter("members", lambda m: m["t"] <= F.col("t")), F.col("inner").cast("int"))["v"].alias("v"))
    weight = F.when(F.col("upper"), F.col("share")).otherwise(1 - F.col("share"))
    sums = told.groupBy("k", "t").agg(*[F.sum(F.when(F.col("q") == i, weight * F.col("v"))).alias(x) for i, x in enumerate(names)])
    return cells.join(sums, ["k", "t"]).select(F.col("k").alias(key), F.col("o").alias(order), (F.col("t") + 1).alias("n_seen"), *names)
