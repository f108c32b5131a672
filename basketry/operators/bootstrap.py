"""Circular block bootstrap of return series, paired with a benchmark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from basketry.operators import stats

METRICS = ("cagr", "sharpe_ratio", "sortino_ratio", "max_drawdown", "win_rate", "tracking_error")
CHUNK = 50  # resamples per task row


def block_start(resample: Column, block: Column, n: Column, seed: int = 42, source: str = "hash") -> Column:
    """Start of one block, uniform on ``[0, n)``.

    ``hash`` is the default; ``lcg`` is integer arithmetic that SQL engines reproduce.
    """
    if source == "hash":
        return F.pmod(F.xxhash64(F.lit(seed), resample.cast("bigint"), block.cast("bigint")), n.cast("bigint"))
    mixed = resample.cast("bigint") * F.lit(1103515245).cast("bigint") + block.cast("bigint") * F.lit(12345) + F.lit(seed)
    return (mixed % F.lit(2147483647).cast("bigint")) % n.cast("bigint")


def collect_series(pairs: DataFrame, by: Sequence[str], order: str = "date") -> DataFrame:
    """One row per series: ``n`` and the return arrays in order. A series is bounded by its calendar."""
    bench = F.col("bench_ret") if "bench_ret" in pairs.columns else F.lit(None).cast("double")
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("ret").alias("r"), bench.alias("b"))))
    out = pairs.where("ret IS NOT NULL").groupBy(*by).agg(ordered.alias("_s"))
    return out.select(*by, F.size("_s").cast("bigint").alias("n"), F.col("_s.r").alias("rets"), F.col("_s.b").alias("bench"))


def resample_indices(series: DataFrame, by: Sequence[str], block_length: int, n_resamples: int, seed: int = 42, source: str = "hash") -> DataFrame:
    """``(by..., resample, k, idx)``: position ``k`` of a resample takes observation ``idx``."""
    blocks = F.ceil(F.col("n") / block_length).cast("bigint")
    grid = series.select(
        *by, "n", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1)).cast("array<bigint>")).alias("resample")
    ).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"))
    starts = grid.withColumn("_start", block_start(F.col("resample"), F.col("block"), F.col("n"), seed, source))
    placed = starts.select(
        *by, "n", "resample", "block", "_start", F.explode(F.sequence(F.lit(0), F.lit(block_length - 1)).cast("array<bigint>")).alias("offset")
    )
    return placed.select(
        *by, "resample", (F.col("block") * block_length + F.col("offset")).alias("k"),
        ((F.col("_start") + F.col("offset")) % F.col("n")).alias("idx"), "n",
    ).where("k < n").drop("n")


def resample_rows(pairs: DataFrame, by: Sequence[str], block_length: int, n_resamples: int, order: str = "date", seed: int = 42, source: str = "hash") -> DataFrame:
    """Resampled observations as rows; both series of a pair use the same indices."""
    series = collect_series(pairs, by, order)
    picks = resample_indices(series, by, block_length, n_resamples, seed, source)
    values = series.select(*by, F.posexplode(F.arrays_zip("rets", "bench")).alias("i", "v")).select(
        *by, F.col("i").cast("bigint").alias("idx"), F.col("v.rets").alias("ret"), F.col("v.bench").alias("bench_ret")
    )
    return picks.join(values, [*by, "idx"]).select(*by, "resample", "k", "idx", "ret", "bench_ret")


def _path_metrics(r: np.ndarray, b: np.ndarray | None, periods: float) -> dict[str, np.ndarray]:
    """Metrics of every row of ``r`` (resamples x days)."""
    def annual(mean, std):
        return np.where(std < stats.ZERO_VOL, np.nan, mean / std) * np.sqrt(periods)

    n = r.shape[1]
    curve = np.cumprod(1.0 + r, axis=1)
    final = curve[:, -1]
    mean = r.mean(axis=1)
    down = np.where(r < 0, r, np.nan)
    with np.errstate(all="ignore"):
        n_down = (r < 0).sum(axis=1)
        centre = np.nansum(down, axis=1) / n_down
        down_std = np.sqrt(np.nansum((down - centre[:, None]) ** 2, axis=1) / (n_down - 1.0))
        out = {
            "cagr": np.where(final >= 0, np.abs(final) ** (periods / (n + 1)) - 1, np.nan),
            "sharpe_ratio": annual(mean, r.std(axis=1, ddof=1)),
            "sortino_ratio": np.where(n_down >= 2, annual(mean, down_std), np.nan),
            "max_drawdown": (1 - curve / np.maximum(np.maximum.accumulate(curve, axis=1), 1.0)).max(axis=1),
            "win_rate": (r > 0).mean(axis=1),
        }
        out["tracking_error"] = (
            (r - b).std(axis=1, ddof=1) * np.sqrt(periods) if b is not None else np.full(len(r), np.nan)
        )
    return out


def resampled_metrics(
    pairs: DataFrame, by: Sequence[str], block_length: int = 20, n_resamples: int = 2000, order: str = "date",
    seed: int = 42, source: str = "hash", periods_per_year: float = 252, on_short: str = "error",
) -> DataFrame:
    """``(by..., resample, metrics...)``, one row per resampled path.

    Paths are never rows in a shuffle: a task row holds one series and the block starts
    of ``CHUNK`` resamples, and the path metrics are array arithmetic inside the task.
    """
    by = list(by)
    series = collect_series(pairs, by, order)
    if on_short == "error":
        short = F.format_string("a block of %d returns does not fit a series of %d", F.lit(block_length), F.col("n"))
        series = series.withColumn("n", F.when(F.col("n") < block_length, F.raise_error(short).cast("bigint")).otherwise(F.col("n")))
    else:
        series = series.where(F.col("n") >= block_length)
    chunks = -(-n_resamples // CHUNK)
    blocks = F.ceil(F.col("n") / block_length).cast("bigint")
    resamples = F.sequence(
        F.col("chunk") * CHUNK, F.least(F.col("chunk") * CHUNK + CHUNK, F.lit(n_resamples)).cast("bigint") - 1
    )
    tasks = series.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")).alias("chunk"))
    starts = F.flatten(F.transform(resamples, lambda r: F.transform(
        F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda b: block_start(r, b, F.col("n"), seed, source)
    )))
    # A given number of parts: rows so few and small would else be put together in one task that does all the arithmetic.
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = tasks.withColumn("starts", starts).repartition(parts, *by, "chunk")

    paired = "bench_ret" in pairs.columns
    schema = StructType([series.schema[c] for c in by]).add("resample", LongType())
    for name in METRICS:
        schema = schema.add(name, DoubleType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets = np.arange(block_length)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n = int(row.n)
                first = np.asarray(row.starts).reshape(-1, -(-n // block_length))
                idx = ((first[:, :, None] + offsets) % n).reshape(len(first), -1)[:, :n]
                bench = np.asarray(row.bench, dtype=float)[idx] if paired else None
                out = _path_metrics(np.asarray(row.rets, dtype=float)[idx], bench, periods_per_year)
                ids = int(row.chunk) * CHUNK + np.arange(len(first))
                yield pd.DataFrame({**{c: getattr(row, c) for c in by}, "resample": ids, **out})

    raw = tasks.mapInPandas(run, schema)
    return raw.withColumns({m: F.nanvl(m, F.lit(None).cast("double")) for m in METRICS})


def bootstrap_metrics(
    pairs: DataFrame, by: Sequence[str], block_length: int = 20, n_resamples: int = 2000, confidence: float = 0.95,
    order: str = "date", seed: int = 42, source: str = "hash", periods_per_year: float = 252, on_short: str = "error",
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """``(by..., metric, point_estimate, ci_low, ci_high, n_resamples, confidence_level)``.

    Intervals are interpolated percentiles of the resampled metrics, nulls left out.
    """
    by = list(by)
    paired = "bench_ret" in pairs.columns
    names = [m for m in metrics if paired or m != "tracking_error"]
    point = stats.performance(pairs, by, order, periods_per_year)
    if paired:
        point = point.join(stats.tracking_error(pairs, by, periods_per_year), by)
    tail = (1 - confidence) / 2
    drawn = resampled_metrics(pairs, by, block_length, n_resamples, order, seed, source, periods_per_year, on_short)
    bounds = drawn.groupBy(*by).agg(
        *[F.percentile(m, F.array(F.lit(tail), F.lit(1 - tail))).alias(f"_ci_{m}") for m in names]
    )
    cells = F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.col(m).alias("point_estimate"), F.col(f"_ci_{m}")[0].alias("ci_low"),
            F.col(f"_ci_{m}")[1].alias("ci_high"),
        ) for m in names
    ])
    return (
        point.join(bounds, by).select(*by, F.explode(cells).alias("c")).select(*by, "c.*")
        .withColumn("n_resamples", F.lit(n_resamples).cast("bigint")).withColumn("confidence_level", F.lit(float(confidence)))
    )
