"""Streaming risk-limit monitor over strategy-day returns.

Rows are buffered per strategy until the watermark passes their day and then taken in
date order, because relative drawdown depends on the path. Rows of one timestamp are all
kept: resets come first, the rest in order of arrival. A row without both returns moves
no figure (its reset still counts); a return of -100 % or less is an error, as it is in
the batch form. State per strategy is a handful of running numbers; rows older than the
watermark are dropped by Spark, and ``LateRows`` turns their number into a result row per batch.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from basketry.operators.risk import check_limits

INPUT = "strategy STRING, ts TIMESTAMP, ret DOUBLE, bench_ret DOUBLE, reset BOOLEAN"
OUTPUT = (
    "strategy STRING, ts TIMESTAMP, tracking_error DOUBLE, max_relative_drawdown DOUBLE, te_breached BOOLEAN, "
    "drawdown_breached BOOLEAN, reset BOOLEAN, triggered BOOLEAN, reasons STRING"
)
RUNNING = "n BIGINT, mean DOUBLE, m2 DOUBLE, value DOUBLE, peak DOUBLE, max_dd DOUBLE, reasons STRING"
PENDING_KEY = "ts BIGINT, seq BIGINT"
PROGRESS = "arrived BIGINT, swept BIGINT"
PENDING = "ret DOUBLE, bench_ret DOUBLE, reset BOOLEAN"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LimitMonitor(StatefulProcessor):
    """Sticky limit switch of one strategy; ``changes_only`` emits a row when the flag or its reasons change."""

    def __init__(self, te_limit: float, drawdown_limit: float, periods_per_year: float, changes_only: bool):
        self.te_limit, self.drawdown_limit = te_limit, drawdown_limit
        self.periods, self.changes_only = periods_per_year, changes_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", RUNNING)
        self.pending = handle.getMapState("pending", PENDING_KEY, PENDING)
        self.progress = handle.getValueState("progress", PROGRESS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived, swept = self.progress.get() if self.progress.exists() else (0, -1)
        for pdf in rows:
            for row in pdf.itertuples(index=False):
                at = int(pd.Timestamp(row.ts).timestamp() * 1000)
                known = not (pd.isna(row.ret) or pd.isna(row.bench_ret))
                if known and (row.ret <= -1 or row.bench_ret <= -1):
                    raise ValueError(f"{key[0]} at {row.ts}: a relative value needs returns above -100 %")
                values = (float(row.ret), float(row.bench_ret)) if known else (None, None)
                self.pending.updateValue((at, arrived), (*values, False if pd.isna(row.reset) else bool(row.reset)))
                self.handle.registerTimer(at)
                arrived += 1
        self.progress.update((arrived, swept))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Timers of a key fire in any order; the first takes every row the watermark has passed, the others find it done."""
        passed = timerValues.getCurrentWatermarkInMs()
        arrived, swept = self.progress.get()
        out = []
        if passed > swept:
            self.progress.update((arrived, passed))
            due = [(k[0], not v[2], k[1], tuple(v)) for k, v in self.pending.iterator() if k[0] <= passed]
            state = self.running.get() if self.running.exists() else (0, 0.0, 0.0, 1.0, 1.0, 0.0, "")
            for at, _, seq, row in sorted(due, key=lambda d: d[:3]):
                self.pending.removeKey((at, seq))
                state, emitted, changed = self.step(tuple(state), *row)
                if changed or not self.changes_only:
                    when = dt.datetime.fromtimestamp(at / 1000, dt.timezone.utc).replace(tzinfo=None)
                    out.append((key[0], when, *emitted))
            self.running.update(tuple(state))
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        yield pd.DataFrame(out, columns=names) if out else pd.DataFrame()

    def step(self, state, ret, bench_ret, reset):
        n, mean, m2, value, peak, max_dd, reasons = state
        before = reasons
        known = ret is not None and bench_ret is not None
        if known:
            n += 1
            gap = (ret - bench_ret) - mean
            mean += gap / n
            m2 += gap * ((ret - bench_ret) - mean)
            value *= (1 + ret) / (1 + bench_ret)
            peak = max(peak, value)
            max_dd = max(max_dd, 1 - value / peak)
        te = math.sqrt(m2 / (n - 1) * self.periods) if n > 1 else None
        # A row that only resets is not judged again.
        fired = [] if not known else [name for name, hit in (
            ("tracking_error", te is not None and te > self.te_limit), ("relative_drawdown", max_dd > self.drawdown_limit)
        ) if hit]
        held = [] if reset or not reasons else reasons.split(",")
        reasons = ",".join([*held, *[name for name in fired if name not in held]])
        emitted = (te, max_dd, "tracking_error" in fired, "relative_drawdown" in fired, reset, bool(reasons), reasons)
        return (n, mean, m2, value, peak, max_dd, reasons), emitted, reasons != before

    def close(self) -> None:
        pass


def monitor(
    stream: DataFrame, delay: str = "2 days", te_limit: float = 0.05, drawdown_limit: float = 0.10, periods_per_year: float = 252,
    changes_only: bool = True,
) -> DataFrame:
    """Attach the monitor to a stream with the ``INPUT`` columns; needs the RocksDB state store."""
    check_limits(te_limit, drawdown_limit)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # The worker that initialises a processor does not see shipped archives, so the class travels with its code.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return (
        stream.withWatermark("ts", delay).groupBy("strategy")
        .transformWithStateInPandas(
            LimitMonitor(te_limit, drawdown_limit, periods_per_year, changes_only), OUTPUT, "Append", "EventTime"
        )
    )


LATE = "query STRING, batch BIGINT, watermark STRING, n_rows BIGINT, n_late BIGINT"


class LateRows(StreamingQueryListener):
    """Listens to queries and keeps, for each of their batches, the rows read and those that came behind the watermark.

    A batch that is run again after a failure reports anew and replaces its earlier line.
    """

    def __init__(self):
        self.batches: dict[tuple[str, int], tuple] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        self.batches[str(p.id), p.batchId] = (str(p.id), p.batchId, (p.eventTime or {}).get("watermark"), int(p.numInputRows), int(late))

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def heard(self, query, seconds: float = 60.0) -> list[tuple]:
        """The lines of an ended query; its last events may still be on their way."""
        until = time.time() + seconds
        while str(query.runId) not in self.ended:
            if time.time() > until:
                raise TimeoutError("the query's last events have not arrived")
            time.sleep(0.05)
        return sorted(line for (q, _), line in self.batches.items() if q == str(query.id))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch: ``(query, batch, watermark, n_rows, n_late)``; a batch reported twice counts once."""
    lines = spark.read.schema(LATE).parquet(path)
    return lines.groupBy("query", "batch").agg(*[F.max(c).alias(c) for c in ("watermark", "n_rows", "n_late")])


def run_available(
    spark: SparkSession, source: str, target: str, checkpoint: str, late: str | None = None, files_per_batch: int | None = None, **options
) -> DataFrame:
    """Process everything new under ``source`` and return all that ``target`` holds; ``late`` is a folder for the lines
    of ``LateRows``, written even when a batch fails."""
    reader = spark.readStream.schema(INPUT)
    stream = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(source)
    listener = LateRows()
    if late is not None:
        spark.streams.addListener(listener)
    try:
        query = (
            monitor(stream, **options).writeStream.format("parquet").option("path", target)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
        try:
            query.awaitTermination()
        finally:
            if late is not None and (lines := listener.heard(query)):
                spark.createDataFrame(lines, LATE).coalesce(1).write.mode("append").parquet(late)
    finally:
        if late is not None:
            spark.streams.removeListener(listener)
    return spark.read.schema(OUTPUT).parquet(target)


def write_feed(returns: DataFrame, path: str) -> None:
    """Append batch returns ``strategy, date, ret, bench_ret, reset`` as feed files."""
    returns.select("strategy", F.col("date").cast("timestamp").alias("ts"), "ret", "bench_ret", "reset").write.mode("append").parquet(path)


def write_heartbeat(spark: SparkSession, path: str, at: str) -> None:
    """Append one row of a strategy of its own that moves the watermark, so that days before ``at`` are released."""
    spark.range(1).select(
        F.lit("heartbeat").alias("strategy"), F.lit(at).cast("timestamp").alias("ts"), F.lit(0.0).alias("ret"),
        F.lit(0.0).alias("bench_ret"), F.lit(False).alias("reset"),
    ).write.mode("append").parquet(path)
