"""Nulls, shared timestamps, several indices, repeated keys, and plans without pair joins."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketry import sizing
from basketry.operators import membership, regime
from basketry.plans.market import Settings, build_market
from basketry.streaming import monitor as ST
from tests.helpers import days, schedule


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_values_get_no_rank_either_way(spark):
    rows = [("a", None), ("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("b", None), ("c", 5.0), (None, 3.0), (None, 4.0), (None, None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    found = [Counter(map(tuple, sizing.mean_rank_in_group(df, ["g"], "v", 100, "r", task_rows=n).collect())) for n in (1000, 1)]
    assert found[0] == found[1] == Counter([
        ("a", None, None), ("a", None, None), ("a", 1.0, 1.0), ("a", 2.0, 2.5), ("a", 2.0, 2.5), ("b", None, None), ("c", 5.0, 1.0),
        (None, 3.0, 1.0), (None, 4.0, 2.0), (None, None, None),
    ])
    empty = df.limit(0)
    assert all(sizing.mean_rank_in_group(empty, ["g"], "v", 100, "r", task_rows=n).count() == 0 for n in (1000, 1))


def feed(spark, path, rows):
    spark.createDataFrame(rows, ST.INPUT).write.parquet(f"{path}/feed")
    run = lambda: ST.run_available(spark, f"{path}/feed", f"{path}/out", f"{path}/checkpoint", te_limit=9.0, drawdown_limit=0.05, changes_only=False)
    run()
    ST.write_heartbeat(spark, f"{path}/feed", "2100-01-01")
    return run().where("strategy <> 'heartbeat'").orderBy("strategy", "ts").collect()


def test_stream_keeps_rows_of_one_timestamp(spark, tmp_path):
    at = lambda d: dt.datetime(2020, 1, d)
    rows = [
        ("a", at(1), 0.0, 0.1, False), ("a", at(2), 0.0, 0.0, False), ("a", at(2), None, None, True), ("a", at(3), float("nan"), 0.1, None),
        ("a", at(4), 0.2, 0.0, False), ("b", at(1), 0.0, 0.0, False), ("b", at(1), 0.0, 0.0, False),
    ]
    out = feed(spark, tmp_path, rows)
    a = [(r.ts.day, r.reset, r.triggered) for r in out if r.strategy == "a"]
    assert sorted(a) == sorted([(1, False, True), (2, True, False), (2, False, True), (3, False, True), (4, False, True)])
    assert sum(r.strategy == "b" for r in out) == 2
    assert all(r.tracking_error is None or r.tracking_error == r.tracking_error for r in out)  # never NaN


def test_late_rows_are_counted_batch_by_batch(spark, tmp_path):
    at = lambda d: dt.datetime(2020, 1, d)
    parts = [
        [("a", at(d), 0.01, 0.0, False) for d in range(1, 11)],
        [("b", at(20), 0.0, 0.0, False), ("a", at(3), 0.5, 0.0, False), ("b", at(8), 0.5, 0.0, False), ("a", at(9), 0.0, 0.0, False)],  # the 3rd is behind the 8th, the 8th at it
        [("a", at(5), 0.5, 0.0, False), ("a", at(21), 0.0, 0.0, False), ("a", at(17), 0.5, 0.0, False)],
    ]
    folders = [str(tmp_path / x) for x in ("feed", "out", "checkpoint", "late")]
    for rows in parts:
        spark.createDataFrame(rows, ST.INPUT).coalesce(1).write.mode("append").parquet(folders[0])
        ST.run_available(spark, *folders, te_limit=9.0, drawdown_limit=0.5, changes_only=False)
    lines = sorted((r.batch, r.n_rows, r.n_late) for r in ST.late_rows(spark, folders[3]).collect())
    assert len({r.query for r in ST.late_rows(spark, folders[3]).collect()}) == 1  # one query, started three times
    with_rows = [(n, late) for _, n, late in lines if n]
    assert with_rows == [(10, 0), (4, 2), (3, 2)]


def test_stream_goes_on_where_a_failed_run_stopped(spark, tmp_path):
    at = lambda d: dt.datetime(2020, 1, d)
    days_ = [[("a", at(3 * k + d), 0.02 * (-1) ** d, 0.0, d == 2), ("b", at(3 * k + d), 0.001 * k, 0.0, None)] for k in range(5) for d in (1, 2, 3)]
    whole, halting = tmp_path / "whole", tmp_path / "halting"
    limits = dict(te_limit=9.0, drawdown_limit=0.01, changes_only=False)
    results = []
    for base, stops in ((whole, ()), (halting, (4, 9))):
        folders = [str(base / x) for x in ("feed", "out", "checkpoint")]
        for k, rows in enumerate(days_):
            spark.createDataFrame(rows, ST.INPUT).coalesce(1).write.mode("append").parquet(folders[0])
            if k in stops:  # the run ends in the middle of its batches and is started again
                stream = spark.readStream.schema(ST.INPUT).option("maxFilesPerTrigger", 1).parquet(folders[0])
                query = ST.monitor(stream, **limits).writeStream.format("parquet").option("path", folders[1]).option("checkpointLocation", folders[2]).trigger(processingTime="0 seconds").start()
                while not any(p.batchId >= 1 for p in query.recentProgress):
                    assert query.isActive
                query.stop()
        ST.write_heartbeat(spark, folders[0], "2100-01-01")
        ST.run_available(spark, *folders, files_per_batch=2, **limits)
        out = ST.run_available(spark, *folders, **limits)
        results.append(sorted(map(tuple, out.where("strategy <> 'heartbeat'").collect()), key=str))
    assert results[0] == results[1] and len(results[0]) == 30


def test_stream_rejects_a_total_loss(spark, tmp_path):
    with pytest.raises(Exception, match="above -100 %"):
        feed(spark, tmp_path, [("a", dt.datetime(2020, 1, 1), -1.0, 0.0, False)])


def levels(spark, n=60, tickers=("IDX", "TR")):
    return spark.createDataFrame([(t, d, 100.0 + (i * 7 % 11) * (k + 1)) for k, t in enumerate(tickers) for i, d in enumerate(days(n))], "ticker STRING, date DATE, close DOUBLE")


def test_regimes_use_one_index(spark):
    both, one = levels(spark), levels(spark, tickers=("IDX",))
    labels = regime.regime_labels(both, 5)
    assert Counter(map(tuple, labels.collect())) == Counter(map(tuple, regime.regime_labels(one, 5).collect())) and labels.count() == 60
    other = regime.regime_labels(both, 5, ticker="TR")
    assert other.count() == 60 and other.select("date").distinct().count() == 60
    with pytest.raises(Exception, match="two levels on"):
        regime.regime_labels(one.union(one.limit(1)), 5).collect()


def test_membership_needs_no_pair_join(spark):
    current = spark.createDataFrame([("A",), ("B",)], "symbol STRING")
    log = spark.createDataFrame([(dt.date(2020, 3, 1), "B", "C"), (dt.date(2020, 6, 1), None, "D")], "effective_date DATE, added_ticker STRING, removed_ticker STRING")
    out = membership.membership_history(schedule(spark, [dt.date(2020, 2, 1), dt.date(2020, 3, 1), dt.date(2020, 7, 1)]), current, log)
    got = {(r.rebalance_date.month, r.symbol) for r in out.collect()}
    assert got == {(2, "A"), (2, "C"), (2, "D"), (3, "A"), (3, "B"), (3, "D"), (7, "A"), (7, "B")}
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def inputs(spark, extra=()):
    dates = [dt.date(2019, 1, 1) + dt.timedelta(days=i) for i in range(900)]
    prices = spark.createDataFrame([(s, d, 10.0, 1.0) for s in "AB" for d in dates] + list(extra), "symbol STRING, date DATE, close DOUBLE, volume DOUBLE")
    return dict(
        prices=prices, constituents=spark.createDataFrame([("A", "x"), ("B", "y")], "symbol STRING, gics_sector STRING"),
        changes=spark.createDataFrame([], "effective_date DATE, added_ticker STRING, removed_ticker STRING"),
        shares=spark.createDataFrame([], "symbol STRING, filing_date DATE, shares DOUBLE"), fundamentals=spark.createDataFrame([], "symbol STRING"),
        index_level=spark.createDataFrame([("I", d, 1.0) for d in dates], "ticker STRING, date DATE, close DOUBLE"),
    )


def test_market_reads_what_the_study_needs(spark, tmp_path):
    tables = inputs(spark)
    tables["prices"].write.parquet(str(tmp_path / "prices"))
    tables["prices"] = spark.read.parquet(str(tmp_path / "prices"))
    m = build_market(**tables, start="2020-06-01", end="2021-01-01", settings=Settings(), buffer_days=100)
    bounds = m.prices.agg(F.min("date"), F.max("date")).first()
    assert tuple(bounds) == (dt.date(2020, 2, 22), dt.date(2021, 1, 1))
    assert "GreaterThanOrEqual(date" in m.prices._jdf.queryExecution().toString()
    m.release()


def test_market_refuses_repeated_keys(spark):
    with pytest.raises(ValueError, match="1 keys more than once"):
        build_market(**inputs(spark, [("A", dt.date(2020, 6, 1), 11.0, 1.0)]), start="2020-06-01", end="2021-01-01")
