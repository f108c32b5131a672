"""Fundamentals as they were known: restatements, fields stated apart, odd rows, and a snapshot as the special case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.operators import factors, fundamentals as known
from tests.helpers import days, numbered, schedule

D = dt.date
COLUMNS = "symbol STRING, period_end DATE, as_of DATE, returnOnEquity DOUBLE, trailingEps DOUBLE"


def intervals(spark, rows, columns=COLUMNS):
    df = spark.createDataFrame(rows, columns)
    got = known.known_intervals(df, ["returnOnEquity", "trailingEps"]).orderBy("symbol", "known_from").collect()
    return [tuple(r) for r in got]


def test_latest_period_wins_and_a_late_restatement_of_an_old_one_does_not(spark):
    rows = [
        ("A", D(2020, 3, 31), D(2020, 5, 1), 0.1, 1.0),
        ("A", D(2020, 6, 30), D(2020, 8, 1), 0.2, None),    # no earnings stated: those of March stay
        ("A", D(2020, 3, 31), D(2020, 9, 1), 0.15, 1.5),    # restates March: earnings change, the return does not
        ("A", D(2020, 6, 30), D(2020, 9, 15), 0.25, 2.5),   # states June anew
        ("A", D(2020, 3, 31), D(2020, 10, 1), None, 9.0),   # March again: June is known by now
    ]
    assert intervals(spark, rows) == [
        ("A", D(2020, 5, 1), D(2020, 7, 31), 0.1, 1.0),
        ("A", D(2020, 8, 1), D(2020, 8, 31), 0.2, 1.0),
        ("A", D(2020, 9, 1), D(2020, 9, 14), 0.2, 1.5),
        ("A", D(2020, 9, 15), D(2020, 9, 30), 0.25, 2.5),
        ("A", D(2020, 10, 1), None, 0.25, 2.5),
    ]


def test_odd_rows(spark):
    rows = [
        ("B", None, D(2020, 5, 1), 0.1, None), ("B", D(2020, 3, 31), D(2020, 5, 2), 0.2, 1.0),  # no period: its own day, which is later
        ("C", D(2020, 3, 31), D(2020, 5, 1), 0.3, 2.0), ("C", D(2020, 3, 31), D(2020, 5, 1), 0.4, None), ("C", D(2020, 3, 31), D(2020, 5, 1), 0.4, None),
        (None, D(2020, 3, 31), D(2020, 5, 1), 1.0, 1.0), ("E", D(2020, 3, 31), None, 1.0, 1.0), ("F", D(2020, 3, 31), D(2020, 5, 1), None, None),
    ]
    assert intervals(spark, rows) == [
        ("B", D(2020, 5, 1), D(2020, 5, 1), 0.1, None), ("B", D(2020, 5, 2), None, 0.1, 1.0),
        ("C", D(2020, 5, 1), None, 0.4, 2.0), ("F", D(2020, 5, 1), None, None, None),
    ]
    assert intervals(spark, []) == []
    plain = [("A", D(2020, 5, 1), 0.1, 1.0), ("A", D(2020, 6, 1), None, 2.0)]
    assert intervals(spark, plain, "symbol STRING, as_of DATE, returnOnEquity DOUBLE, trailingEps DOUBLE") == [
        ("A", D(2020, 5, 1), D(2020, 5, 31), 0.1, 1.0), ("A", D(2020, 6, 1), None, 0.1, 2.0),
    ]


def test_states_on_the_calendar_and_at_rebalances(spark):
    dates = days(10)  # 1 to 14 January 2020, without the weekends of 4-5 and 11-12
    _, cal = numbered(spark, dates, {"A": [1.0] * 10})
    rows = [
        ("A", D(2019, 9, 30), D(2019, 12, 1), 0.1, 1.0),    # before the calendar: from its first row on
        ("A", D(2019, 12, 31), D(2020, 1, 4), 0.2, 2.0),    # a Saturday: from Monday on
        ("A", D(2019, 12, 31), D(2020, 1, 5), 0.3, 2.0),    # the Sunday after: takes the place of Saturday's
        ("B", D(2019, 12, 31), D(2020, 1, 14), 0.5, 5.0), ("C", D(2019, 12, 31), D(2020, 1, 20), 0.6, 6.0),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r.symbol, r.pos): r.returnOnEquity for r in known.known_by_row(df, ["returnOnEquity"], cal).collect()}
    assert got == {("A", p): 0.1 if p < 3 else 0.3 for p in range(10)} | {("B", 9): 0.5}
    dates = [D(2019, 11, 1), D(2020, 1, 4), D(2020, 1, 5), D(2020, 6, 1)]
    got = {(r.symbol, r.rebalance_date): r.returnOnEquity for r in known.known_at_rebalances(df, ["returnOnEquity"], schedule(spark, dates)).collect()}
    assert got == {("A", dates[1]): 0.2, ("A", dates[2]): 0.3, ("A", dates[3]): 0.3, ("B", dates[3]): 0.5, ("C", dates[3]): 0.6}


@pytest.mark.parametrize("dated", [False, True])
def test_one_publication_before_the_start_is_a_snapshot(spark, dated):
    names = "ABCDE"
    prices, cal = numbered(spark, days(6), {s: [10.0 + i + k for k in range(6)] for i, s in enumerate(names)})
    snapshot = spark.createDataFrame([(s, 0.1 * i, 0.2 - 0.01 * i * i, None if i == 2 else 1.0 * i, 3.0 + i) for i, s in enumerate(names)], "symbol STRING, returnOnEquity DOUBLE, profitMargins DOUBLE, debtToEquity DOUBLE, trailingEps DOUBLE")
    want = {r.symbol: r.score for r in factors.quality_scores(snapshot).collect()}
    reports = snapshot.withColumn("as_of", F.lit("2019-06-01").cast("date"))
    assert known.is_dated(reports) and not known.is_dated(snapshot)
    if dated:
        got = known.quality_panel(reports, cal).collect()
        assert len(got) == 30
    else:
        got = known.quality_at_rebalances(reports, schedule(spark, [D(2020, 1, 3), D(2020, 1, 6)])).collect()
        assert len(got) == 10
    assert all(r.score == pytest.approx(want[r.symbol]) for r in got)
    a = {(r.symbol, r.pos): r.score for r in factors.value_scores(prices, snapshot, cal).collect()}
    b = {(r.symbol, r.pos): r.score for r in known.value_scores_known(prices, reports, cal).collect()}
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(a[k]) for k in a)


def test_no_figure_is_used_before_it_is_public(spark):
    prices, cal = numbered(spark, days(6), {s: [10.0] * 6 for s in "ABC"})
    rows = [(s, D(2019, 12, 31), d, 0.1, 1.0 * (i + 1)) for i, (s, d) in enumerate(zip("ABC", (D(2020, 1, 1), D(2020, 1, 3), D(2020, 1, 7))))]
    got = known.value_scores_known(prices, spark.createDataFrame(rows, COLUMNS), cal).collect()
    assert {(r.symbol, r.pos) for r in got} == {("A", p) for p in range(2, 6)} | {("B", p) for p in range(2, 6)} | {("C", p) for p in range(4, 6)}
