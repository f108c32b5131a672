"""Prices stored by symbol and year: appends, years read, plans without an exchange of the prices."""

import uuid
from datetime import date

import pytest

from basketry.operators import calendar as C, marketcap as MC
from basketry.plans.market import build_market
from basketry.session import shared_dir
from basketry.sources import fixtures, store
from tests.test_plans import SF, plan_of

D = date
SCHEMA = "symbol STRING, date DATE, close DOUBLE, volume DOUBLE"


@pytest.fixture
def path(spark):
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_appends_new_days_only_and_outlives_the_session(spark, path):
    first = [("A", D(2019, 12, 30), 1.0, 10.0), ("B", D(2020, 1, 2), 2.0, None), ("A", D(2020, 1, 2), 3.0, 5.0)]
    s = store.create(spark.createDataFrame(first, SCHEMA), path, 4)
    assert s.last_day() == D(2020, 1, 2) and rows_of(s.read()) == sorted(first, key=str)
    later = [("A", D(2020, 1, 2), 99.0, 1.0), ("C", D(2019, 1, 2), 99.0, 1.0), ("A", D(2020, 1, 3), 4.0, 6.0), ("B", D(2021, 5, 3), 5.0, 7.0)]
    s.append(spark.createDataFrame(later, SCHEMA))
    s.append(spark.createDataFrame(later, SCHEMA))  # a repeated delivery adds nothing
    everything = sorted(first + later[2:], key=str)
    assert rows_of(s.read()) == everything and s.last_day() == D(2021, 5, 3)
    s.detach()
    again = store.attach(spark, path)
    assert again.buckets == 4 and rows_of(again.read()) == everything
    assert rows_of(again.read("2020-01-02", D(2020, 12, 31))) == [r for r in everything if r[1].year == 2020]
    again.append(spark.createDataFrame([("B", D(2021, 5, 4), 6.0, 8.0)], SCHEMA))
    assert again.read("2021-01-01").count() == 2


def test_only_the_years_asked_for_are_read(spark, path):
    s = store.create(fixtures.prices(spark, SF), path, 4)
    part = s.read("1995-03-01", "1996-02-28")
    plan = plan_of(part)
    assert "year" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(date,1995-03-01)" in plan
    assert {f.split("year=")[1].split("/")[0] for f in part.inputFiles()} >= {"1995", "1996"}
    assert part.count() == fixtures.prices(spark, SF).where("date BETWEEN '1995-03-01' AND '1996-02-28'").count()


@pytest.mark.parametrize("buckets", [None, 16])  # as many as a shuffle has, or more
def test_prices_are_not_exchanged(spark, path, buckets):
    s = store.create(fixtures.prices(spark, SF), path, buckets)
    cal = C.trading_calendar(fixtures.price_dates(spark, SF))
    panel = C.number_dates(s.read(), cal)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        returns = plan_of(C.simple_returns(panel, cal))
        caps = plan_of(MC.market_caps(panel, fixtures.shares(spark, SF, cal), fixtures.share_anchors(spark, SF), cal.rows))
        keys = plan_of(s.violations())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in returns and "Exchange hashpartitioning" not in returns
    assert "Bucketed: true" in keys and "Exchange hashpartitioning" not in keys
    # In the caps only the two tables of share counts are dealt anew; between the prices and their join there is no exchange.
    lines = caps.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    above = []
    for line in reversed(lines[:scan]):
        if depth(line) < (above[-1][0] if above else depth(lines[scan])):
            above.append((depth(line), line))
    assert any("SortMergeJoin" in line for _, line in above) and not any("Exchange" in line for _, line in above)


def test_null_and_repeated_keys_are_counted(spark, path):
    bad = [("A", D(2020, 1, 2), 1.0, 1.0), ("A", D(2020, 1, 2), 2.0, 1.0), (None, D(2020, 1, 2), 1.0, 1.0), ("B", None, 1.0, 1.0), ("B", D(2020, 1, 2), 1.0, 1.0)]
    s = store.create(spark.createDataFrame(bad, SCHEMA), path, 3)
    assert tuple(s.violations().first()) == (2, 1)
    empty = store.create(spark.createDataFrame([], SCHEMA), path + "e", 3)
    assert empty.last_day() is None and empty.read().count() == 0 and tuple(empty.violations().first()) == (0, 0)


def test_a_market_over_a_store_equals_one_over_the_table(spark, path):
    cal = C.trading_calendar(fixtures.price_dates(spark, SF))
    prices = fixtures.prices(spark, SF).drop("sid")
    s = store.create(prices, path, 4)
    rest = dict(
        constituents=fixtures.constituents(spark, SF), changes=fixtures.changes(spark, SF, cal), shares=fixtures.shares(spark, SF, cal),
        fundamentals=fixtures.fundamentals(spark, SF), index_level=fixtures.index_level(spark, SF), start="1995-01-01", end="1997-12-31",
    )
    a, b = build_market(prices, **rest), build_market(s, **rest)
    try:
        assert rows_of(a.prices) == rows_of(b.prices) and a.n_symbols == b.n_symbols
        assert rows_of(a.caps) == rows_of(b.caps)
        x, y = ({r.pos: r.value for r in m.benchmark_values.collect()} for m in (a, b))
        assert x.keys() == y.keys() and all(x[k] == pytest.approx(y[k], abs=1e-12) for k in x)
    finally:
        a.release(), b.release()
    with pytest.raises(ValueError, match="more than once"):
        build_market(store.create(prices.unionByName(prices.where("symbol = 'S1'")), path + "t", 4), **rest)
