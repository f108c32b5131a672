import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from basketry import sizing
from basketry.operators import calendar as C, marketcap as MC, membership as M, regime as R, valuation as V, weights as B
from basketry.plans import registry
from basketry.sources import cleaning
from tests.helpers import as_dict, days, numbered, price_table, schedule


def test_third_fridays(spark):
    got = [r[0] for r in C.quarterly_schedule(spark, "2024-01-01", "2024-12-31").rows.orderBy("rebalance_date").collect()]
    assert got == [dt.date(2024, 3, 15), dt.date(2024, 6, 21), dt.date(2024, 9, 20), dt.date(2024, 12, 20)]
    clipped = C.quarterly_schedule(spark, "2024-03-16", "2024-12-19").rows.count()
    assert clipped == 2


def test_add_then_remove_before_date_is_absent(spark):
    current = spark.createDataFrame([("A",), ("B",)], "symbol STRING")
    log = spark.createDataFrame(
        [(dt.date(2020, 5, 1), "X", None), (dt.date(2020, 8, 1), None, "X"), (dt.date(2021, 1, 1), "B", None)],
        "effective_date DATE, added_ticker STRING, removed_ticker STRING",
    )
    at = lambda d: {r[0] for r in M.membership_at(d, current, log).collect()}
    assert at("2020-01-01") == {"A"}
    assert at("2020-06-01") == {"A", "X"}
    assert at("2020-08-01") == {"A"}  # an event on the date itself is not undone
    assert at("2021-01-01") == {"A", "B"}


def test_membership_equals_literal_undo(spark):
    rng = random.Random(1)
    names = [f"N{i}" for i in range(12)]
    current = rng.sample(names, 6)
    dates = rng.sample([dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(400)], 60)
    log = [(d, *((rng.choice(names), None) if rng.random() < 0.5 else (None, rng.choice(names)))) for d in dates]
    asked = [dt.date(2019, 12, 1) + dt.timedelta(days=17 * i) for i in range(28)]
    got = M.membership_history(
        schedule(spark, asked), spark.createDataFrame([(c,) for c in current], "symbol STRING"),
        spark.createDataFrame(log, "effective_date DATE, added_ticker STRING, removed_ticker STRING"),
    ).collect()
    for day in asked:
        state = set(current)
        for when, added, removed in sorted(log, reverse=True, key=lambda e: e[0]):
            if when > day:
                state.discard(added)
                if removed:
                    state.add(removed)
        assert {r.symbol for r in got if r.rebalance_date == day} == state


def test_as_of_both_directions(spark):
    left = spark.createDataFrame([(1, 5), (2, 7), (3, 99)], "id INT, t INT")
    right = spark.createDataFrame([(5, "a"), (6, "b"), (10, "c")], "u INT, v STRING")
    assert as_dict(C.as_of(left, right, "t", "u", ["v"]).select("id", "v"), "id") == {1: "a", 2: "b", 3: "c"}
    forward = C.as_of(left, right, "t", "u", ["v"], direction="forward").select("id", "v")
    assert as_dict(forward, "id") == {1: "a", 2: "c", 3: None}


def test_returns_count_calendar_rows(spark):
    d = days(5)
    prices, cal = numbered(spark, d, {"A": [10.0, None, 12.0, 15.0, None], "B": [1.0, 1.0, 1.0, 1.0, 1.0]})
    plain = as_dict(C.simple_returns(prices, cal).where("symbol = 'A'").select("pos", "ret"), "pos")
    assert plain == {3: pytest.approx(0.25)}
    filled = as_dict(C.simple_returns(prices, cal, "ffill").where("symbol = 'A'").select("pos", "ret"), "pos")
    assert filled == {1: 0.0, 2: pytest.approx(0.2), 3: pytest.approx(0.25), 4: 0.0}


def test_caps_never_backfill_and_use_anchor(spark):
    d = days(4)
    prices, _ = numbered(spark, d, {"A": [10.0, 11.0, 12.0, 13.0], "C": [5.0] * 4})
    shares = spark.createDataFrame([("A", d[1], 100.0), ("A", d[3], 200.0)], "symbol STRING, filing_date DATE, shares DOUBLE")
    assert as_dict(MC.market_caps(prices, shares).select("pos", "market_cap"), "pos") == {1: 1100.0, 2: 1200.0, 3: 2600.0}
    anchors = spark.createDataFrame([("A", 50.0)], "symbol STRING, shares DOUBLE")
    scaled = as_dict(MC.market_caps(prices, shares, anchors).select("pos", "market_cap"), "pos")
    assert scaled == {1: 275.0, 2: 300.0, 3: 650.0}
    assert [r[0] for r in MC.missing_shares(prices, shares).collect()] == ["C"]


@pytest.mark.parametrize("n,k,want", [(4, 3, [0, 1, 2, 2]), (8, 3, [0, 0, 0, 1, 1, 2, 2, 2]), (1, 1, [0]), (5, 5, [0, 1, 2, 3, 4])])
def test_size_tiers(spark, n, k, want):
    rows = spark.range(n).select(F.col("id").alias("r"), B.size_tier(F.col("id"), F.lit(n).cast("bigint"), F.lit(k).cast("bigint")).alias("t"))
    assert [r.t for r in rows.orderBy("r").collect()] == want


def _chain(spark, prices, cal, sched, w, normalize, **kw):
    segments = C.holding_segments(sched, cal, **kw)
    return V.simulate(w, C.held_spans(prices, segments, sched, cal), cal, normalize)


def test_held_spans(spark):
    d = days(10)
    prices, cal = numbered(spark, d, {"A": [1.0, 2.0, None, None, None, None, 3.0, None, None, None], "B": [None] * 6 + [9.0] + [None] * 3, "C": [5.0] + [None] * 9})
    sched = schedule(spark, [d[1], d[3], d[6]])
    spans = C.held_spans(prices, C.holding_segments(sched, cal), sched, cal)
    got = sorted((r.symbol, d.index(r.rebalance_date), r.first, r.last, r.close, r.quoted) for r in spans.collect())
    assert got == [
        ("A", 1, 1, 3, 2.0, True), ("A", 3, 3, 5, 2.0, False), ("A", 3, 6, 6, 3.0, True), ("A", 6, 6, 9, 3.0, True),
        ("B", 3, 6, 6, 9.0, True), ("B", 6, 6, 9, 9.0, True), ("C", 1, 1, 3, 5.0, False), ("C", 3, 3, 6, 5.0, False), ("C", 6, 6, 9, 5.0, False),
    ]
    # The same days as the filled panel has inside the segments.
    wide = C.forward_fill(prices, cal).join(C.segment_days(C.holding_segments(sched, cal)), "pos")
    written = spans.select("rebalance_date", "symbol", F.explode(F.sequence("first", "last")).alias("pos"), "close")
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, wide.select("rebalance_date", "symbol", "pos", "close").collect()))
    none = prices.limit(0)
    assert C.held_spans(none, C.holding_segments(sched, cal), sched, cal).count() == 0


def test_single_rebalance_is_buy_and_hold(spark):
    d = days(50)
    x = [100 + 20 * i / 49 for i in range(50)]
    y = [50 - 5 * i / 49 for i in range(50)]
    prices, cal = numbered(spark, d, {"X": x, "Y": y})
    total = 10 * x[0] + 40 * y[0]
    w = spark.createDataFrame([("s", d[0], "X", 10 * x[0] / total), ("s", d[0], "Y", 40 * y[0] / total)], "strategy STRING, rebalance_date DATE, symbol STRING, weight DOUBLE")
    got = as_dict(_chain(spark, prices, cal, schedule(spark, [d[0]]), w, False).select("pos", "value"), "pos")
    for i in range(50):
        assert got[i] == pytest.approx((10 * x[i] + 40 * y[i]) / total, abs=1e-12)


def test_missing_start_price_and_gaps(spark):
    d = days(6)
    prices, cal = numbered(spark, d, {"A": [1.0, None, 1.2, None, None, 1.5], "B": [None, 2.0, 2.0, 2.0, 2.0, 2.0], "C": [4.0] * 6})
    w = spark.createDataFrame([("s", d[0], s, 1 / 3) for s in "ABC"], "strategy STRING, rebalance_date DATE, symbol STRING, weight DOUBLE")
    got = as_dict(_chain(spark, prices, cal, schedule(spark, [d[0]]), w, True).select("pos", "value"), "pos")
    # B has no start price, so A and C share the portfolio equally; A's quote is carried inside gaps.
    assert [got[i] for i in range(6)] == pytest.approx([1.0, 1.0, 1.1, 1.1, 1.1, 1.25])


def test_holiday_rebalance_loses_or_bridges_the_move(spark):
    d = [dt.date(2026, 6, 17), dt.date(2026, 6, 18), dt.date(2026, 6, 22), dt.date(2026, 6, 23)]
    prices, cal = numbered(spark, d, {"A": [1.0, 2.0, 4.0, 8.0]})
    dates = [d[0], dt.date(2026, 6, 19)]
    w = spark.createDataFrame([("s", r, "A", 1.0) for r in dates], "strategy STRING, rebalance_date DATE, symbol STRING, weight DOUBLE")
    plain = as_dict(_chain(spark, prices, cal, schedule(spark, dates), w, True).select("pos", "value"), "pos")
    assert plain == {0: 1.0, 1: 2.0, 2: 2.0, 3: 4.0}
    bridged = as_dict(_chain(spark, prices, cal, schedule(spark, dates), w, True, bridge_gaps=True).select("pos", "value"), "pos")
    assert bridged == {0: 1.0, 1: 2.0, 2: 4.0, 3: 8.0}


def test_skipped_rebalance_carries_value(spark):
    d = days(9)
    prices, cal = numbered(spark, d, {"A": [float(2 ** i) for i in range(9)]})
    w = spark.createDataFrame([("s", d[0], "A", 1.0), ("s", d[6], "A", 1.0)], "strategy STRING, rebalance_date DATE, symbol STRING, weight DOUBLE")
    got = as_dict(_chain(spark, prices, cal, schedule(spark, [d[0], d[3], d[6]]), w, True).select("pos", "value"), "pos")
    assert got == {0: 1.0, 1: 2.0, 2: 4.0, 3: 8.0, 6: 8.0, 7: 16.0, 8: 32.0}


def test_spread_ranking_equals_window(spark):
    rng = random.Random(3)
    rows = [(g, f"s{i}", float(rng.randint(0, 40))) for g, n in (("hot", 900), ("cold", 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "g STRING, s STRING, v DOUBLE")
    key = ["g"]
    one = sizing.position_in_group(df, key, [F.desc("v"), F.col("s")], 1000)
    many = sizing.position_in_group(df, key, [F.desc("v"), F.col("s")], 1000, task_rows=10)
    assert sorted(map(tuple, one.select("g", "s", "rank0", "n").collect())) == sorted(map(tuple, many.select("g", "s", "rank0", "n").collect()))
    a = sizing.mean_rank_in_group(df, key, "v", 1000, "r").select("g", "s", "r").collect()
    b = sizing.mean_rank_in_group(df, key, "v", None, "r").select("g", "s", "r").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    qa = sizing.quantiles_in_group(df, key, "v", {"m": 0.5, "q": 0.75}, 1000).collect()
    qb = sizing.quantiles_in_group(df, key, "v", {"m": 0.5, "q": 0.75}, None).collect()
    assert {r.g: (r.m, r.q) for r in qa} == {r.g: (r.m, r.q) for r in qb}


def test_terciles_of_thirty(spark):
    rows = spark.createDataFrame([(d, float(i + 1)) for i, d in enumerate(days(30))], "date DATE, vol DOUBLE")
    assert as_dict(R.day_counts(R.classify(rows)), "label") == {"calm": 10, "normal": 10, "volatile": 10}


def test_price_scan_pushes_filter_and_prunes(spark, tmp_path):
    from basketry.sources import cleaning

    d = days(600)
    price_table(spark, d, {"A": [1.0] * 600}).selectExpr(
        "symbol", "date", "close AS open", "close AS high", "close AS low", "close", "volume"
    ).write.parquet(str(tmp_path / "p"))
    df = cleaning.read_prices(spark, str(tmp_path / "p"), d[-1])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "open" not in plan.split("ReadSchema")[1]
    assert df.agg(F.min("date")).first()[0] >= d[-1] - dt.timedelta(days=400)


def test_wide_blocks_hold_more_symbols_than_one_table_may_be_wide(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "WIDEST", 3)
    dates = days(4)
    closes = {f"S{i}": [None if (i + j) % 3 == 0 else float(10 * i + j) for j in range(4)] for i in range(7)}
    prices = price_table(spark, dates, closes)
    blocks, names = cleaning.to_wide_blocks(prices, "close", 3)
    assert blocks.columns == ["block", "date", "c0", "c1", "c2"] and names.count() == 7
    assert {r.symbol: (r.block, r.slot) for r in names.collect()} == {f"S{i}": (i // 3, i % 3) for i in range(7)}
    back = {(r.symbol, r.date): r.close for r in cleaning.from_wide_blocks(blocks, names, "close").collect()}
    assert back == {(s, d): c for s, row in closes.items() for d, c in zip(dates, row) if c is not None}
    with pytest.raises(ValueError, match="7 symbols"):
        cleaning.to_wide(prices, "close")


def test_wide_price_panel_is_no_longer_bounded_by_a_pivot(spark, monkeypatch):
    """The query took one pivot and failed beyond its width."""
    monkeypatch.setattr(cleaning, "WIDEST", 3)
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    got = registry.QUERIES["wide_price_panel"](spark, sf)
    assert got.columns == ["date", "symbol", "close"]
    assert got.count() == registry.QUERIES["price_panel"](spark, sf).where("close IS NOT NULL").count()
