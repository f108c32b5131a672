"""What a query does not need is not computed, and shared steps run once."""

from __future__ import annotations

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from basketry.operators import bootstrap, marketcap
from basketry.plans import named, registry
from basketry.plans.market import supplied_market
from basketry.sources import fixtures
from tests.helpers import days, series

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def market(spark):
    return supplied_market(spark, SF)


def test_quality_weights_build_no_panel_and_no_factors(market):
    fresh = replace(market)
    own = registry.quality_weights(fresh).collect()
    assert not {"n_symbols", "factor_scores", "ic", "composite", "start_caps"} & set(fresh.__dict__)
    assert sorted(own) == sorted(fresh.rule_weights.where("strategy = 'quality'").select("rebalance_date", "symbol", F.round("weight", 9)).collect())


def test_cents_are_those_of_round(spark):
    values = [0.0, -0.0, 0.005, 0.015, 1.005, 2.675, 0.125, -0.125, 0.375, -2.5, 12345.67, 104949.5, 1e9 + 0.01, 0.004999999999999999, None]
    df = spark.createDataFrame([(v,) for v in values], "p DOUBLE")
    for row in df.select("p", fixtures.cents("p").alias("own"), F.round(F.col("p") * 100).cast("bigint").alias("plain")).collect():
        assert row.own == row.plain, row.p


def test_caps_are_taken_on_segment_starts_alone(market, monkeypatch):
    seen, whole = [], marketcap.market_caps
    monkeypatch.setattr(marketcap, "market_caps", lambda prices, *rest: seen.append(prices) or whole(prices, *rest))
    fresh = replace(market)
    starts = {r.sp for r in market.segments.select("sp").collect()}
    rows = fresh.start_caps.collect()
    assert {r.pos for r in seen[0].select("pos").distinct().collect()} <= starts
    held = market.caps.join(market.segments.select("rebalance_date", F.col("sp").alias("pos")), "pos")
    assert sorted(rows) == sorted(held.select("rebalance_date", "symbol", "pos", "close", "market_cap").collect())


def test_a_study_of_one_variant_builds_that_one_alone(market):
    for study in (named.risk_attribution, named.multi_objective):
        fresh = replace(market)
        assert "error" not in study(fresh).columns
        assert "tilt_weights" in fresh.__dict__ and not {"rule_weights", "equal_weights", "quality_weights"} & set(fresh.__dict__)


def test_resamples_spread_over_tasks(spark):
    pairs = series(spark, {"a": [(d, 0.01 * (i % 5 - 2)) for i, d in enumerate(days(40))]})
    drawn = bootstrap.resampled_metrics(pairs, ["strategy"], 5, 400)
    assert drawn.select(F.spark_partition_id().alias("p")).distinct().count() > 1
