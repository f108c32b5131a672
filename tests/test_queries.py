"""Every registered query runs, and those with SQL agree with DuckDB."""

import math
import os
from collections import defaultdict

import pytest

import __spark_entry__ as entry_point
from tests import check_oracles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry_point.oracle_sql()
QUERIES = entry_point.queries()


@pytest.fixture(scope="module")
def con():
    return check_oracles.duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    problem, _ = check_oracles.compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert problem == "" or problem.startswith("(inexact")


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if n != "pipeline" and not n.startswith("op")))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and "error" not in df.columns
    for f in df.schema.fields:  # weights sum to one per portfolio, nothing is NaN, no column is empty throughout
        values = [r[f.name] for r in rows]
        assert any(v is not None for v in values), f.name
        assert not any(isinstance(v, float) and math.isnan(v) for v in values), f.name
    if "weight" in df.columns:
        keys = [c for c in df.columns if c not in ("symbol", "weight")]
        totals = defaultdict(float)
        for r in rows:
            assert r.weight >= -1e-9
            totals[tuple(r[k] for k in keys)] += r.weight
        assert all(abs(t - 1) < 1e-4 for t in totals.values())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["date", "value", "ret"] and df.count() > 0
