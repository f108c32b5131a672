"""Running quantiles and expanding thresholds."""

import datetime as dt

import numpy as np
import pytest

from basketry.operators import regime as R
from basketry.operators.running import running_quantiles

DAY = dt.date(2020, 1, 1)


def table(spark, series):
    rows = [(k, DAY + dt.timedelta(days=i), v) for k, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker STRING, date DATE, vol DOUBLE").repartition(3)


@pytest.mark.parametrize("bound,task_rows", [(1_000, 1_000_000), (None, 1_000_000), (1_000, 1)])
def test_every_row_has_the_quantiles_of_the_rows_so_far(spark, bound, task_rows):
    r = np.random.default_rng(3)
    series = {"one": [0.5], "two": [3.0, 1.0], "ties": [2.0] * 20 + [1.0] * 20, "up": list(map(float, range(50))), "down": list(map(float, range(50, 0, -1))), "walk": r.normal(size=137).round(1).tolist()}
    series["gaps"] = [None if i % 3 == 0 else v for i, v in enumerate(r.normal(size=30).tolist())]
    probs = {"low": 1 / 3, "high": 2 / 3, "most": 1.0, "median": 0.5}
    got = {(x.ticker, x.date): x for x in running_quantiles(table(spark, series), "ticker", "date", "vol", probs, bound, task_rows).collect()}
    assert len(got) == sum(v is not None for values in series.values() for v in values)
    for k, values in series.items():
        seen = []
        for i, v in enumerate(values):
            if v is None:
                continue
            seen.append(v)
            x = got[k, DAY + dt.timedelta(days=i)]
            assert x.n_seen == len(seen)
            assert [x[p] for p in probs] == pytest.approx([float(np.quantile(seen, q)) for q in probs.values()], abs=1e-12)


def test_no_rows(spark):
    assert running_quantiles(table(spark, {}), "ticker", "date", "vol", {"m": 0.5}, None).count() == 0
    assert running_quantiles(table(spark, {"a": [None, None]}), "ticker", "date", "vol", {"m": 0.5}, None).count() == 0


def test_later_days_do_not_move_earlier_labels(spark):
    r = np.random.default_rng(4)
    values = np.abs(r.normal(size=90)).tolist()
    short, whole = table(spark, {"x": values[:60]}), table(spark, {"x": values[:60] + [9.0] * 30})
    a, b = ({x.date: x.label for x in R.classify_expanding(t, None, least=10).collect()} for t in (short, whole))
    assert all(b[d] == label for d, label in a.items()) and sum(v is None for v in b.values()) == 9
    full = {x.date: x.label for x in R.classify(whole).collect()}
    assert any(full[d] != label for d, label in a.items() if label)
    with pytest.raises(ValueError, match="full or expanding"):
        R.regime_labels(whole, thresholds="none")
