"""Small in-memory markets for exact tests."""

from __future__ import annotations

import datetime as dt

import pandas as pd

from basketry.operators import calendar as cal_ops
from basketry.sizing import Schedule


def days(n: int, start: str = "2020-01-01") -> list[dt.date]:
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def price_table(spark, dates, closes: dict[str, list[float | None]], volume: float = 1e6):
    rows = [(s, d, c, volume) for s, series in closes.items() for d, c in zip(dates, series) if c is not None]
    return spark.createDataFrame(rows, "symbol STRING, date DATE, close DOUBLE, volume DOUBLE")


def numbered(spark, dates, closes):
    """Prices with ``pos`` on a calendar that has every date, quoted or not."""
    cal = cal_ops.trading_calendar(spark.createDataFrame([(d,) for d in dates], "date DATE"))
    return cal_ops.number_dates(price_table(spark, dates, closes), cal), cal


def schedule(spark, dates) -> Schedule:
    return Schedule(spark.createDataFrame([(d,) for d in dates], "rebalance_date DATE"), len(dates))


def series(spark, values: dict[str, list[tuple]], names: str = "date DATE, ret DOUBLE"):
    rows = [(k, *v) for k, items in values.items() for v in items]
    return spark.createDataFrame(rows, f"strategy STRING, {names}")


def as_dict(df, *keys):
    out = {}
    for r in df.collect():
        rest = [r[c] for c in df.columns if c not in keys]
        out[tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]] = rest[0] if len(rest) == 1 else tuple(rest)
    return out
