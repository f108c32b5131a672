"""Declared schemas of the input tables and a contract check."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

PRICES = "symbol STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
INDEX_LEVEL = "ticker STRING, date DATE, close DOUBLE"
SHARES_RAW = "symbol STRING, raw_ts TIMESTAMP, shares DOUBLE"
SHARES = "symbol STRING, filing_date DATE, shares DOUBLE"
SHARE_ANCHORS = "symbol STRING, shares DOUBLE"
# The columns of the cleaned list and log, and the fields that the data feed names.
CONSTITUENTS = (
    "symbol STRING, feed_symbol STRING, security STRING, gics_sector STRING, gics_sub_industry STRING, "
    "headquarters STRING, date_added DATE, cik BIGINT, founded STRING"
)
CHANGES = (
    "effective_date DATE, added_ticker STRING, added_security STRING, removed_ticker STRING, "
    "removed_security STRING, reason STRING, added_feed STRING, removed_feed STRING"
)
FUNDAMENTAL_FIELDS = (
    "sector", "industry", "marketCap", "returnOnEquity", "debtToEquity", "profitMargins",
    "earningsGrowth", "earningsQuarterlyGrowth", "trailingEps", "freeCashflow", "totalDebt", "totalCash",
)
FUNDAMENTALS = "symbol STRING, sector STRING, industry STRING, " + ", ".join(
    f"{name} DOUBLE" for name in FUNDAMENTAL_FIELDS[2:]
)
WEIGHTS = "strategy STRING, rebalance_date DATE, symbol STRING, weight DOUBLE"


def require_columns(df: DataFrame, schema: str | StructType) -> DataFrame:
    """Fail early when a declared column is missing; extra columns pass."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = [f.name for f in wanted.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, got {df.columns}")
    return df


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows with a null key, and keys that occur more than once."""
    null_key = F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull().cast("int")
    per_key = df.withColumn("_null", null_key).groupBy(*keys, "_null").agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum(F.col("_null") * F.col("_n")), F.lit(0)).alias("null_keys"),
        F.count_if((F.col("_null") == 0) & (F.col("_n") > 1)).alias("duplicate_keys"),
    )
