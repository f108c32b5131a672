"""Price history stored by symbol and year.

Rows are bucketed and sorted by symbol and date inside folders by year. A scan is then already dealt by symbol, so windows
and joins on the symbol need no exchange of the prices, and a study reads the years it needs. New days are appended; what is
stored is never written again. The folder outlives the session: ``attach`` gives another session the same table.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry import schemas

COLUMNS = "symbol STRING, date DATE, close DOUBLE, volume DOUBLE"
_YEAR = "year"


def _day(value: dt.date | str | None) -> dt.date | None:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class PriceStore:
    """A folder of bucketed price files and the table over it in this session's catalogue."""

    spark: SparkSession
    path: str
    table: str
    buckets: int

    def read(self, since: dt.date | str | None = None, until: dt.date | str | None = None) -> DataFrame:
        """``(symbol, date, close, volume)`` from ``since`` to ``until``; other years are not read."""
        rows = self.spark.table(self.table)
        for day, keep in ((_day(since), lambda c, v: c >= v), (_day(until), lambda c, v: c <= v)):
            if day is not None:
                rows = rows.where(keep(F.col(_YEAR), F.lit(day.year)) & keep(F.col("date"), F.lit(day)))
        return rows.select("symbol", "date", "close", "volume")

    def last_day(self) -> dt.date | None:
        """The latest stored date, found in the latest year alone."""
        years = [int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect()]
        if not years:
            return None
        return self.spark.table(self.table).where(F.col(_YEAR) == max(years)).agg(F.max("date")).first()[0]

    def append(self, prices: DataFrame) -> None:
        """Store the rows of ``prices`` after the last stored day; earlier ones are known and are left as they are."""
        last = self.last_day()
        _write(prices if last is None else prices.where(F.col("date") > F.lit(last)), self.table, self.buckets, f"{self.path}/data")

    def violations(self, since: dt.date | str | None = None, until: dt.date | str | None = None) -> DataFrame:
        """Null and repeated keys. The scan is dealt by symbol, so the rows of a key already meet in one task."""
        return schemas.key_violations(self.read(since, until), ["symbol", "date"])

    def detach(self) -> None:
        """Forget the table; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _write(prices: DataFrame, table: str, buckets: int, path: str) -> None:
    """One file for each bucket and year. Rows without a date are stored in a year of their own (null)."""
    schemas.require_columns(prices, COLUMNS)
    rows = prices.select("symbol", F.col("date").cast("date").alias("date"), F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"), F.year("date").alias(_YEAR))
    (
        rows.repartition(buckets, "symbol").write.format("parquet").mode("append").option("path", path)
        .partitionBy(_YEAR).bucketBy(buckets, "symbol").sortBy("symbol", "date").saveAsTable(table)
    )


def create(prices: DataFrame, path: str, buckets: int | None = None) -> PriceStore:
    """Store ``prices`` in a new folder. ``buckets``: tasks that later read the panel; by default as many as a shuffle has.

    With fewer, a join may deal the prices anew to have more tasks; with more, the other side follows the buckets.
    """
    spark = prices.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(1).select(F.lit(n).alias("buckets")).write.parquet(f"{path}/layout")
    store = PriceStore(spark, path, f"prices_{uuid.uuid4().hex}", n)
    _write(prices, store.table, n, f"{path}/data")
    return store


def attach(spark: SparkSession, path: str) -> PriceStore:
    """The store that an earlier session left in ``path``."""
    n = spark.read.parquet(f"{path}/layout").first()["buckets"]
    store = PriceStore(spark, path, f"prices_{uuid.uuid4().hex}", n)
    spark.sql(
        f"CREATE TABLE {store.table} ({COLUMNS}, {_YEAR} INT) USING parquet PARTITIONED BY ({_YEAR}) "
        f"CLUSTERED BY (symbol) SORTED BY (symbol, date) INTO {n} BUCKETS LOCATION '{path}/data'"
    )
    spark.sql(f"ALTER TABLE {store.table} RECOVER PARTITIONS")
    return store
