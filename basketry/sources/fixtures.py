"""Market tables derived from the supplied star-schema tables.

Supplier = security, nation/region = sector, month = trading row. Every view runs
over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(key: str):
    return F.concat(F.lit("S"), F.col(key).cast("string"))


def cents(price: str = "l_extendedprice"):
    """Price in whole cents, halves away from zero as ``round`` has it, which goes through a decimal for each row."""
    at = F.col(price) * 100
    near = F.rint(at)  # halves to even; both differences below are exact
    return F.when(F.abs(at - near) == 0.5, at + F.signum(at) / 2).otherwise(near).cast("bigint")


def month_of(day: str = "l_shipdate"):
    return F.trunc(F.col(day).cast("date"), "month").alias("date")


def unit_price():
    """Value over quantity. Cents are summed as integers, so the result does not depend on task order."""
    return (F.sum(cents()).cast("double") / 100 / F.sum("l_quantity")).alias("close")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    monthly = line.groupBy(F.col("l_suppkey").alias("sid"), month_of()).agg(unit_price(), F.sum("l_quantity").alias("volume"))
    return monthly.select("sid", symbol_of("sid").alias("symbol"), "date", "close", "volume")


def price_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading dates straight from the fact table, one narrow column whose few values are told apart before they are cut to months."""
    return table(spark, sf_dir, "lineitem").select("l_shipdate").distinct().select(month_of())


def prices_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    # Summed per part and day first, so that a part with very many lines crosses the join as one row a day.
    daily = line.groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum(cents()).alias("cents"), F.sum("l_quantity").alias("quantity")
    )
    return (
        daily.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("symbol"), "date")
        .agg((F.sum("cents").cast("double") / 100 / F.sum("quantity")).alias("close"), F.sum("quantity").alias("volume"))
    )


def index_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
        .agg(unit_price())
        .transform(_two_indices)
    )


def _two_indices(levels: DataFrame) -> DataFrame:
    """A price index, and a total-return index that gains on it by a hundredth of a percent a day."""
    days = F.datediff("date", F.lit("1995-01-01").cast("date"))
    both = F.array(
        F.struct(F.lit("IDX").alias("ticker"), F.col("close").alias("level")),
        F.struct(F.lit("IDXTR").alias("ticker"), (F.col("close") * (1 + days / 10000.0)).alias("level")),
    )
    return levels.select("date", F.explode(both).alias("i")).select("i.ticker", "date", F.col("i.level").alias("close"))


def index_level_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem").groupBy(month_of())
        .agg(unit_price())
        .transform(_two_indices)
    )


def gappy(numbered_prices: DataFrame) -> DataFrame:
    """Deterministic holes in the monthly panel, for fill tests."""
    return numbered_prices.where((F.col("sid") * 31 + F.col("pos") * 17) % 29 != 0)


def _supplier_months(spark: SparkSession, sf_dir: str, calendar_length: int, keep) -> DataFrame:
    """Supplier rows repeated on the calendar positions for which ``keep(s_suppkey, pos)`` holds."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    wanted = F.filter(F.sequence(F.lit(0), F.lit(calendar_length - 1)), lambda p: keep(F.col("s_suppkey"), p))
    return s.select("s_suppkey", F.explode(wanted.cast("array<bigint>")).alias("pos"))


def shares(spark: SparkSession, sf_dir: str, cal) -> DataFrame:
    rows = _supplier_months(spark, sf_dir, cal.n, lambda s, p: ((p + s) % 3 == 0) & (p >= s % 5))
    return rows.join(cal.hint(cal.rows), "pos").select(
        symbol_of("s_suppkey").alias("symbol"), F.col("date").alias("filing_date"),
        (1000 + (F.col("s_suppkey") * 37 + F.col("pos") * 11) % 500).cast("double").alias("shares"),
    )


def share_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(
        symbol_of("s_suppkey").alias("symbol"), (1200 + F.col("s_suppkey") % 300).cast("double").alias("shares")
    )


def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    # nation and region are fixed 25- and 5-row dimensions of this schema.
    places = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        s.where("s_suppkey % 10 <> 0").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            symbol_of("s_suppkey").alias("symbol"), F.col("s_name").alias("security"),
            F.col("r_name").alias("gics_sector"), F.col("n_name").alias("gics_sub_industry"),
            F.date_add(F.lit("1970-01-01").cast("date"), ((F.col("s_suppkey") * 131) % 9000).cast("int")).alias("date_added"),
        )
    )


def changes(spark: SparkSession, sf_dir: str, cal) -> DataFrame:
    added = lambda s, p: (s * 7 + p) % 23 == 0
    rows = _supplier_months(
        spark, sf_dir, cal.n, lambda s, p: (p % 3 == 1) & (added(s, p) | ((s * 5 + p) % 29 == 0))
    )
    is_add = added(F.col("s_suppkey"), F.col("pos"))
    symbol = symbol_of("s_suppkey")
    return rows.join(cal.hint(cal.rows), "pos").select(
        F.col("date").alias("effective_date"),
        F.when(is_add, symbol).alias("added_ticker"), F.when(~is_add, symbol).alias("removed_ticker"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, line = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    # Aggregate before the join so one row per supplier crosses it.
    facts = line.groupBy("l_suppkey").agg(
        F.avg("l_discount").alias("roe"), F.avg("l_tax").alias("margin"),
        (F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias("growth"),
        (F.avg("l_extendedprice") / 1000).alias("eps"),
    )
    return s.join(facts, F.col("s_suppkey") == F.col("l_suppkey")).select(
        symbol_of("s_suppkey").alias("symbol"), F.col("roe").alias("returnOnEquity"),
        F.col("margin").alias("profitMargins"),
        F.when(F.col("s_suppkey") % 7 != 0, F.col("growth")).alias("earningsGrowth"),
        F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal")).alias("debtToEquity"),
        F.col("eps").alias("trailingEps"),
    )


def dated_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each supplier and quarter, public some weeks after it; every fifth supplier restates each quarter 220 days
    after its end with other figures, and not every report states every field."""
    key, day = F.col("l_suppkey"), F.col("period_end")
    line = table(spark, sf_dir, "lineitem")
    quarter = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate").cast("date"), 2))
    facts = line.groupBy("l_suppkey", quarter.alias("period_end")).agg(
        F.avg("l_discount").alias("roe"), F.avg("l_tax").alias("margin"),
        (F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias("growth"),
        (F.sum(cents()).cast("double") / F.count(F.lit(1)) / 100000).alias("eps"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("turn", key + F.month(day))
    # The first report, then the restatement of those that make one.
    told = facts.withColumn("late", F.explode(F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    late = F.col("late") == 1
    return told.select(
        symbol_of("l_suppkey").alias("symbol"), day,
        F.when(late, F.date_add(day, 220)).otherwise(F.date_add(day, (20 + key % 30).cast("int"))).alias("as_of"),
        F.when(F.col("turn") % 4 != 0, F.when(late, F.col("roe") * 1.25).otherwise(F.col("roe"))).alias("returnOnEquity"),
        F.when(~late, F.col("margin")).alias("profitMargins"),
        F.when(key % 7 != 0, F.col("growth")).alias("earningsGrowth"),
        F.when(F.col("turn") % 3 != 0, (F.col("n") * 10 + key % 11 + F.when(late, 5).otherwise(0)).cast("double")).alias("debtToEquity"),
        F.when((F.col("turn") % 5 != 0) | late, F.when(late, F.col("eps") * 0.9).otherwise(F.col("eps"))).alias("trailingEps"),
    )


def event_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily return pairs: event type = strategy, all events = benchmark."""
    daily = (
        table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("date"))
        .agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    )
    bench = daily.groupBy("date").agg((F.sum("s") / F.sum("n")).alias("b"))
    return daily.join(bench, "date").select(
        F.col("event_type").alias("strategy"), "date",
        ((F.col("s") / F.col("n") - 50) / 1000).alias("ret"), ((F.col("b") - 50) / 1000).alias("bench_ret"),
    )


def raw_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-shaped constituent rows: page column names, dotted symbols, some unreadable dates."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    places = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((F.col("s_suppkey") * 131) % 9000).cast("int")).cast("string")
    return s.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(symbol_of("s_suppkey"), F.when(F.col("s_suppkey") % 6 == 0, ".B").otherwise("")).alias("Symbol"),
        F.col("s_name").alias("Security"), F.col("r_name").alias("GICS Sector"), F.col("n_name").alias("GICS Sub-Industry"),
        F.col("n_name").alias("Headquarters Location"),
        F.when(F.col("s_suppkey") % 11 == 0, F.lit("unknown")).otherwise(day).alias("Date added"),
        F.col("s_suppkey").alias("CIK"), F.lit("1901").alias("Founded"),
    )


def raw_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven positional columns from orders: date text, two tickers with names, reason and its overflow."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(key % 13 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("c0"),
        F.when(key % 2 == 0, F.concat(F.lit("C."), F.col("o_custkey").cast("string"))).alias("c1"), F.lit("in").alias("c2"),
        F.when(key % 3 == 0, F.concat(F.lit("D."), F.col("o_custkey").cast("string"))).alias("c3"), F.lit("out").alias("c4"),
        F.concat(F.lit("  "), F.col("o_orderpriority")).alias("c5"), F.when(key % 17 == 0, F.lit(" moved ")).alias("c6"),
    )


def raw_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several time-stamped counts per user and day from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").alias("raw_ts"),
        F.when(F.col("event_id") % 19 != 0, F.col("event_id").cast("double")).alias("shares"),
    )
