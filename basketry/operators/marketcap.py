"""As-of market caps and data-coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from basketry.functions.columns import ratio


def filed_by_year(shares: DataFrame, last_year: Column, anchors: DataFrame | None = None) -> DataFrame:
    """``(symbol, year, filed)``: the counts that can hold in a year, in order of their filing, the first one from before it.

    All work is on the filings: a count holds until the symbol's next one, and each year of that span gets it. A year
    holds as many counts as were filed in it and one more.
    """
    by_symbol = W.partitionBy("symbol")
    rows = shares.where("shares IS NOT NULL AND filing_date IS NOT NULL").select("symbol", F.col("filing_date").alias("date"), "shares")
    spans = rows.select(
        "symbol", "date", "shares", F.lead("date").over(by_symbol.orderBy("date", "shares")).alias("_next"),
        F.max_by("shares", F.struct("date", "shares")).over(by_symbol).alias("_last"),
    )
    if anchors is not None:
        usable = anchors.where("shares IS NOT NULL AND shares <> 0").select("symbol", F.col("shares").alias("anchor"))
        scale = F.when(F.col("_last") > 0, F.col("anchor") / F.col("_last"))
        spans = spans.join(usable, "symbol", "left").withColumn("shares", F.col("shares") * F.coalesce(scale, F.lit(1.0)))
    first, last = F.year("date"), F.greatest(F.year("date"), F.coalesce(F.year("_next"), last_year))
    years = spans.select("symbol", "date", "shares", F.explode(F.sequence(first, last)).alias("year"))
    return years.groupBy("symbol", "year").agg(F.sort_array(F.collect_list(F.struct("date", "shares"))).alias("filed"))


def market_caps(prices: DataFrame, shares: DataFrame, anchors: DataFrame | None = None, dates: DataFrame | None = None) -> DataFrame:
    """``(symbol, pos, date, close, market_cap)``: close times the last share count filed on or before the date.

    With ``anchors`` a symbol's whole share history is scaled by anchor over its most
    recent filed count. Rows without a filed count yet are left out. The filings come to the quotes, as one row a symbol
    and year, so quotes that are dealt by symbol stay where they are. ``dates`` may give the trading dates from a cheaper
    source than the panel itself.
    """
    last_year = (prices if dates is None else dates).agg(F.max(F.year("date"))).scalar()
    filed = filed_by_year(shares, last_year, anchors).withColumnRenamed("year", "_year")
    held = prices.withColumn("_year", F.year("date")).join(filed, ["symbol", "_year"])
    count = F.try_element_at(F.filter("filed", lambda x: x["date"] <= F.col("date")), F.lit(-1))["shares"]
    return held.select("symbol", "pos", "date", "close", (F.col("close") * count).alias("market_cap")).where("market_cap IS NOT NULL")


def coverage_report(prices: DataFrame, shares: DataFrame) -> DataFrame:
    """One row: priced symbols, those with any filed share count, and the fraction."""
    filed = shares.select("symbol").distinct().withColumn("has_shares", F.lit(1))
    return (
        prices.select("symbol").distinct().join(filed, "symbol", "left")
        .agg(F.count(F.lit(1)).alias("priced_symbols"), F.count("has_shares").alias("market_cap_symbols"))
        .withColumn("coverage_fraction", ratio("market_cap_symbols", "priced_symbols"))
    )


def missing_shares(prices: DataFrame, shares: DataFrame) -> DataFrame:
    """Priced symbols that have no filed share count, as rows."""
    return prices.select("symbol").distinct().join(shares, "symbol", "left_anti")


def rebalance_coverage(members: DataFrame, weights: DataFrame) -> DataFrame:
    """Per rebalance: intended members, weighted members, covered fraction (null when none intended)."""
    held = weights.select("rebalance_date", "symbol", F.lit(1).alias("_held"))
    return (
        members.join(held, ["rebalance_date", "symbol"], "left").groupBy("rebalance_date")
        .agg(F.count(F.lit(1)).alias("intended_members"), F.count("_held").alias("weighted_members"))
        .withColumn("coverage_fraction", ratio("weighted_members", "intended_members"))
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.min("coverage_fraction").alias("min_coverage"), F.max("coverage_fraction").alias("max_coverage"),
        F.avg("coverage_fraction").alias("mean_coverage"), F.count(F.lit(1)).alias("n_rebalances"),
    )
