"""Trading calendar, rebalance schedule, as-of alignment, fills and lags.

Windows and lags count calendar rows (``pos``) shared by all symbols, never the
rows a single symbol happens to have.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from basketry.functions.columns import ratio
from basketry.sizing import Calendar, Schedule


def trading_calendar(dates: DataFrame) -> Calendar:
    """Distinct dates numbered from zero. The count is one small job."""
    rows = (
        dates.select("date").distinct()
        .select((F.row_number().over(W.orderBy("date")) - 1).cast("bigint").alias("pos"), "date")
        .persist()
    )
    return Calendar(rows, rows.count())


def number_dates(df: DataFrame, cal: Calendar) -> DataFrame:
    return df.join(cal.hint(cal.rows), "date")


def quarterly_schedule(spark: SparkSession, start: dt.date | str, end: dt.date | str) -> Schedule:
    """Third Friday of March, June, September and December inside ``[start, end]``."""
    start, end = (dt.date.fromisoformat(d) if isinstance(d, str) else d for d in (start, end))
    quarters = 4 * (end.year - start.year + 1)
    first = F.add_months(F.lit(dt.date(start.year, 3, 1)), (3 * F.col("id")).cast("int"))
    friday = F.date_add(F.next_day(F.date_sub(first, 1), "FRI"), 14)
    rows = (
        spark.range(0, quarters, numPartitions=1).select(friday.alias("rebalance_date"))
        .where(F.col("rebalance_date").between(F.lit(start), F.lit(end)))
    )
    return Schedule(rows, quarters)


def calendar_schedule(cal: Calendar, warmup: int) -> Schedule:
    """The quarterly schedule from the calendar's date after ``warmup`` rows to the end of its last year."""
    bounds = cal.rows.agg(F.min(F.when(F.col("pos") >= min(warmup, cal.last), F.col("date"))).alias("lo"), F.max("date").alias("hi")).first()
    return quarterly_schedule(cal.rows.sparkSession, bounds["lo"], dt.date(bounds["hi"].year, 12, 31))


def as_of(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, take: Sequence[str],
    by: Sequence[str] = (), direction: str = "backward",
) -> DataFrame:
    """For each left row the nearest right row at or before (``backward``) or at or after (``forward``).

    Both timelines are merged and carried over one window per ``by`` key, so no pair
    of rows is ever formed. Left rows without a match keep nulls in ``take``.
    """
    by = list(by)
    left_cols = [c for c in left.columns if c not in by]
    l_struct = F.struct(*left_cols) if left_cols else F.lit(None)
    r_struct = F.struct(*take)
    l_type = left.select(l_struct.alias("x")).schema["x"].dataType
    r_type = right.select(r_struct.alias("x")).schema["x"].dataType
    # On an equal date the right row must come first when looking back, last when looking ahead.
    left_side = 1 if direction == "backward" else 0
    merged = left.select(
        *by, F.col(left_on).alias("_t"), F.lit(left_side).alias("_side"),
        l_struct.alias("_left"), F.lit(None).cast(r_type).alias("_right"),
    ).unionByName(
        right.select(
            *by, F.col(right_on).alias("_t"), F.lit(1 - left_side).alias("_side"),
            F.lit(None).cast(l_type).alias("_left"), r_struct.alias("_right"),
        )
    )
    order = W.partitionBy(*by).orderBy("_t", "_side")
    if direction == "backward":
        found = F.last("_right", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    else:
        found = F.first("_right", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    return (
        merged.withColumn("_found", found).where(F.col("_left").isNotNull())
        .select(*by, *[F.col(f"_left.{c}").alias(c) for c in left_cols], *[F.col(f"_found.{c}").alias(c) for c in take])
    )


def holding_segments(schedule: Schedule, cal: Calendar, bridge_gaps: bool = False) -> DataFrame:
    """``(rebalance_date, next_rebalance, is_last, sp, start_date, ep)`` for dates that have a trading row.

    ``sp`` is the first trading row on or after the rebalance, ``ep`` the last one on
    or before the next rebalance (the end of the calendar for the last). On a
    non-trading rebalance the move between ``ep`` and the next ``sp`` belongs to no
    segment; ``bridge_gaps`` extends the segment to the next start instead.
    """
    ordered = W.orderBy("rebalance_date")
    dates = schedule.rows.select(
        "rebalance_date", F.lead("rebalance_date").over(ordered).alias("next_rebalance")
    ).withColumn("is_last", F.col("next_rebalance").isNull())
    starts = as_of(
        dates, cal.rows.withColumnRenamed("pos", "sp").withColumnRenamed("date", "start_date"),
        "rebalance_date", "start_date", ["sp", "start_date"], direction="forward",
    )
    far = F.lit(dt.date(9999, 12, 31))
    ends = as_of(
        starts.withColumn("_until", F.coalesce("next_rebalance", far)),
        cal.rows.withColumnRenamed("pos", "ep"), "_until", "date", ["ep"],
    ).where("sp IS NOT NULL").drop("_until")
    if bridge_gaps:
        next_start = F.lead("sp").over(W.orderBy("rebalance_date"))
        ends = ends.withColumn("ep", F.greatest("ep", F.coalesce(next_start, F.col("ep"))))
    return ends.where("ep >= sp")


def segment_days(segments: DataFrame) -> DataFrame:
    """One row per segment and trading row in ``[sp, ep]``."""
    return segments.select("rebalance_date", "sp", F.explode(F.sequence("sp", "ep")).alias("pos"))


def trailing_days(segments: DataFrame, window: int, embargo: int = 0) -> DataFrame:
    """The ``window`` trading rows before each segment start, optionally ``embargo`` rows earlier."""
    first = F.greatest(F.col("sp") - window - embargo, F.lit(0))
    last = F.col("sp") - 1 - embargo
    return segments.where(last >= first).select("rebalance_date", "sp", F.explode(F.sequence(first, last)).alias("pos"))


def at_segment_start(panel: DataFrame, segments: DataFrame, schedule: Schedule) -> DataFrame:
    """Panel rows on each segment's first trading row, labelled by rebalance."""
    starts = segments.select("rebalance_date", F.col("sp").alias("pos"))
    return panel.join(schedule.hint(starts), "pos")


def forward_fill(prices: DataFrame, cal: Calendar) -> DataFrame:
    """Dense panel: each quote is repeated on the calendar rows up to the next quote.

    ``quoted`` marks rows that carry a real quote. Nothing precedes a first quote.
    """
    quotes = prices.where("close IS NOT NULL").select("symbol", "pos", "close")
    following = F.lead("pos").over(W.partitionBy("symbol").orderBy("pos"))
    until = F.coalesce(following - 1, F.lit(cal.last).cast("bigint"))
    return (
        quotes.withColumn("_until", until)
        .select("symbol", "close", F.col("pos").alias("_from"), F.explode(F.sequence("pos", "_until")).alias("pos"))
        .select("symbol", "pos", "close", (F.col("pos") == F.col("_from")).alias("quoted"))
    )


def held_spans(prices: DataFrame, segments: DataFrame, schedule: Schedule, cal: Calendar) -> DataFrame:
    """``(rebalance_date, symbol, sp, first, last, close, quoted)``: quotes merged with the holding segments.

    A quote holds from its row to the row before the symbol's next one. Each such span is cut at the segments it meets, so
    a row stands for the days ``first`` to ``last`` of one segment at one price, and no day is written out. ``quoted`` tells
    a span that begins with its quote from one carried into the segment. Segments meet a quote's own row through a table by
    calendar row; only a span with a gap behind it looks for segments that start inside.
    """
    following = F.lead("pos").over(W.partitionBy("symbol").orderBy("pos"))
    spans = prices.where("close IS NOT NULL").select("symbol", "pos", "close", F.coalesce(following - 1, F.lit(cal.last).cast("bigint")).alias("_until"))
    whole = segments.select(F.struct("rebalance_date", "sp", "ep").alias("s"))
    here = segments.select(F.struct("rebalance_date", "sp", "ep").alias("s"), F.explode(F.sequence("sp", "ep")).alias("pos")).groupBy("pos").agg(F.collect_list("s").alias("_here"))
    met = spans.join(cal.hint(here), "pos", "left").withColumn("_all", whole.agg(F.collect_list("s")).scalar())  # bounded by the schedule
    carried = F.filter("_all", lambda s: (s["sp"] > F.col("pos")) & (s["sp"] <= F.col("_until")))
    nothing = F.slice("_all", 1, 0)
    cut = met.select(
        "symbol", "pos", "close", "_until",
        F.explode(F.concat(F.coalesce("_here", nothing), F.when(F.col("_until") > F.col("pos"), carried).otherwise(nothing))).alias("_s"),
    )
    first = F.greatest("pos", "_s.sp")
    return cut.select(
        F.col("_s.rebalance_date").alias("rebalance_date"), "symbol", F.col("_s.sp").alias("sp"), first.alias("first"),
        F.least("_until", "_s.ep").alias("last"), "close", (F.col("pos") == first).alias("quoted"),
    )


def shifted(value: str, offset: int, keys: Sequence[str] = ("symbol",)) -> Column:
    """Value exactly ``offset`` calendar rows away (negative = earlier), null when that row is missing."""
    return F.max(value).over(W.partitionBy(*keys).orderBy("pos").rangeBetween(offset, offset))


def simple_returns(prices: DataFrame, cal: Calendar, fill: str = "none") -> DataFrame:
    """``(symbol, pos, ret)``. ``fill='ffill'`` first carries quotes over interior gaps."""
    panel = prices if fill == "none" else _filled_inside(prices, cal)
    return panel.select("symbol", "pos", (ratio("close", shifted("close", -1)) - 1).alias("ret")).where(
        "ret IS NOT NULL"
    )


def _filled_inside(prices: DataFrame, cal: Calendar) -> DataFrame:
    """Forward fill including the tail after the last quote (a flat line, return 0)."""
    return forward_fill(prices, cal)
