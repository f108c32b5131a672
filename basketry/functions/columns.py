"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def feed_symbol(c: ColumnLike) -> Column:
    """Listing symbol to data-feed symbol: class suffix dot becomes a dash, null stays null."""
    return F.translate(_col(c), ".", "-")


def finite(c: ColumnLike) -> Column:
    """NaN and infinities become null."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """``a / b``, null where ``b`` is zero or either side is null."""
    return F.try_divide(_col(a), _col(b))


def clip(c: ColumnLike, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a column; null stays null (``greatest``/``least`` alone would skip it)."""
    c = _col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def compounded_from_mean(mean: ColumnLike, periods_per_year: float) -> Column:
    """Annual return from a mean period return, ``(1 + mean)^periods - 1``."""
    return F.pow(1 + _col(mean), F.lit(float(periods_per_year))) - 1


def impact_fraction(trade_value: ColumnLike, vol: ColumnLike, dollar_volume: ColumnLike, y: float = 1.0) -> Column:
    """Square-root market impact as a fraction of the trade; null without usable liquidity."""
    vol, adv = _col(vol), _col(dollar_volume)
    rate = F.abs(_col(trade_value)) / adv
    return F.when((adv > 0) & vol.isNotNull(), F.lit(float(y)) * vol * F.sqrt(rate))


def parse_numbers(text: str, kind=float) -> list:
    """Comma-separated query parameter to a list of numbers."""
    return [kind(part) for part in text.split(",")]


def signed_percent(c: ColumnLike) -> Column:
    return F.format_string("%+.2f%%", 100 * _col(c))


def plain_percent(c: ColumnLike) -> Column:
    return F.format_string("%.2f%%", 100 * _col(c))


def dollars(c: ColumnLike) -> Column:
    return F.concat(F.lit("$"), F.format_number(_col(c), 0))
