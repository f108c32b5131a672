"""Shared inputs of every study: lazily derived tables plus the counted axes."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry import schemas
from basketry.functions.columns import feed_symbol
from basketry.operators import calendar as cal_ops, costs, factors, fits, fundamentals as known, marketcap, membership, regime, stats, valuation, weights
from basketry.session import materialize, tune
from basketry.sizing import Calendar, Schedule
from basketry.sources import fixtures
from basketry.sources.store import PriceStore


@dataclass(frozen=True)
class Settings:
    """Every behavioural constant, with the published defaults."""

    periods_per_year: int = 252
    lookback: int = 252
    max_weight: float = 0.05
    momentum_lookback: int = 252
    momentum_skip: int = 21
    low_vol_window: int = 90
    ic_horizon: int = 21
    ic_lookback: int = 126
    ic_min_names: int = 10
    embargo: int = 21
    tilt_strength: float = 0.5
    regime_window: int = 21
    regime_ticker: str | None = None
    thresholds: str = "full"
    min_regime_days: int = 30
    volume_window: int = 63
    vol_window: int = 21
    impact_y: float = 1.0
    aums: tuple[float, ...] = (1e7, 1e8, 1e9)
    block_length: int = 20
    n_resamples: int = 2000
    confidence: float = 0.95
    te_limit: float = 0.05
    drawdown_limit: float = 0.10
    fill: str = "none"
    vol_basis: str = "annual"
    liquidity_as_of: str = "end"
    vol_last_valid: bool = False
    bridge_gaps: bool = False
    adjust_benchmark: bool = True
    min_forward_days: int = 5
    max_missing_benchmark: float = 0.2
    infeasible: str = "error"
    source: str = "hash"

    def as_map(self) -> dict[str, str]:
        return {k: str(v) for k, v in self.__dict__.items()}


# The supplied tables have 83 monthly rows, so windows are short.
MONTHLY = Settings(
    periods_per_year=12, lookback=12, max_weight=0.25, momentum_lookback=12, momentum_skip=1, low_vol_window=6,
    ic_horizon=1, ic_lookback=6, embargo=0, regime_window=21, min_regime_days=5, volume_window=6, vol_window=6, block_length=6,
    n_resamples=2000, aums=(1e3, 1e4, 1e5), min_forward_days=2, te_limit=0.2, drawdown_limit=0.10, infeasible="skip", source="lcg",
)


@dataclass
class Market:
    """Input tables. ``prices`` has ``symbol, date, pos, close, volume``; the rest follow ``schemas``.

    The price panel is cached, or lies in a store, hashed by symbol. Results that several studies share are
    written once to the shared folder, which also keeps the plans built on them short.
    """

    spark: SparkSession
    prices: DataFrame
    cal: Calendar
    schedule: Schedule
    constituents: DataFrame
    changes: DataFrame
    shares: DataFrame
    anchors: DataFrame | None
    fundamentals: DataFrame
    index_level: DataFrame
    settings: Settings = field(default_factory=Settings)
    index_panel: DataFrame | None = None  # index levels on the panel's own dates, where those are not the index's
    held: tuple[DataFrame, ...] = ()  # cached tables that ``release`` gives up
    counted: int | None = None  # symbols of the panel, where they are counted already

    def with_settings(self, **changes) -> "Market":
        return replace(self, settings=replace(self.settings, **changes))

    @cached_property
    def n_symbols(self) -> int:
        """Symbols of the panel, counted when a study first needs them; one that reads no prices does not build the panel."""
        return _symbols(self.prices) if self.counted is None else self.counted

    @cached_property
    def segments(self) -> DataFrame:
        return materialize(cal_ops.holding_segments(self.schedule, self.cal, self.settings.bridge_gaps), "segments")

    @cached_property
    def held_segments(self) -> DataFrame:
        """Segments with a following rebalance."""
        return self.segments.where("NOT is_last")

    @cached_property
    def members(self) -> DataFrame:
        return materialize(membership.membership_history(self.schedule, self.constituents, self.changes), "members")

    @cached_property
    def spans(self) -> DataFrame:
        """Quotes merged with the holding segments, for every valuation."""
        return cal_ops.held_spans(self.prices, self.segments, self.schedule, self.cal)

    @cached_property
    def returns(self) -> DataFrame:
        return cal_ops.simple_returns(self.prices, self.cal, self.settings.fill)

    @cached_property
    def caps(self) -> DataFrame:
        return marketcap.market_caps(self.prices, self.shares, self.anchors, self.cal.rows)

    @cached_property
    def start_caps(self) -> DataFrame:
        """Unfilled caps on the segment starts: rebalances x symbols, reused by most studies. Only quotes of those days meet the share counts."""
        starts = self.schedule.hint(self.segments.select(F.col("sp").alias("pos")).distinct())
        caps = marketcap.market_caps(self.prices.join(starts, "pos", "left_semi"), self.shares, self.anchors, self.cal.rows)
        rows = cal_ops.at_segment_start(caps, self.segments, self.schedule)
        return materialize(rows.select("rebalance_date", "symbol", "pos", "close", "market_cap"), "start_caps")

    @cached_property
    def start_prices(self) -> DataFrame:
        return cal_ops.at_segment_start(self.prices, self.segments, self.schedule)

    @cached_property
    def cap_weights(self) -> DataFrame:
        return materialize(weights.cap_weights(self.members, self.start_caps, self.schedule), "cap_weights")

    @cached_property
    def sectors(self) -> DataFrame:
        return self.constituents.select(feed_symbol("symbol").alias("symbol"), "gics_sector")

    @cached_property
    def benchmark_values(self) -> DataFrame:
        """Full-replication value series; one row per date, kept because every study reads it."""
        return materialize(
            valuation.replication_values(self.cap_weights, self.spans, self.cal), "benchmark_values"
        )

    @cached_property
    def benchmark_returns(self) -> DataFrame:
        return valuation.value_returns(self.benchmark_values).drop("strategy")

    @property
    def dated(self) -> bool:
        """Whether fundamentals carry the day they became public; a snapshot holds for all dates."""
        return known.is_dated(self.fundamentals)

    @cached_property
    def quality(self) -> DataFrame:
        """``(symbol, score)`` of a snapshot, ``(rebalance_date, symbol, score)`` of dated fundamentals."""
        if self.dated:
            return materialize(known.quality_at_rebalances(self.fundamentals, self.schedule), "quality")
        return materialize(factors.quality_scores(self.fundamentals), "quality")

    # --- factors ------------------------------------------------------------------------

    @cached_property
    def forward(self) -> DataFrame:
        return factors.forward_returns(self.prices, self.settings.ic_horizon)

    @cached_property
    def raw_factors(self) -> dict[str, DataFrame]:
        """``(symbol, pos, raw)`` of the factors that are z-scored on each date."""
        s = self.settings
        return {
            "momentum": factors.raw_momentum(self.prices, self.cal, s.momentum_lookback, s.momentum_skip),
            "low_vol": factors.raw_low_vol(self.returns, s.low_vol_window, s.periods_per_year),
            "value": known.raw_value_known(self.prices, self.fundamentals) if self.dated else factors.raw_value(self.prices, self.fundamentals),
        }

    @cached_property
    def scored_factors(self) -> dict[str, DataFrame]:
        """Panel factors that come as scores."""
        return {"quality": known.quality_panel(self.fundamentals, self.cal)} if self.dated else {}

    @cached_property
    def factor_panels(self) -> dict[str, DataFrame]:
        return {name: factors.zscore_by_date(raw, self.cal) for name, raw in self.raw_factors.items()} | self.scored_factors

    @cached_property
    def constant_factors(self) -> dict[str, DataFrame]:
        return {} if self.dated else {"quality": self.quality}

    @property
    def factor_names(self) -> list[str]:
        return [*self.factor_panels, *self.constant_factors]

    @cached_property
    def factor_scores(self) -> DataFrame:
        """All panel factors in long form, read by the coefficients and by every composite.

        The raw values are stored, so their windows run once for the moments of each date and the scores alike.
        """
        raws = materialize(factors.stack(self.raw_factors, "raw"), "factor_raws")
        moments = materialize(factors.date_moments(raws, ["factor", "pos"]), "factor_moments")  # a row per factor and date
        scores = factors.scored(raws, moments, self.cal, ["factor", "pos"])
        if not self.scored_factors:
            return scores
        return scores.unionByName(materialize(factors.stack_scores(self.scored_factors), "scored_factors"))

    @cached_property
    def factor_pairs(self) -> DataFrame:
        return factors.pair_with_forward(self.factor_scores, self.constant_factors, self.forward)

    @cached_property
    def ic(self) -> DataFrame:
        """One row per factor and date."""
        return materialize(
            factors.information_coefficients(self.factor_pairs, self.settings.ic_min_names, self.n_symbols), "ic"
        )

    @cached_property
    def ic_weights(self) -> DataFrame:
        s = self.settings
        return materialize(
            factors.trailing_ic_weights(self.ic, self.segments, self.factor_names, self.schedule, s.ic_lookback, s.embargo), "ic_weights"
        )

    @cached_property
    def start_scores(self) -> DataFrame:
        return factors.scores_at_segment_start(self.factor_scores, self.constant_factors, self.segments, self.schedule)

    @cached_property
    def composite(self) -> DataFrame:
        return materialize(
            factors.composite_scores(self.start_scores, self.ic_weights, self.schedule, len(self.factor_names)), "composite"
        )

    # --- variants that need no fitting ----------------------------------------------------

    @cached_property
    def held_members(self) -> DataFrame:
        return self.members.join(self.schedule.hint(self.held_segments.select("rebalance_date")), "rebalance_date", "left_semi")

    @cached_property
    def equal_weights(self) -> DataFrame:
        return materialize(weights.equal_weights(self.held_members, self.start_prices, self.schedule), "equal_weights")

    @cached_property
    def quality_weights(self) -> DataFrame:
        return materialize(weights.quality_weights(self.held_members, self.quality, self.schedule), "quality_weights")

    @cached_property
    def tilt_weights(self) -> DataFrame:
        return materialize(
            weights.tilt_weights(self.held_members, self.composite, self.start_caps, self.schedule, self.settings.tilt_strength), "tilt_weights"
        )

    def weights_of(self, strategy: str) -> DataFrame:
        """One variant's weights; nothing that only other variants need is computed."""
        part = {"equal_weight": "equal_weights", "quality": "quality_weights", "multi_factor": "tilt_weights", "min_vol": "min_vol_weights"}[strategy]
        return getattr(self, part).select(F.lit(strategy).alias("strategy"), "rebalance_date", "symbol", "weight")

    @cached_property
    def rule_weights(self) -> DataFrame:
        """Equal, quality and tilted weights at every rebalance but the last."""
        return self.weights_of("equal_weight").unionByName(self.weights_of("quality")).unionByName(self.weights_of("multi_factor"))

    def simulate(self, held_weights: DataFrame) -> DataFrame:
        """Chained value of held weights, each segment rebased at its start."""
        return valuation.simulate(held_weights, self.spans, self.cal, normalize=True)

    @cached_property
    def rule_values(self) -> DataFrame:
        return materialize(self.simulate(self.rule_weights), "rule_values")

    @cached_property
    def rule_returns(self) -> DataFrame:
        """Returns of the rule-based variants together with full replication."""
        own = valuation.value_returns(self.rule_values)
        return own.unionByName(self.benchmark_returns.withColumn("strategy", F.lit("full_replication")))

    @cached_property
    def rule_weights_all(self) -> DataFrame:
        full = self.cap_weights.withColumn("strategy", F.lit("full_replication"))
        return self.rule_weights.unionByName(full)

    # --- fitted weights -------------------------------------------------------------------

    @cached_property
    def histories(self) -> DataFrame:
        """Complete trailing return arrays, members x rebalances, read by every fit."""
        return materialize(
            fits.trailing_histories(self.returns, self.members, self.segments, self.schedule, self.settings.lookback), "histories"
        )

    @cached_property
    def fit_benchmark(self) -> DataFrame:
        s = self.settings
        return materialize(fits.trailing_benchmark(
            self.segments, self.benchmark_returns, self.cal, self.schedule, s.lookback, s.max_missing_benchmark, s.min_forward_days
        ), "fit_benchmark")

    @cached_property
    def lasso_paths(self) -> DataFrame:
        """Coefficients at every penalty of every evaluated rebalance."""
        return materialize(fits.lasso_paths(self.histories, self.fit_benchmark, self.n_symbols, self.settings.lookback, self.schedule), "lasso_paths")

    @cached_property
    def shrunk(self) -> DataFrame:
        held = self.histories.join(self.schedule.hint(self.held_segments.select("rebalance_date")), "rebalance_date", "left_semi")
        return materialize(fits.shrinkage(held, self.settings.lookback), "shrunk")

    @cached_property
    def min_vol_status(self) -> DataFrame:
        """Every rebalance with candidates, solved or not."""
        held = self.histories.join(self.schedule.hint(self.held_segments.select("rebalance_date")), "rebalance_date", "left_semi")
        names, specs, keys = fits.minimum_variance_problems(held, self.shrunk, self.settings.max_weight, self.settings.lookback, self.schedule)
        return fits.fit_status(names, specs, keys, self.n_symbols)

    @cached_property
    def min_vol_weights(self) -> DataFrame:
        s = self.settings
        held = self.histories.join(self.schedule.hint(self.held_segments.select("rebalance_date")), "rebalance_date", "left_semi")
        names, specs, keys = fits.minimum_variance_problems(held, self.shrunk, s.max_weight, s.lookback, self.schedule)
        return materialize(fits.solve_quadratic(names, specs, keys, self.n_symbols, s.lookback, s.infeasible), "min_vol")

    @cached_property
    def variant_weights(self) -> DataFrame:
        """All four variants at every rebalance but the last."""
        return self.rule_weights.unionByName(self.weights_of("min_vol"))

    @cached_property
    def variant_values(self) -> DataFrame:
        fitted = self.simulate(self.weights_of("min_vol"))
        return self.rule_values.unionByName(materialize(fitted, "min_vol_values"))

    @cached_property
    def variant_returns(self) -> DataFrame:
        return valuation.value_returns(self.variant_values)

    @cached_property
    def all_returns(self) -> DataFrame:
        return self.variant_returns.unionByName(self.benchmark_returns.withColumn("strategy", F.lit("full_replication")))

    @cached_property
    def all_weights(self) -> DataFrame:
        return self.variant_weights.unionByName(self.cap_weights.withColumn("strategy", F.lit("full_replication")))

    @cached_property
    def all_changes(self) -> DataFrame:
        """Trades of every strategy, read by the costs and by the turnover."""
        return materialize(self.changes_of(self.all_weights), "all_changes")

    @cached_property
    def all_costs(self) -> DataFrame:
        s = self.settings
        return materialize(costs.trade_costs(self.all_changes, self.liquidity, s.aums, s.impact_y), "all_costs")

    @cached_property
    def all_adjusted(self) -> DataFrame:
        """Cost-adjusted returns; the benchmark is charged too unless parity with uncharged tables is asked for."""
        charged = self.all_costs
        if not self.settings.adjust_benchmark:
            charged = charged.withColumn("cost_fraction", F.when(F.col("strategy") == "full_replication", 0.0).otherwise(F.col("cost_fraction")))
        return materialize(costs.apply_costs(self.all_returns, charged), "all_adjusted")

    # --- regimes and costs ----------------------------------------------------------------

    @cached_property
    def labels(self) -> DataFrame:
        s = self.settings
        return materialize(regime.regime_labels(self.index_level, s.regime_window, ticker=s.regime_ticker, thresholds=s.thresholds), "labels")

    @cached_property
    def liquidity(self) -> DataFrame:
        s = self.settings
        if s.liquidity_as_of == "rebalance":
            return costs.liquidity_at_rebalance(
                self.prices, self.segments, self.cal, s.volume_window, s.vol_window, s.periods_per_year, s.vol_basis
            )
        return costs.liquidity_at_end(
            self.prices, self.cal, s.volume_window, s.vol_window, s.periods_per_year, s.vol_last_valid, s.vol_basis
        )

    def changes_of(self, held_weights: DataFrame) -> DataFrame:
        return costs.weight_changes(held_weights, self.schedule.n * 64)

    def costs_of(self, held_weights: DataFrame, aums=None) -> DataFrame:
        return costs.trade_costs(self.changes_of(held_weights), self.liquidity, aums or self.settings.aums, self.settings.impact_y)

    @cached_property
    def rule_costs(self) -> DataFrame:
        """A few rows per rebalance, shared by every cost-adjusted study."""
        return materialize(self.costs_of(self.rule_weights_all), "rule_costs")

    @cached_property
    def rule_adjusted(self) -> DataFrame:
        return materialize(costs.apply_costs(self.rule_returns, self.rule_costs), "rule_adjusted")

    def release(self) -> None:
        for table in (self.prices, self.cal.rows, *self.held):
            table.unpersist()


def numbered_prices(raw: DataFrame, dates: DataFrame | None = None, dealt: bool = False) -> tuple[DataFrame, Calendar, int]:
    """Attach ``pos`` and keep the panel hashed by symbol, the key of every later window and join.

    ``dates`` may give the trading dates from a cheaper source than the panel itself. ``dealt`` says that ``raw`` is hashed
    by symbol already, by a store of buckets or a cache; it is then used as it is.
    """
    prices, cal = _dealt(raw, dates, dealt)
    return prices, cal, _symbols(prices)


def _dealt(raw: DataFrame, dates: DataFrame | None, dealt: bool = False) -> tuple[DataFrame, Calendar]:
    cal = cal_ops.trading_calendar(raw if dates is None else dates)
    prices = cal_ops.number_dates(raw, cal)
    return prices if dealt else prices.repartition("symbol").persist(), cal


def _symbols(prices: DataFrame) -> int:
    return prices.select("symbol").distinct().count()


def _checked(name: str, table: DataFrame, keys: list[str]) -> None:
    found = schemas.key_violations(table, keys).first()
    if found["null_keys"] or found["duplicate_keys"]:
        raise ValueError(f"{name}: {found['null_keys']} rows with a null key, {found['duplicate_keys']} keys more than once")


def build_market(
    prices: DataFrame | PriceStore, constituents: DataFrame, changes: DataFrame, shares: DataFrame, fundamentals: DataFrame,
    index_level: DataFrame, start: str, end: str, anchors: DataFrame | None = None, settings: Settings = Settings(), buffer_days: int = 400,
) -> Market:
    """A market over a user's own tables. Price, share and fundamentals symbols are feed symbols; the
    constituent list and change log may use listing symbols (``BRK.B``), which are normalised to match. Fundamentals
    with a column ``as_of`` are used as they were known on each date, others as a snapshot that holds throughout.

    Only prices from ``buffer_days`` before ``start`` up to ``end`` are read, so a study of two years does not scan
    the whole history; a key that is null or occurs twice in a table is an error. A table of prices is dealt by symbol
    once, before its keys are checked, and cached; a ``PriceStore`` lies by symbol and year and is read as it lies."""
    stored = isinstance(prices, PriceStore)
    spark = tune(prices.spark if stored else prices.sparkSession)
    schemas.require_columns(constituents, "symbol STRING, gics_sector STRING")
    schemas.require_columns(changes, "effective_date DATE, added_ticker STRING, removed_ticker STRING")
    schemas.require_columns(shares, schemas.SHARES)
    schemas.require_columns(index_level, schemas.INDEX_LEVEL)
    first, last = dt.date.fromisoformat(start) - dt.timedelta(days=buffer_days), dt.date.fromisoformat(end)
    window = F.col("date").between(F.lit(first), F.lit(last))
    if stored:
        by_symbol = prices.read(first, last)
    else:
        schemas.require_columns(prices, "symbol STRING, date DATE, close DOUBLE, volume DOUBLE")
        by_symbol = prices.select("symbol", "date", "close", "volume").where(window).repartition("symbol").persist()
    index_level = index_level.where(window)
    _checked("prices", by_symbol, ["symbol", "date"])
    _checked("index levels", index_level, ["ticker", "date"])
    panel, cal, n_symbols = numbered_prices(by_symbol, dealt=True)
    return Market(
        spark=spark, prices=panel, cal=cal, counted=n_symbols, schedule=cal_ops.quarterly_schedule(spark, start, end),
        constituents=constituents, changes=changes, shares=shares, anchors=anchors, fundamentals=fundamentals,
        index_level=index_level, settings=settings, held=() if stored else (by_symbol,),
    )


_markets: dict[tuple, Market] = {}


def supplied_market(spark: SparkSession, sf_dir: str, settings: Settings = MONTHLY) -> Market:
    """The market derived from the supplied tables, built once per session and folder."""
    key = (spark.sparkContext.applicationId, id(spark._jsparkSession), sf_dir, settings)
    if key not in _markets:
        tune(spark)
        prices, cal = _dealt(fixtures.prices(spark, sf_dir), fixtures.price_dates(spark, sf_dir))
        _markets[key] = Market(
            spark=spark, prices=prices, cal=cal,
            schedule=cal_ops.calendar_schedule(cal, settings.lookback),
            constituents=fixtures.constituents(spark, sf_dir), changes=fixtures.changes(spark, sf_dir, cal),
            shares=fixtures.shares(spark, sf_dir, cal), anchors=fixtures.share_anchors(spark, sf_dir),
            fundamentals=fixtures.fundamentals(spark, sf_dir), index_level=fixtures.index_level(spark, sf_dir),
            settings=settings, index_panel=fixtures.index_level_monthly(spark, sf_dir),
        )
    return _markets[key]


def release_supplied() -> None:
    """Unpersist every market that ``supplied_market`` has built and forget it."""
    for market in _markets.values():
        market.release()
    _markets.clear()
