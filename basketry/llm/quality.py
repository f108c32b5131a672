"""Quality rules: fixed rules first, then robust multivariate outliers per language and source.

Every text gives five counts, transformed to logarithms of length, mean word length and three rates, in thousandths. The
minimum-covariance-determinant estimate of each group is found by concentration steps on pre-aggregated vectors: start
from medians and median deviations, then again and again keep the nearest half of the group and take their mean and
covariance, until no group's half changes or STEPS are done. Equal vectors count once, so copies have no weight of their
own. Nearest is told by fine bins of the distance, whole bins at a time, so ties stay together and no group is sorted in
one place; a half may go on changing by a few vectors of its last bin. Sums are of integers, so results do not depend on
the order of tasks.

A floor under each standard deviation keeps a group in which most values are equal from rejecting every other value.
Groups of all sizes have one rule: the moments of a source with n different vectors are mixed n to SHRINK with those of
its language, which are mixed likewise with those of the table. A table of fewer than LEAST_POOL vectors rejects nothing.

Defined results: null or empty texts have counts of 0 and fail the fixed rules; null languages and sources are groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import Powers, arrow_map, carried, named, slices, texts, unpacked, window_hashes, with_text, word_hashes
from basketry.session import materialize

LEAST_WORDS = 50
MOST_REPEATED = 0.5
STEPS = 16
SHRINK = 100
LEAST_POOL = 30
COVERAGE = 0.5
# Makes the covariance of the nearest half of five normal variables consistent
# (0.5 over the chance that chi-square with 7 degrees is below the 0.5 quantile with 5 degrees), and the cut-off
# (the 0.9999 quantile of chi-square with 5 degrees).
CONSISTENT = 1.9122
CUTOFF = 25.745
# Least standard deviation of each statistic, in thousandths: words, word length, symbols, repeated lines, repeated words.
# Among clean prose a text with 40 % repeated lines, 6 % symbols or 25 % repeated words is beyond CUTOFF.
FLOORS = (300, 60, 350, 600, 450)

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
VECTOR = tuple(f"x{i}" for i in range(5))
_PAIRS = [(i, j) for i in range(5) for j in range(i + 1)]


def counts_of(text: bytes | None, spelling: Powers, powers: Powers) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    characters = len(text.decode(errors="replace")) - (len(text) - len(text.translate(None, SPACE)))
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    repeated = 0
    if len(words) > 3:
        windows = window_hashes(word_hashes(text, spelling), 3, powers)
        _, index, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = times[index] > 1
        cover = np.zeros(len(words), bool)
        for k in range(3):
            cover[k:k + len(twice)] |= twice
        repeated = int(cover.sum())
    return len(words), characters, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measure(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (carried columns) and the counts of every text."""
    source = with_text(docs, text, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, powers = Powers(1), Powers(0)
        for batch in slices(batches):
            found = np.array([counts_of(t, spelling, powers) for t in texts(batch)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, found.T.copy())], names=["row", *COUNTS])

    return arrow_map(source, run, carried(source, ["row"], ", ".join(f"{c} long" for c in COUNTS)))


def _vector() -> list:
    """The transformed statistics in thousandths."""
    thousandths = lambda x: F.round(x * 1000).cast("long")
    rate = lambda n, of: thousandths(F.log1p(100 * F.col(n) / (F.col(of) + 1)))
    values = (
        thousandths(F.log1p("n_words")), thousandths(F.log1p(F.col("word_chars") / (F.col("n_words") + 1))),
        rate("n_symbols", "word_chars"), rate("n_dup_lines", "n_lines"), rate("n_repeat_words", "n_words"),
    )
    return [v.alias(n) for v, n in zip(values, VECTOR)]


def _keys() -> list:
    """The table, the language and the source that a document belongs to, as texts."""
    return [F.lit("all").alias("g0"), F.to_json(F.struct("lang")).alias("g1"), F.to_json(F.struct(F.lit(2).alias("n"), "lang", "source")).alias("g2")]


def _solved(moments: DataFrame) -> DataFrame:
    """(g, n, mean, inverse) from sums of weights, values and products; the inverse as its 15 lower entries."""
    sums = [f"s{i}" for i in range(5)]
    products = [f"p{i}{j}" for i, j in _PAIRS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.float64)
            mean = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in sums], axis=1).reshape(-1, 5) / n[:, None]
            covariance = np.zeros((len(n), 5, 5))
            for (i, j), p in zip(_PAIRS, products):
                value = batch.column(p).to_numpy(zero_copy_only=False) / n - mean[:, i] * mean[:, j]
                covariance[:, i, j] = covariance[:, j, i] = value
            covariance = CONSISTENT * covariance + np.diag(np.square(FLOORS).astype(float))
            inverse = np.linalg.inv(covariance)
            lower = np.stack([inverse[:, i, j] for i, j in _PAIRS], axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column("g"), pa.FixedSizeListArray.from_arrays(mean.ravel(), 5).cast(pa.list_(pa.float64())),
                pa.FixedSizeListArray.from_arrays(lower.ravel(), len(_PAIRS)).cast(pa.list_(pa.float64())),
            ], names=["g", "mean", "inverse"])

    return arrow_map(moments, run, "g string, mean array<double>, inverse array<double>")


def _distance():
    """Squared Mahalanobis distance of a vector from its group's ``mean`` under ``inverse``."""
    off = [F.col(v) - F.col("mean")[i] for i, v in enumerate(VECTOR)]
    terms = [F.col("inverse")[k] * off[i] * off[j] * (1 if i == j else 2) for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def _start(vectors: DataFrame) -> DataFrame:
    """Medians, and median deviations (times 1.4826) as standard deviations; exact, since values are on a grid."""
    middle = vectors.groupBy("g").agg(F.array(*[F.percentile(v, F.lit(0.5), F.col("w")) for v in VECTOR]).alias("mean"))
    off = vectors.join(middle, "g").select("g", "mean", "w", *[F.abs(F.col(v) - F.col("mean")[i]).alias(v) for i, v in enumerate(VECTOR)])
    spread = off.groupBy("g").agg(F.first("mean").alias("mean"), *[F.percentile(v, F.lit(0.5), F.col("w")).alias(v) for v in VECTOR])
    entry = lambda i: 1 / (F.pow(1.4826 * F.col(VECTOR[i]), F.lit(2)) + float(FLOORS[i] ** 2))
    return spread.select("g", "mean", F.array(*[entry(i) if i == j else F.lit(0.0) for i, j in _PAIRS]).alias("inverse"))


def estimates(vectors: DataFrame, least: int = LEAST_POOL) -> DataFrame:
    """(g, mean, inverse) of every group of ``vectors`` (g, x0..x4, w) with ``least`` documents or more."""
    sizes = vectors.groupBy("g").agg(F.sum("w").alias("size")).filter(F.col("size") >= least)
    found = materialize(_start(vectors.join(sizes.select("g"), "g")), "start")
    for _ in range(STEPS):
        placed = vectors.join(found, "g").select("g", *VECTOR, "w", F.floor(32 * F.log2(_distance() + 1e-6)).cast("int").alias("bin"))
        bins = placed.groupBy("g", "bin").agg(F.sum("w").alias("w"))
        running = F.sum("w").over(Window.partitionBy("g").orderBy("bin"))
        last = bins.withColumn("within", running).join(sizes, "g").filter(F.col("within") >= COVERAGE * F.col("size")).groupBy("g").agg(F.min("bin").alias("last"))
        near = placed.join(last, "g").filter("bin <= last")
        moments = near.groupBy("g").agg(
            F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(v)).alias(f"s{i}") for i, v in enumerate(VECTOR)],
            *[F.sum(F.col("w") * F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{i}{j}") for i, j in _PAIRS],
        )
        before, found = found.select("g", F.col("mean").alias("mean_"), F.col("inverse").alias("inverse_")), materialize(_solved(moments), "estimate")
        if found.join(before, "g").filter("mean != mean_ OR inverse != inverse_").isEmpty():
            break
    return found


def _full(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, means and covariances of the estimates of one level."""
    inverse = np.zeros((batch.num_rows, 5, 5))
    lower = np.array(batch.column(f"inverse{k}").to_pylist(), float).reshape(-1, len(_PAIRS))
    for (i, j), values in zip(_PAIRS, lower.T):
        inverse[:, i, j] = inverse[:, j, i] = values
    return batch.column(f"n{k}").to_numpy().astype(float), np.array(batch.column(f"mean{k}").to_pylist(), float).reshape(-1, 5), np.linalg.inv(inverse)


def shrunk(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """(g, mean, inverse) of every group of ``groups`` (g0, g1, g2), each level mixed with the one above it."""
    sizes = vectors.groupBy("g").agg(F.sum("w").alias("n"))
    found = materialize(estimates(vectors, 1).join(sizes, "g"), "sized")
    for k in range(3):
        level = found.select(F.col("g").alias(f"g{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("n", "mean", "inverse")])
        groups = groups.join(level, f"g{k}")
    groups = groups.filter(F.col("n0") >= LEAST_POOL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, mean, covariance = _full(batch, 0)
            for k in (1, 2):
                n, own, spread = _full(batch, k)
                part = n / (n + SHRINK)
                off = own - mean
                mean = mean + part[:, None] * off
                between = (part * (1 - part))[:, None, None] * off[:, :, None] * off[:, None, :]
                covariance = part[:, None, None] * spread + (1 - part)[:, None, None] * covariance + between
            inverse = np.linalg.inv(covariance)
            lower = np.stack([inverse[:, i, j] for i, j in _PAIRS], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("g2"), pa.array(mean.tolist(), pa.list_(pa.float64())), pa.array(lower.tolist(), pa.list_(pa.float64()))], names=["g", "mean", "inverse"])

    return arrow_map(groups, run, "g string, mean array<double>, inverse array<double>")


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``row`` (carried columns), the counts, ``base_failed``, ``distance`` (null without an estimate) and ``kept``."""
    groups = docs.select(*named(docs, *docs.columns))
    held = measure(groups.select(
        F.struct(*named(docs, *(docs.columns if keep is None else keep))).alias("row"), named(docs, lang)[0].cast("string").alias("lang"),
        named(docs, source)[0].cast("string").alias("source"), named(docs, text)[0].alias("text"),
    ), keep=["row", "lang", "source"]).select("row.*", *COUNTS)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = materialize(held.withColumn("base_failed", failed).select("*", *_vector()), "measured")
    passing = rows.filter("NOT base_failed").select(*_keys(), *VECTOR)
    vectors = passing.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *VECTOR).distinct().withColumn("w", F.lit(1).cast("long"))
    found = materialize(shrunk(passing.select("g0", "g1", "g2").distinct(), materialize(vectors, "vectors")), "shrunk")
    found = rows.withColumn("g", _keys()[2]).join(found, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return found.select("row", *COUNTS, "base_failed", "distance", kept.alias("kept"))


def accept(docs: DataFrame, **options) -> DataFrame:
    """The kept documents with their own columns."""
    return unpacked(judge(docs, **options).filter("kept"))


def digest(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, kept and distance of every document."""
    return unpacked(judge(docs, keep=[doc_id], **options), *COUNTS[:5], "base_failed", "kept", "distance")
