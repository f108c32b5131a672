"""Token counts from an exact histogram of encoded lengths.

Documents are encoded in parallel and pre-aggregated by length, so one row per distinct length is all that moves. Suffix
sums over those rows then answer, for any context limit, how many documents and tokens fit, how much is left when longer
documents are cut, and which length stands at a quantile.

Defined results: a null or empty text has length 0 and counts as a document; without documents the histogram is empty,
totals are 0 and quantiles are null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from basketry.llm.common import arrow_map, carried, file_bytes, slices, with_text
from basketry.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's own tokenizer splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Lengths that share one running sum; the sums of whole blocks are a second, shorter one.
BLOCK = 4096

_encodings: dict[int, tiktoken.Encoding] = {}


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file, built once in each Python worker."""
    key = hash(vocabulary)
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def lengths(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``row`` (carried columns) and ``n_tokens``."""
    source = with_text(docs, text, keep)
    shared = docs.sparkSession.sparkContext.broadcast(file_bytes(docs.sparkSession, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shared.value).encode_ordinary
        for batch in slices(batches):
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64())], names=["row", "n_tokens"])

    return arrow_map(source, run, carried(source, ["row"], "n_tokens long"))


def histogram(docs: DataFrame, **options) -> DataFrame:
    """(n_tokens, n_docs) for every length that occurs."""
    return lengths(docs, keep=[], **options).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """The histogram, written once, with, for each length taken as a context limit, what lies at, above and below it.

    ``docs_over``/``tokens_over`` count longer documents, ``docs_within``/``tokens_within`` the others; ``truncated_tokens``
    is the total when longer documents are cut at the limit, ``share_within`` the quantile at which the length stands.
    """
    counts = materialize(counts, "histogram").withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in "dt"], *[F.sum(c).over(whole).alias(f"all_{c}") for c in "dt"],
    )
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_d", "all_t",
        (F.col("later_d") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0))).alias("docs_over"),
        (F.col("later_t") + F.coalesce(F.sum("tokens").over(longer), F.lit(0))).alias("tokens_over"),
    )
    within = F.col("all_t") - F.col("tokens_over")
    return out.select(
        "n_tokens", "n_docs", "docs_over", "tokens_over", (F.col("all_d") - F.col("docs_over")).alias("docs_within"), within.alias("tokens_within"),
        (within + F.col("n_tokens") * F.col("docs_over")).alias("truncated_tokens"), ((F.col("all_d") - F.col("docs_over")) / F.col("all_d")).alias("share_within"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> list[Row]:
    """(limit, docs_within, tokens_within, docs_over, truncated_tokens) for any context limits, from the suffix sums."""
    state = F.struct("docs_within", "tokens_within", "docs_over")
    picked = sums.agg(
        *[F.max_by(state, F.when(F.col("n_tokens") <= c, F.col("n_tokens"))).alias(f"l{i}") for i, c in enumerate(limits)], F.sum("n_docs").alias("n"),
    ).first()
    out = []
    for i, c in enumerate(limits):
        docs, tokens, over = picked[f"l{i}"] or (0, 0, picked["n"] or 0)
        out.append(Row(limit=c, docs_within=docs, tokens_within=tokens, docs_over=over, truncated_tokens=tokens + c * over))
    return out


def quantiles(sums: DataFrame, shares: list[float]) -> list[int | None]:
    """The smallest length that at least each share of the documents does not exceed."""
    if not shares:
        return []
    return list(sums.agg(*[F.min(F.when(F.col("share_within") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]).first())
