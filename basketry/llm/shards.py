"""Uniform shuffle into shards of exact size, through a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first, so that all uniform orders stay equally likely
and every shard gets its exact size. Each partition permutes its rows and hands out consecutive runs; each shard spreads
what it gets over buckets, permutes those and numbers its slots. Only the counts (partitions times shards) pass the
driver. Buckets of a shard are drawn independently row by row, so a shard may be of any size.

Defined results: an empty table gives no rows; repeated rows and null ids are rows like any other; with fewer rows than
shards some shards stay empty; where the input has columns of the new names, the new ones get an underscore.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import free, named, unpacked
from basketry.session import materialize

SHARDS = 8
SEED = 20
BUCKET_ROWS = 500_000
# numpy draws from populations below this; above it the probabilities are summed over all counts that can occur.
_NUMPY_MOST = 10 ** 9


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` draws without replacement are good."""
    if good + bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    spread = (mean * (bad / total) * (total - n) / (total - 1)) ** 0.5
    lo, hi = max(0, n - bad, int(mean - 40 * spread) - 40), min(n, good, int(mean + 40 * spread) + 40)
    k = np.arange(lo, hi, dtype=np.float64)
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)  # of the probabilities of k + 1 and k
    log = np.concatenate([[0.0], np.cumsum(ratio)])
    mass = np.cumsum(np.exp(log - log.max()))
    return lo + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def communication_matrix(blocks: list[int], sizes: list[int], rng: np.random.Generator) -> np.ndarray:
    """Rows that each block sends to each shard; row sums are ``blocks``, column sums ``sizes``."""
    left = [int(s) for s in sizes]
    matrix = np.zeros((len(blocks), len(sizes)), np.int64)
    for b, n in enumerate(blocks):
        todo, rest = int(n), sum(left)
        for s in range(len(sizes)):
            if not todo:
                break
            rest -= left[s]
            matrix[b, s] = hypergeometric(left[s], rest, todo, rng)
            todo -= int(matrix[b, s])
        left = [a - int(m) for a, m in zip(left, matrix[b])]
    return matrix


def exact_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle(df: DataFrame, *, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows and columns with ``shard`` and a gapless ``slot``; shard sizes differ by one at most."""
    spark = df.sparkSession
    rows = materialize(df.select(
        F.struct(*named(df, *df.columns)).alias("row"), F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("block"),
    ), "numbered")
    counts = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}  # one number per input partition
    blocks = sorted(counts)
    total = sum(counts.values())
    matrix = communication_matrix([counts[b] for b in blocks], exact_sizes(total, shards), np.random.default_rng(seed))
    bounds = spark.createDataFrame([(b, m) for b, m in zip(blocks, np.cumsum(matrix, axis=1).tolist())], "block int, bounds array<long>")

    def draw(k: int):
        return F.xxhash64(F.lit(seed), F.lit(k), F.col("rid"))

    local = Window.partitionBy("block").orderBy(draw(0), "rid")
    buckets = max(1, -(-total // (shards * bucket_rows)))
    sent = rows.withColumn("place", F.row_number().over(local)).join(bounds, "block").select(
        "row", "rid", F.size(F.filter("bounds", lambda b: b < F.col("place"))).alias("shard"), F.pmod(draw(1), F.lit(buckets)).cast("int").alias("bucket"),
    )
    sent = materialize(sent, "sent")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sent.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    again = Window.partitionBy("shard", "bucket").orderBy(draw(2), "rid")
    out = sent.withColumn("at", F.row_number().over(again)).join(sizes, ["shard", "bucket"])
    shard, slot = free(df.columns, "shard", "slot")
    return unpacked(out, F.col("shard").alias(shard), (F.col("before") + F.col("at") - 1).cast("long").alias(slot))


def write(shuffled: DataFrame, path: str, *, shard: str = "shard", slot: str = "slot", file_rows: int = BUCKET_ROWS) -> None:
    """One folder per shard; each file holds a run of consecutive slots in order."""
    run = F.floor(F.col(slot) / file_rows)
    shuffled.withColumn("__run", run).repartition(shard, "__run").sortWithinPartitions(shard, slot).drop("__run").write.partitionBy(shard).parquet(path)


def digest(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    body = F.coalesce(named(docs, text)[0].cast("string"), F.lit(""))
    narrow = docs.select(
        named(docs, doc_id)[0].alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"),
    )
    out = shuffle(narrow, **options)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
