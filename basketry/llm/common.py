"""What the corpus operators share: words as bytes, word fingerprints, and passing whole rows through Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketry.session import ship

# Upper- to lower-case for A-Z alone; other letters keep their case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Bytes of text that numpy works on at once inside a task.
SLICE_BYTES = 4 << 20

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def named(df: DataFrame, *columns: str) -> list:
    """Columns by exact name, dots and spaces included."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def with_text(df: DataFrame, text: str = "text", keep: Iterable[str] | None = None, **extra) -> DataFrame:
    """``row`` (the columns to carry, as one struct, so that no name can clash) and ``text`` as a string."""
    keep = df.columns if keep is None else list(keep)
    return df.select(
        F.struct(*named(df, *keep)).alias("row"), named(df, text)[0].cast("string").alias("text"),
        *[c.alias(name) for name, c in extra.items()],
    )


def unpacked(df: DataFrame, *more) -> DataFrame:
    """The carried columns again, then ``more``."""
    return df.select("row.*", *more)


def carried(df: DataFrame, columns: Iterable[str], more: str) -> StructType:
    """Schema of an Arrow step that passes ``columns`` of ``df`` on and adds those of ``more``."""
    return StructType([df.schema[c] for c in columns] + StructType.fromDDL(more).fields)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``size`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(lengths) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as long as the longest text so far."""

    def __init__(self, which: int):
        self.base, self.up, self.down = _BASES[which], np.empty(0, np.uint64), np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n2 = max(n, 2 * len(self.up), 4096)
            self.up = np.multiply.accumulate(np.full(n2, self.base, np.uint64))
            self.down = np.multiply.accumulate(np.full(n2, pow(self.base, -1, 1 << 64), np.uint64))
        return self.up, self.down


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[0]))


def word_hashes(text: bytes | None, powers: Powers) -> np.ndarray:
    """64-bit hashes of the words between white space (space and 0x09 to 0x0D), in order, as ``bytes.split`` finds them."""
    if not text:
        return np.empty(0, np.uint64)
    b = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = powers.get(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * up[: len(b)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def window_hashes(hashes: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """One 64-bit hash per window of ``size`` words: a polynomial in the words' hashes, from prefix sums."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers.get(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[:n])


def lists(values: np.ndarray, lengths, kind: pa.DataType) -> pa.ListArray:
    """A list column from all values in row order and each row's length."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def free(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for new columns: as wanted, with underscores after them where the input already has such a column."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def file_bytes(spark, path: str, most: int = 64 << 20) -> bytes:
    """A small file (a vocabulary) by any path that Spark reads; its size is checked before it is fetched."""
    found = spark.read.format("binaryFile").load(path).select("length", "content")
    if (n := found.agg(F.sum("length")).first()[0]) is None or n > most:
        raise ValueError(f"{path}: a vocabulary of {most} bytes at most is expected, not {n}")
    return bytes(found.first()["content"])
