"""Vector code compression: each quarter of a vector becomes the number of its nearest codebook entry.

Components become integers, so all distances, sums and codes are exact and do not depend on the order of tasks. The parts
are sorted along a Hilbert curve (one curve for each part position) and written as flat blocks of up to BLOCK parts with
the least and greatest value of every component and the sums. In each round the distances between a block's box and the
entries leave a shortlist: an entry stays only if it can be as near to some point of the box as the entry whose farthest
point is nearest. A block with one entry left is assigned whole, by its sums; the others by exact distances to the entries
of their shortlist. A round sends back one number per entry and component and task; the vectors are never moved again.

Broadcast and collected are codebooks alone: ENTRIES times the width of a vector. The order on the curve only decides how
short the lists are, never a result; its grid is the range of the first entries. Equal vectors are told apart by a running
number where they are dealt to tasks, so a crowd of copies spreads over many.

Defined results: vectors that are null, empty or hold a null or non-finite component are dropped; ids and labels may be null
or repeat, and every row keeps its own code; entries start from the rows of least id (null last), then of least vector; a
table of fewer rows has fewer entries; an empty one gives no row. All vectors need one length that PARTS divides, and
components whose exact distances fit 64 bits; others raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import arrow_map, carried, free, lists, named, unpacked
from basketry.session import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 256
BOXES_AT_ONCE = 128

_INTS = pa.int64()


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (coordinates of ``bits`` bits) along the Hilbert curve; Skilling's transform, 2004."""
    x = points.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        rest = (1 << bit) - 1
        for axis in x:
            on = (axis >> bit & 1).astype(bool)
            swapped = np.where(on, 0, (x[0] ^ axis) & rest)
            x[0] ^= np.where(on, rest, swapped)
            axis ^= swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | axis >> bit & 1
    return place


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose rows all have ``width`` entries."""
    if len(column) and not np.all(np.diff(column.offsets.to_numpy()) == width):
        raise ValueError(f"vectors of {width} components are expected throughout")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); an error where exact distances would leave 64 bits."""
    scaled = np.floor(vectors * scale)
    if scaled.size and 4 * vectors.shape[1] * float(np.abs(scaled).max()) ** 2 >= 2.0**62:
        raise ValueError("components are too large for exact distances")
    return scaled.astype(np.int64)


def _exact(*arrays: np.ndarray):
    """A type in which sums of products of these arrays are exact: float64 (fast products) or int64."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return np.float64 if 4 * arrays[0].shape[-1] * most * most < 1 << 53 else np.int64


def keep_valid(vectors: DataFrame, vector: str, keep: list[str], key: str) -> DataFrame:
    """(uid, row, key, e): the rows with a usable vector, numbered, in a written table."""
    e = named(vectors, vector)[0].cast("array<double>")
    usable = F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.struct(*named(vectors, *keep)).alias("row"), named(vectors, key)[0].alias("key"), e.alias("e"))
    return materialize(rows.filter((F.size("e") > 0) & usable).select(F.monotonically_increasing_id().alias("uid"), "row", "key", "e"), "vectors")


def blocks(kept: DataFrame, seeds: np.ndarray, *, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(part, uids, values, low, high, sums): flat blocks of parts near each other, in a written table.

    ``seeds``: the first entries, parts x entries x width of a part.
    """
    parts, _, width = seeds.shape
    axes = min(width, 62)
    bits = 62 // axes
    low = seeds.min(axis=1)[:, :axes]
    span = np.maximum(seeds.max(axis=1)[:, :axes] - low, 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = integers(_matrix(batch.column("e"), parts * width), scale).reshape(-1, parts, width)
            cells = np.clip((own[:, :, :axes] - low) * (1 << bits) // span, 0, (1 << bits) - 1)
            for p in range(parts):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own), p, np.int32)), pa.array(hilbert(cells[:, p], bits)), batch.column("uid"),
                    lists(own[:, p].ravel(), np.full(len(own), width), _INTS),
                ], names=["part", "place", "uid", "x"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, x = batch.column("part").to_numpy(), _matrix(batch.column("x"), width)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            starts = np.concatenate([np.arange(a, b, block) for a, b in zip(edges, edges[1:])]).astype(np.int64) if len(part) else np.empty(0, np.int64)
            if not len(starts):
                continue
            sizes = np.diff(np.append(starts, len(part)))
            wide = np.full(len(starts), width)
            yield pa.RecordBatch.from_arrays([
                pa.array(part[starts]), lists(batch.column("uid").to_numpy(), sizes, _INTS), lists(x.ravel(), sizes * width, _INTS),
                *[lists(f.reduceat(x, starts, axis=0).ravel(), wide, _INTS) for f in (np.minimum, np.maximum, np.add)],
            ], names=["part", "uids", "x", "low", "high", "sums"])

    placed = arrow_map(kept.select("uid", "e"), place, "part int, place long, uid long, x array<long>")
    near = placed.repartitionByRange("part", "place", "uid").sortWithinPartitions("part", "place", "uid")
    return materialize(arrow_map(near, cut, "part int, uids array<long>, x array<long>, low array<long>, high array<long>, sums array<long>"), "blocks")


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Whether each entry can be nearest to some point of each box (boxes x entries). Ties stay."""
    kind = _exact(low, high, entries)
    low, high, entries = low.astype(kind)[:, None], high.astype(kind)[:, None], entries.astype(kind)
    gap = np.maximum(np.maximum(low - entries, entries - high), 0)
    reach = np.maximum(np.abs(entries - low), np.abs(high - entries))
    least, most = np.einsum("bkw,bkw->bk", gap, gap), np.einsum("bkw,bkw->bk", reach, reach)
    return least <= most.min(axis=1, keepdims=True)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number in ``entries`` (the first of equals) and squared distance of each part."""
    kind = _exact(x, entries)
    a, c = x.astype(kind), entries.astype(kind)
    off = (c * c).sum(axis=1) - 2 * (a @ c.T)
    best = off.argmin(axis=1)
    return best, (off[np.arange(len(x)), best] + (a * a).sum(axis=1)).astype(np.int64)


def _listed(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray):
    """Per block: the batch, the block's number in it, its part position and its shortlist."""
    width = codebooks.shape[2]
    for whole in batches:
        for at in range(0, whole.num_rows, BOXES_AT_ONCE):
            batch = whole.slice(at, BOXES_AT_ONCE)
            part = batch.column("part").to_numpy()
            low, high, sums = (_matrix(batch.column(c), width) for c in ("low", "high", "sums"))
            near = np.zeros((len(part), codebooks.shape[1]), bool)
            for p in np.unique(part):
                near[part == p] = shortlists(low[part == p], high[part == p], codebooks[p])
            ids, flat = batch.column("uids"), batch.column("x")
            cuts = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            uids, x = ids.flatten().to_numpy(), flat.flatten().to_numpy().reshape(-1, width)
            for i, p in enumerate(part):
                yield p, np.flatnonzero(near[i]), sums[i], uids[cuts[i]:cuts[i + 1]], x[cuts[i]:cuts[i + 1]]


def improved(found: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floored mean of the parts nearest to it; unused ones stay."""
    parts, entries, width = codebooks.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)  # the last place counts
        for p, near, total, uids, x in _listed(batches, codebooks):
            if len(near) == 1:
                sums[p, near[0], :width] += total
                sums[p, near[0], width] += len(uids)
                continue
            best, _ = nearest(x, codebooks[p][near])
            order = np.argsort(best, kind="stable")
            used, starts = np.unique(best[order], return_index=True)
            sums[p, near[used], :width] += np.add.reduceat(x[order], starts, axis=0)
            sums[p, near[used], width] += np.diff(np.append(starts, len(best)))
        filled = np.repeat(sums[:, :, width] > 0, width + 1).reshape(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(filled)), pa.array(sums[filled])], names=["cell", "value"])

    total = arrow_map(found.select("part", "uids", "x", "low", "high", "sums"), add, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value"))
    cells = np.array(total.collect(), np.int64).reshape(-1, 2)  # at most one for each number of the codebooks and each count
    sums = np.zeros((parts, entries, width + 1), np.int64)
    sums.ravel()[cells[:, 0]] = cells[:, 1]
    count = sums[:, :, width:]
    return np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), codebooks)


def assigned(found: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(uid, part, entry, distance) of every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, near, _, uids, x in _listed(batches, codebooks):
            best, distance = nearest(x, codebooks[p][near])
            yield pa.RecordBatch.from_arrays([
                pa.array(uids), pa.array(np.full(len(x), p, np.int32)), pa.array(near[best].astype(np.int32)), pa.array(distance),
            ], names=["uid", "part", "entry", "distance"])

    return arrow_map(found, run, "uid long, part int, entry int, distance long")


def train(kept: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[np.ndarray, DataFrame | None]:
    """Codebooks (parts x entries x width) and the blocks they were made from (None without rows)."""
    first = [r.e for r in kept.orderBy(F.asc_nulls_last("key"), "e").select("e").limit(entries).collect()]
    if not first:
        return np.zeros((parts, 0, 0), np.int64), None
    if len({len(e) for e in first}) > 1 or len(first[0]) % parts:
        raise ValueError(f"vectors of one length, a multiple of {parts}, are expected")
    codebooks = integers(np.array(first), scale).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    found = blocks(kept, codebooks, scale=scale, block=block)
    for _ in range(rounds):
        before, codebooks = codebooks, improved(found, codebooks)
        if np.array_equal(before, codebooks):
            break  # later rounds would change nothing
    return codebooks, found


def encode(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", keep: list[str] | None = None, **options) -> tuple[DataFrame, np.ndarray]:
    """``row`` (carried columns), ``code`` (two hexadecimal digits a part) and ``error``; and the codebooks."""
    kept = keep_valid(vectors, vector, vectors.columns if keep is None else keep, key)
    codebooks, found = train(kept, **options)
    if found is None:
        return kept.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), codebooks
    numbers = [F.max(F.when(F.col("part") == p, F.col("entry"))) for p in range(len(codebooks))]
    digits = F.concat(*[F.lpad(F.lower(F.hex(n)), 2, "0") for n in numbers])
    codes = assigned(found, codebooks).groupBy("uid").agg(digits.alias("code"), F.sum("distance").alias("error"))
    return kept.select("uid", "row").join(codes, "uid").select("row", "code", "error"), codebooks


def with_codes(vectors: DataFrame, **options) -> tuple[DataFrame, np.ndarray]:
    """The usable rows with ``code`` and ``error`` (a taken name gets an underscore), and the codebooks."""
    coded, codebooks = encode(vectors, **options)
    return unpacked(coded, *[F.col(a).alias(b) for a, b in zip(("code", "error"), free(vectors.columns, "code", "error"))]), codebooks


def decoded(codes: DataFrame, codebooks: np.ndarray, *, code: str = "code", scale: int = SCALE) -> DataFrame:
    """``row`` and ``vector``: the entries that each code names, put together."""
    source = codes.select(F.struct(*named(codes, *codes.columns)).alias("row"), named(codes, code)[0].alias("code"))
    values = codebooks / scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(-1, len(values))
            flat = np.concatenate([values[p][numbers[:, p]] for p in range(len(values))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), lists(flat.ravel(), np.full(len(flat), flat.shape[1]), pa.float64())], names=["row", "vector"])

    return arrow_map(source, run, carried(source, ["row"], "vector array<double>"))


def spelled(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def digest(vectors: DataFrame, *, vec_id: str = "vec_id", label: str = "label", **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row."""
    coded, codebooks = encode(vectors, key=vec_id, keep=[vec_id, label], **options)
    coded = materialize(coded.select(F.col("row")[vec_id].alias("vec_id"), F.col("row")[label].alias("label"), "code", "error"), "codes")
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("vec_id").alias(vec_id), "code", "error", "label_error", F.lit(spelled(codebooks)).alias("codebooks_sha256"))
