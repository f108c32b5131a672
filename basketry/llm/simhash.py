"""SimHash near copies, linked by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits have a fingerprint in the middle: within one bit of either when they
differ in up to two bits, and within one bit of one and two bits of the other when they differ in three. So every
fingerprint stands at all variants within one bit, and those with an odd number of ones also at variants two bits away;
of three differing bits two lie in the same half, so both flips may be taken from one half.

Variants are dealt by the half that the flips leave alone. Each fingerprint travels to its own half and to that half's
one-bit variants (66 rows); the ball inside the other half is unfolded where the row arrives. All that meet at a variant
are linked to the least fingerprint within one bit of it, so a group of n close fingerprints makes links in proportion
to n, not to its pairs. Equal fingerprints are one row throughout.

Defined results: a null or empty text has fingerprint zero and is linked like any other; equal ids are separate rows
with one component; ids that are null do not become a component's id unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import LOWER, arrow_map, carried, named, slices, texts, unpacked, with_text
from basketry.llm.components import components
from basketry.session import materialize

SHINGLE = 3
SEED = 42
RADIUS = 3
# Shingles whose bits are counted at once, rows and variants that a task unfolds at once.
BITS_AT_ONCE = 1 << 16
ROWS_AT_ONCE = 1 << 17
VARIANTS_AT_ONCE = 1 << 22

_ONE = np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def fingerprint(text: bytes | None) -> int:
    """64 bits; a bit is one if it is set in over half the hashes of the text's three-word shingles."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    body = b" ".join(words)
    size = min(SHINGLE, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - size + 1].tolist()
    stops = ends[size - 1:].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(starts), BITS_AT_ONCE):
        hashes = b"".join([digest(body[a:b], SEED) for a, b in zip(starts[i:i + BITS_AT_ONCE], stops[i:i + BITS_AT_ONCE])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, **extra) -> DataFrame:
    """``row`` (the carried columns), ``fp`` as a long, and any ``extra`` columns."""
    source = with_text(docs, text, keep, **extra)
    passed = ["row", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = pa.array([fingerprint(t) for t in texts(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([*map(batch.column, passed), fps], names=[*passed, "fp"])

    return arrow_map(source, run, carried(source, passed, "fp long"))


def _dealt(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint at both halves, and at the 32 one-bit variants of each half. Bit 32 of a key names the half."""
    def half(side):
        value = F.shiftrightunsigned("fp", 32) if side == 0 else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(32)])
        return F.transform(flips, lambda m: value.bitwiseXOR(m).bitwiseOR(F.lit(side << 32)))

    return fps.select("fp", F.explode(F.concat(half(0), half(1))).alias("key"))


_FLIPS = np.array([0, *(1 << b for b in range(32))], np.uint64)
_PAIRS = np.array([(1 << a) | (1 << b) for a in range(32) for b in range(a)], np.uint64)


def _variants(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(variant, fingerprint, within one bit) of all rows of whole keys."""
    side, half = key >> _32, key & _LOW
    high = fp >> _32
    own = np.where(side == 0, high, fp & _LOW) == half
    moved = np.where(side == 0, (half << _32) | (fp & _LOW), (high << _32) | half)
    shift = np.where(side == 0, np.uint64(0), _32)
    odd = own & (np.bitwise_count(fp) % 2 == 1)
    near = fp[own, None] ^ (_FLIPS[None, :] << shift[own, None])
    far = fp[odd, None] ^ (_PAIRS[None, :] << shift[odd, None])
    variant = np.concatenate([moved[~own], near.ravel(), far.ravel()])
    source = np.concatenate([fp[~own], np.repeat(fp[own], 33), np.repeat(fp[odd], len(_PAIRS))])
    return variant, source, np.arange(len(variant)) < len(variant) - far.size


def _stars(variant: np.ndarray, fp: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of all that meet at a variant to the least close one there; each link verified, once."""
    order = np.argsort(variant, kind="stable")
    variant, fp, close = variant[order], fp[order], close[order]
    first = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
    sizes = np.diff(np.append(first, len(variant)))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    some = np.logical_or.reduceat(close, first) & (sizes > 1)
    least = np.minimum.reduceat(np.where(close, fp, none), first)
    live = np.repeat(some, sizes)
    a, b = np.repeat(least, sizes)[live], fp[live]
    good = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    pairs = np.unique(np.stack([a[good], b[good]]), axis=1)
    return pairs[0], pairs[1]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) in place of the links: as many rows as nodes, whatever the links."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = index[: len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    expected = 33 * len(fp) + len(_PAIRS) * int((np.where(key >> _32 == 0, fp >> _32, fp & _LOW) == key & _LOW).sum())
    found: list[tuple[np.ndarray, np.ndarray]] = []
    passes = max(1, -(-expected // VARIANTS_AT_ONCE))
    parts = np.array_split(np.arange(len(fp)), passes)
    for turn in range(passes):  # a crowded half is unfolded in turns, each keeping the variants of one remainder
        if passes == 1:
            variant, source, close = _variants(key, fp)
        else:
            chosen = []
            for part in parts:
                v, s, c = _variants(key[part], fp[part])
                mine = (v ^ (v >> _32)) % np.uint64(passes) == turn
                chosen.append((v[mine], s[mine], c[mine]))
            variant, source, close = (np.concatenate(x) for x in zip(*chosen))
        if len(variant):
            found.append(_stars(variant, source, close))
    if not found:
        return fp[:0], fp[:0]
    return _forest(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole keys are unfolded together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out(key, fp):
        a, b = _links(key, fp)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    for batch in batches:
        key, fp = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("key", "fp"))
        held.append((key, fp))
        size += len(key)
        if size >= ROWS_AT_ONCE and len(key):
            key, fp = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))
            held, size = [(key[cut:], fp[cut:])], len(key) - cut
            if cut:
                yield out(key[:cut], fp[:cut])
    if size:
        yield out(*(np.concatenate(x) for x in zip(*held)))


def links(fps: DataFrame) -> DataFrame:
    """(u, v): enough links between distinct values of ``fp`` to connect all that differ in at most three bits."""
    dealt = _dealt(fps.select("fp").distinct()).repartition("key").sortWithinPartitions("key")
    return arrow_map(dealt, _meet, "u long, v long")


def classes(marked: DataFrame) -> DataFrame:
    """``fp`` and ``root`` for every fingerprint in ``marked``."""
    roots = components(links(marked))
    return marked.select("fp").distinct().join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
    )


def digest(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest id reachable) of every document."""
    marked = materialize(
        unpacked(fingerprints(docs, text=text, keep=[doc_id]), "fp").select(named(docs, doc_id)[0].alias("doc_id"), "fp"), "fingerprints",
    )
    rooted = classes(marked).join(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp")
    rooted = materialize(rooted, "classes")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one of smallest id (of equal ids, the least text hash); repeated rows become one."""
    body, name = named(docs, text)[0].cast("string"), named(docs, doc_id)[0]
    marked = materialize(
        fingerprints(docs, text=text, keep=[doc_id], th=F.xxhash64(body)).select(F.col("row").getField(doc_id).alias("id"), "th", "fp"), "fingerprints",
    )
    rooted = classes(marked).join(
        marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("first")), "fp",
    )
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.th")
    rows = docs.select(name.alias("id"), F.xxhash64(body).alias("th"), F.struct(*named(docs, *docs.columns)).alias("row"))
    single = rows.groupBy("id", "th").agg(F.first("row").alias("row"))
    on = single["id"].eqNullSafe(kept["id"]) & (single["th"] == kept["th"])
    return unpacked(single.join(kept, on, "left_semi"))
