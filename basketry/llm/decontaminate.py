"""Benchmark decontamination with suffix arrays of the training text.

Every slice of the documents is a shard. Its suffix array is sorted by prefix doubling, and every suffix of every
benchmark item is binary-searched in it. Only runs of benchmark words that are long enough to hold a window enter the
array; no match can lie elsewhere. A document is wholly inside one shard, so nothing is shuffled.

Defined results: a null or empty text has no words and is clean; a null or empty item matches nothing; rows with the
same item id are one item; an item without id marks words but is not listed; without items every document is clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import arrow_map, carried, named, slices, texts, unpacked, with_text

WINDOW = 10
# Benchmark text handed to the tasks at once. A larger benchmark is searched in several passes.
BLOCK_BYTES = 8 << 20

# Words are runs of 0-9, a-z (after lower-casing A-Z) and anything outside ASCII.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

FOUND = "n_words long, hits array<struct<start:int,end:int>>, items array<string>, unnamed boolean"


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes, sorted by their first ``depth`` tokens at least."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    order = np.argsort(rank, kind="stable")
    while width < depth and n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank[order] = np.concatenate([[1], 1 + np.cumsum(ranked[1:] != ranked[:-1])])
        width *= 2
        if rank[order[-1]] == n:
            break
    return order


class Items:
    """All suffixes of a block of benchmark items, ready to be searched in any shard."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        tokens: list[int] = []
        starts: list[int] = []
        sizes: list[int] = []
        ends: list[int] = []
        owners: list[int] = []
        self.ids: list[str | None] = []
        for item, text in rows:
            words = item_words(text.encode() if text else None)
            if not words:
                continue
            base, size = len(tokens), min(window, len(words))
            tokens += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            tokens.append(0)
            for i in range(len(words) - size + 1):
                starts.append(base + i)
                sizes.append(size)
                ends.append(base + len(words))
                owners.append(len(self.ids))
            self.ids.append(item)
        self.tokens = np.array(tokens + [0], np.int64)
        self.starts, self.sizes, self.ends = (np.array(x, np.int64) for x in (starts, sizes, ends))
        self.owners = np.array(owners, np.int64)
        self.shortest = int(self.sizes.min()) if sizes else 0
        self.longest = int((self.ends - self.starts).max()) if sizes else 0

    def runs(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the runs that can hold a window (0 between runs), with the document and word each stands for."""
        get = self.vocabulary.get
        n = sum(map(len, documents)) + len(documents)
        flat = np.fromiter(chain.from_iterable(chain(map(get, words, repeat(0)), (0,)) for words in documents), np.int64, n)
        lengths = np.array([len(w) + 1 for w in documents], np.int64)
        doc = np.repeat(np.arange(len(documents)), lengths)
        word = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        known = flat > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        wide = last - first >= max(1, self.shortest)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, first[wide], 1)
        np.add.at(cover, np.minimum(last[wide] + 1, n), -1)  # the break after a run stays, as its separator
        keep = np.cumsum(cover[:-1]) > 0
        return np.where(known, flat, 0)[keep], doc[keep], word[keep]

    def compare(self, text: np.ndarray, at: np.ndarray, which: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the common prefix (at most ``depth``) and the sign of text against item after it."""
        common, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.flatnonzero(depth > 0)
        n, start = len(text), self.starts[which]
        while len(live):
            p = at[live] + common[live]
            a = np.where(p < n, text[np.minimum(p, n - 1)], 0)
            b = self.tokens[start[live] + common[live]]
            same = (a == b) & (a > 0)
            sign[live[~same]] = np.sign(a - b)[~same]
            live = live[same]
            common[live] += 1
            live = live[common[live] < depth[live]]
        return common, sign

    def bound(self, text: np.ndarray, order: np.ndarray, depth: np.ndarray, after: bool) -> np.ndarray:
        """First rank whose suffix, cut at ``depth``, is not below (``after``: is above) the item's; all searched at once."""
        which = np.arange(len(self.starts))
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(order), np.int64)
        live = which[lo < hi]
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            _, sign = self.compare(text, order[mid], live, depth[live])
            below = (sign <= 0) if after else (sign < 0)
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
            live = live[lo[live] < hi[live]]
        return lo

    def longest_in(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every item suffix: length of its longest match in the shard, and where it starts."""
        which, depth = np.arange(len(self.starts)), self.ends - self.starts
        best, where = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        if not len(order):
            return best, where
        lo = self.bound(text, order, depth, after=False)
        for rank in (np.clip(lo - 1, 0, len(order) - 1), np.clip(lo, 0, len(order) - 1)):
            common, _ = self.compare(text, order[rank], which, depth)
            better = common > best
            best[better], where[better] = common[better], order[rank][better]
        return best, where

    def occurrences(self, text: np.ndarray, order: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item suffix, position) of every place where a whole window of an item stands."""
        full = np.flatnonzero(best >= self.sizes)
        if not len(full):
            return full, full
        depth = np.where(best >= self.sizes, self.sizes, 0)
        lo = self.bound(text, order, depth, after=False)[full]
        hi = self.bound(text, order, depth, after=True)[full]
        counts = hi - lo
        offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(full, counts), order[np.repeat(lo, counts) + offsets]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    rows, size = [], 0
    # One block at a time passes the driver.
    chosen = benchmark.select(named(benchmark, item_id)[0].cast("string").alias("i"), named(benchmark, text)[0].cast("string").alias("t"))
    for r in chosen.distinct().orderBy("i", "t").toLocalIterator():
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
        rows.append((r.i, r.t))
        size += len(r.t or "")
    if rows:
        yield rows


def _search(items: Items, batch: pa.RecordBatch) -> pa.RecordBatch:
    documents = [item_words(t) for t in texts(batch)]
    n = len(documents)
    text, doc, word = items.runs(documents)
    order = suffix_array(text, items.longest)
    best, _ = items.longest_in(text, order)
    which, at = items.occurrences(text, order, best)
    hits: list[list[dict]] = [[] for _ in range(n)]
    found: list[set] = [set() for _ in range(n)]
    if len(at):
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + items.sizes[which], -1)
        inside = np.cumsum(cover) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside[:-1], [False]]).astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2]):
            hits[doc[a]].append({"start": int(word[a]), "end": int(word[b - 1]) + 1})
        for d, o in np.unique(np.stack([doc[at], items.owners[which]]), axis=1).T:
            found[d].add(items.ids[o])
    if "hits" in batch.schema.names:  # an earlier block's findings join in
        earlier = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), batch.column("unnamed").to_pylist())
        for d, (spans, names, unnamed) in enumerate(earlier):
            hits[d] = merged(hits[d] + spans)
            found[d] |= {*names, *([None] if unnamed else [])}
    return pa.RecordBatch.from_arrays([
        batch.column("row"), batch.column("text"), pa.array([len(w) for w in documents], pa.int64()),
        pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        pa.array([sorted(x for x in f if x is not None) for f in found], pa.list_(pa.string())),
        pa.array([None in f for f in found], pa.bool_()),
    ], names=["row", "text", "n_words", "hits", "items", "unnamed"])


def merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def scan(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``row`` (carried columns), ``n_words``, ``hits`` (word spans inside benchmark windows) and ``items`` of every document."""
    out = with_text(docs, text, keep)
    schema = carried(out, ["row", "text"], FOUND)
    for rows in _blocks(benchmark, item_id, item_text, block_bytes) if len(benchmark.take(1)) else [[]]:
        shared = docs.sparkSession.sparkContext.broadcast((rows, window))

        def search(batches, shared=shared):
            items = Items(*shared.value)
            for batch in slices(batches):
                yield _search(items, batch)

        out = arrow_map(out, search, schema)
    return out.drop("text")


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim match of every item that has a full window in the documents: item_id, n_words, item_start, doc_id, doc_start."""
    source = with_text(docs, text, [doc_id])
    plain = source.select(F.col("row").getField(doc_id).alias("doc_id"))
    schema = carried(plain, ["doc_id"], "doc_start int, item_id string, n_words int, item_start int")
    parts = []
    for rows in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast((rows, window))

        def search(batches, shared=shared):
            items = Items(*shared.value)
            for batch in slices(batches):
                body, doc, word = items.runs([item_words(t) for t in texts(batch)])
                order = suffix_array(body, items.longest)
                best, at = items.longest_in(body, order)
                hit = np.flatnonzero(best >= items.sizes) if len(best) else np.empty(0, np.int64)
                base = np.array([0, *(np.flatnonzero(items.tokens[:-1] == 0) + 1)])
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").field(0).take(pa.array(doc[at[hit]], pa.int64())), pa.array(word[at[hit]], pa.int32()),
                    pa.array([items.ids[o] for o in items.owners[hit]], pa.string()), pa.array(best[hit], pa.int32()),
                    pa.array(items.starts[hit] - base[items.owners[hit]], pa.int32()),
                ], names=["doc_id", "doc_start", "item_id", "n_words", "item_start"])

        parts.append(arrow_map(source, search, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    best = F.max_by(F.struct("n_words", "item_start", "doc_id", "doc_start"), F.struct("n_words", -F.col("item_start"), "doc_id", -F.col("doc_start")))
    return out.groupBy("item_id").agg(best.alias("m")).select("item_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    return unpacked(scan(docs, benchmark, **options).filter(F.size("hits") == 0))


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: words, words hit, number and digest of the items found, verdict."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["end"] - h["start"])
    return unpacked(
        scan(docs, benchmark, keep=["doc_id"], **options), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
