"""Removal of repeated passages with suffix automata.

Every stretch of ``window`` words that also starts earlier (smaller id, or same document and earlier place) is removed.
Broadcasting an automaton of every reference shard to every document would read the corpus once per shard, so here the
shards are cut from the documents themselves and what their automata leave over meets by exchange:

1. Later copies of a whole text are found by digest, one row each, and take no further part.
2. Each window elects the least of its word ``gram``s. Equal windows elect the same, so only windows whose elected gram
   occurs at least twice can repeat; the others are set aside on narrow rows before any text moves.
3. The stretches left over form bounded shards. A suffix automaton of each shard takes them in order, and the matching
   statistic of every word (the longest stretch ending there that the shard has seen earlier) settles all repeats within
   the shard. A window new to its shard is passed on as a 128-bit hash with its place.
4. The least place of every window over all shards is a pre-aggregated minimum; a window set aside nowhere and first
   nowhere is removed, and overlapping ones form maximal spans.

Defined results: a null text, or one with fewer words than ``window``, loses nothing; null ids come before all others and
rows with equal ids are in a fixed but unspecified order, so of repeated rows exactly one keeps a passage; a later copy
of a whole text loses all of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Powers, arrow_map, carried, lists, named, slices, texts, window_hashes, with_text, word_hashes
from basketry.session import materialize

WINDOW = 20
GRAM = 8
# Words whose automaton one task holds at a time (about 0.7 kB each). A longer document is a shard of its own.
SHARD_WORDS = 1 << 16

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """Online suffix automaton of a sequence of symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, symbol) -> int:
        """Append a symbol; the length of the longest suffix that also ended somewhere before."""
        nexts, link, length = self.next, self.link, self.length
        new, p = len(length), self.last
        length.append(length[p] + 1)
        nexts.append({})
        link.append(0)
        while p >= 0 and symbol not in nexts[p]:
            nexts[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][symbol]
            if length[q] != length[p] + 1:
                clone = len(length)
                length.append(length[p] + 1)
                nexts.append(nexts[q].copy())
                link.append(link[q])
                link[q] = clone
                while p >= 0 and nexts[p].get(symbol) == q:
                    nexts[p][symbol] = clone
                    p = link[p]
                q = clone
            link[new] = q
        self.last = new
        return length[link[new]]


def elected(hashes: np.ndarray, window: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash, first window) of each gram that some window elects: the least hash in it, the leftmost if equal."""
    grams = window_hashes(hashes, gram, powers)
    width = window - gram + 1
    if len(grams) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place = sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[first]], first


def _census(docs: DataFrame, doc_id: str, text: str, window: int, gram: int) -> DataFrame:
    """One narrow row per document: uid, id, th (hash of the text), n_words, sha of its words, elected grams and their first windows."""
    body = named(docs, text)[0].cast("string")
    source = with_text(docs.select(named(docs, doc_id)[0].alias("id"), body.alias("text")), keep=["id"], uid=F.monotonically_increasing_id(), th=F.xxhash64("text"))
    source = source.select("row.id", "uid", "th", "text")
    gram = min(gram, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, powers = Powers(1), Powers(0)
        for batch in slices(batches):
            n_words, sha, grams, firsts = [], [], [], []
            for t in texts(batch):
                words = t.split() if t else []
                n_words.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                g, f = elected(word_hashes(t, spelling), window, gram, powers)
                grams.append(g)
                firsts.append(f)
            sizes = [len(g) for g in grams]
            yield pa.RecordBatch.from_arrays([
                *map(batch.column, ("id", "uid", "th")), pa.array(n_words, pa.int64()), pa.array(sha),
                lists(np.concatenate(grams).view(np.int64) if grams else [], sizes, pa.int64()),
                lists(np.concatenate(firsts).astype(np.int32) if firsts else [], sizes, pa.int32()),
            ], names=["id", "uid", "th", "n_words", "sha", "grams", "firsts"])

    return arrow_map(source, run, carried(source, ["id", "uid", "th"], "n_words long, sha string, grams array<long>, firsts array<int>"))


def _open_windows(census: DataFrame, window: int) -> DataFrame:
    """(uid, id, th, ranges) of the first copies that have windows whose gram occurs twice; ranges are [lo, hi] of window starts."""
    spread = census.select("uid", F.posexplode("grams").alias("k", "gram"))
    # Written, so that the join below reads two plain exchanges and Spark can split a gram that very many texts share.
    repeated = materialize(spread.groupBy("gram").count().filter("count > 1").select("gram"), "repeated")
    chosen = spread.join(repeated, "gram").groupBy("uid").agg(F.collect_list("k").alias("ks"))
    after = lambda k: F.when(k + 1 < F.size("firsts"), F.get("firsts", k + 1)).otherwise(F.col("n_words") - window + 1)
    ranges = F.transform(F.array_sort("ks"), lambda k: F.struct(F.get("firsts", k).alias("lo"), (after(k) - 1).cast("int").alias("hi")))
    return census.join(chosen, "uid").select("uid", "id", "th", ranges.alias("ranges"))


def _rows_with(docs: DataFrame, doc_id: str, text: str, what: DataFrame) -> DataFrame:
    """``what`` with the text of its documents, found by id and text hash."""
    body = named(docs, text)[0].cast("string")
    bodies = docs.select(named(docs, doc_id)[0].alias("id_"), F.xxhash64(body).alias("th_"), body.alias("text"))
    return what.join(bodies, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_"))).drop("id_", "th_")


def _new_windows(rows: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(k1, k2, id, uid, start) of the open windows that are new to their shard."""

    def stretches(ranges: list[dict]) -> list[tuple[int, int]]:
        """Word ranges covered by the open windows, joined where they touch."""
        out: list[tuple[int, int]] = []
        for r in ranges:
            if out and r["lo"] <= out[-1][1]:
                out[-1] = (out[-1][0], r["hi"] + window)
            else:
                out.append((r["lo"], r["hi"] + window))
        return out

    def shard(held: list, powers) -> dict[str, list]:
        automaton, breaks = SuffixAutomaton(), 0
        found: dict[str, list] = {"k1": [], "k2": [], "id": [], "uid": [], "start": []}
        held.sort(key=lambda d: (d[0] is not None, d[0], d[1]))
        for doc, uid, ranges, hashes in held:
            open_ = np.zeros(len(hashes) + 1, np.int64)
            for r in ranges:
                open_[r["lo"]] += 1
                open_[r["hi"] + 1] -= 1
            open_ = np.cumsum(open_[:-1]) > 0
            for lo, hi in stretches(ranges):
                part = hashes[lo:hi]
                seen = np.fromiter(map(automaton.extend, part.tolist()), np.int64, len(part))
                breaks -= 1
                automaton.extend(breaks)  # no match reaches over the end of a stretch
                new = np.flatnonzero(open_[lo:hi - window + 1] & (seen[window - 1:] < window))
                for name, p in zip(("k1", "k2"), powers):
                    found[name].append(window_hashes(part, window, p)[new].view(np.int64))
                found["start"].append((new + lo).astype(np.int32))
                found["uid"] += [uid] * len(new)
                found["id"] += [doc] * len(new)
        return found

    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        spelling, powers = Powers(1), (Powers(0), Powers(1))
        held: list = []
        size = 0

        def out():
            f = shard(held, powers)
            held.clear()
            joined = {n: np.concatenate([np.empty(0, np.int64), *f[n]]) for n in ("k1", "k2", "start")}
            return pa.RecordBatch.from_arrays([
                pa.array(joined["k1"], pa.int64()), pa.array(joined["k2"], pa.int64()), pa.array(f["id"], to_arrow_type(kind)),
                pa.array(f["uid"], pa.int64()), pa.array(joined["start"].astype(np.int32), pa.int32()),
            ], names=["k1", "k2", "id", "uid", "start"])

        for batch in slices(batches):
            for doc, uid, ranges, t in zip(batch.column("id").to_pylist(), batch.column("uid").to_pylist(), batch.column("ranges").to_pylist(), texts(batch)):
                held.append((doc, uid, ranges, word_hashes(t, spelling)))
                size += sum(hi - lo for lo, hi in stretches(ranges))
                if size >= shard_words:
                    yield out()
                    size = 0
        if held:
            yield out()

    source = rows.select("id", "uid", "ranges", "text")
    ids = carried(source, ["id"], "uid long, start int")
    return arrow_map(source, run, carried(source, [], "k1 long, k2 long").add(ids["id"]).add(ids["uid"]).add(ids["start"]))


def removals(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(census, cuts). The census has uid, id, th, n_words, sha and ``copy`` (the whole text stands earlier) of every row;
    cuts has uid, id, th and ``starts``, the removed windows of first copies that lose some."""
    census = materialize(_census(docs, doc_id, text, window, gram), "census")
    long_ = census.filter(F.col("n_words") >= window)
    first = long_.groupBy("sha").agg(F.min(F.struct("id", "uid")).alias("m")).select(F.col("m.uid").alias("uid"), F.lit(True).alias("first"))
    first = materialize(first, "first")
    ranges = materialize(_open_windows(long_.join(first, "uid", "left_semi"), window), "open")
    places = _new_windows(_rows_with(docs, doc_id, text, ranges), window, shard_words)
    least = places.groupBy("k1", "k2").agg(F.min(F.struct("id", "uid", "start")).alias("m")).select("m.uid", "m.start")
    kept = least.groupBy("uid").agg(F.collect_list("start").alias("kept"))
    opened = F.flatten(F.transform("ranges", lambda r: F.sequence(r["lo"], r["hi"])))
    starts = F.array_except(opened, F.coalesce("kept", F.array().cast("array<int>")))
    cuts = ranges.join(kept, "uid", "left").select("uid", "id", "th", F.array_sort(starts).alias("starts")).filter(F.size("starts") > 0)
    marked = census.drop("grams", "firsts").join(first, "uid", "left")
    return marked.withColumn("copy", (F.col("n_words") >= window) & F.col("first").isNull()).drop("first"), materialize(cuts, "cuts")


def spans(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal word spans of the removed windows."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def _remains(words: list[bytes], starts: list[int], window: int) -> list[bytes]:
    out, at = [], 0
    for lo, hi in spans(starts, window):
        out += words[at:lo]
        at = hi
    return out + words[at:]


def cut_text(text: bytes, starts: list[int], window: int) -> bytes:
    """The text without the removed words; what is left between two cuts keeps its own white space, a space joins the parts."""
    places = [m.span() for m in _WORD.finditer(text)]
    parts, at = [], 0
    for lo, hi in [*spans(starts, window), (len(places), len(places))]:
        if lo > at:
            parts.append(text[places[at][0]:places[lo - 1][1]])
        at = hi
    return b" ".join(parts)


def digest(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every document."""
    census, cuts = removals(docs, doc_id=doc_id, text=text, window=window, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left = [_remains(t.split(), s, window) for t, s in zip(texts(batch), batch.column("starts").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("uid"), pa.array([len(w) for w in left], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in left]),
            ], names=["uid", "n_kept", "kept_sha"])

    partial = arrow_map(_rows_with(docs, doc_id, text, cuts).select("uid", "starts", "text"), run, "uid long, n_kept long, kept_sha string")
    partial = partial.groupBy("uid").agg(F.min("n_kept").alias("n_kept"), F.min("kept_sha").alias("kept_sha"))  # repeated rows find it twice
    n_kept = F.when(F.col("copy"), 0).otherwise(F.coalesce("n_kept", "n_words"))
    sha = F.when(F.col("copy"), F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha", "sha"))
    return census.join(partial, "uid", "left").select(
        F.col("id").alias("doc_id"), "n_words", (F.col("n_words") - n_kept).alias("n_removed"), sha.alias("kept_sha256"),
    )


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """The documents with repeated passages cut out of the text and all columns kept; one that loses every word is dropped."""
    census, cuts = removals(docs, doc_id=doc_id, text=text, window=window, **options)
    # What happens to an (id, text): all rows go, some windows go, or (repeated rows) all but one row go.
    acts = census.filter(F.col("n_words") >= window).groupBy("id", "th").agg(F.min("copy").alias("gone"), (F.count("*") > 1).alias("many"))
    acts = acts.join(cuts.select(F.col("id").alias("i"), F.col("th").alias("t"), "starts"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left").drop("i", "t")
    acts = materialize(acts.filter("gone OR many OR starts IS NOT NULL"), "acts")
    body = named(docs, text)[0].cast("string")
    rows = docs.select(F.struct(*named(docs, *docs.columns)).alias("row"), named(docs, doc_id)[0].alias("id_"), F.xxhash64(body).alias("th_"))
    joined = rows.join(acts, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left").filter("gone IS NULL OR NOT gone")
    if acts.filter("many AND NOT gone").take(1):
        once = joined.filter("many").groupBy("id_", "th_").agg(F.first("row").alias("row"), F.first("starts").alias("starts"))
        joined = joined.filter("many IS NULL OR NOT many").select("row", "starts").union(once.select("row", "starts"))
    joined = joined.select("row", "starts", F.col("row").getField(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bodies = texts(batch)
            starts = batch.column("starts").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array([t if s is None else cut_text(t, s, window) for t, s in zip(bodies, starts)], pa.binary()).cast(pa.string()),
            ], names=["row", "cut"])

    out = arrow_map(joined, run, carried(joined, ["row"], "cut string")).filter("cut IS NULL OR cut <> '' OR row.`" + text.replace("`", "``") + "` = ''")
    return out.select(*[F.col("cut").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
