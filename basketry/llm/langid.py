"""Language ID by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the most frequent letter n-grams of a language in rank order, learned from all training documents. A
document's own most frequent n-grams are compared with every profile by the out-of-place distance: how far each n-gram
has moved, or the profile's length if it is missing there.

Defined results: a null text, or one without letters, is ``und`` with score 0, and so is every text when nothing was
learned; of equally near languages the first by name wins; n-grams of equal count rank by code point; documents without
a label or text teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import arrow_map, carried, named, slices, unpacked, with_text

ORDER = 3
PROFILE = 300
# Most languages a model may hold; the profiles handed to the tasks are at most this many times PROFILE n-grams.
MOST_LANGUAGES = 10_000
# Characters that a task counts at once, and distinct n-grams after which it passes its counts on.
CHARS_AT_ONCE = 1 << 20
COUNTS_AT_ONCE = 200_000

_OTHER = re.compile(r"[\W\d_]+")
_BITS = 21  # of a code point
_MARK = ord("_")


def marked(text: str | None) -> str:
    """The lower-case words (runs of letters), a mark at either end of each; empty if there is none."""
    body = _OTHER.sub("__", text.lower()).strip("_") if text else ""
    return f"_{body}_" if body else ""


def grams(body: str) -> np.ndarray:
    """Codes of the one- to three-character n-grams inside the marked words. Codes sort as the n-grams do as strings."""
    chars = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    mark = chars == _MARK
    cross = mark[:-1] & mark[1:]
    two = chars[:-1] << 2 * _BITS | chars[1:] << _BITS
    three = two[:-1] | chars[2:]
    return np.concatenate([chars[~mark] << 2 * _BITS, two[~cross], three[~(cross[:-1] | cross[1:])]])


def spelled(code: int) -> str:
    return "".join(chr(c) for k in range(ORDER) if (c := code >> (ORDER - 1 - k) * _BITS & (1 << _BITS) - 1))


def coded(gram: str) -> int:
    return sum(ord(c) << (ORDER - 1 - k) * _BITS for k, c in enumerate(gram))


def pieces(body: str) -> Iterator[str]:
    """Marked words in pieces of about CHARS_AT_ONCE, cut between words."""
    at = 0
    while len(body) - at > CHARS_AT_ONCE and (cut := body.find("__", at + CHARS_AT_ONCE)) > 0:
        yield body[at:cut + 1]
        at = cut + 1
    yield body[at:]


def ranked(body: str) -> np.ndarray:
    """The text's most frequent codes in rank order; of equal counts the lower code first."""
    counts = Counts()
    counts.add(body)
    codes, n = counts.total()
    return codes[np.argsort(-n, kind="stable")[:PROFILE]]


class Counts:
    """n-gram counts of one language, summed in arrays."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, body: str) -> None:
        self.parts += [np.unique(grams(piece), return_counts=True) for piece in pieces(body)]

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) == 1:
            return self.parts[0]
        codes, index = np.unique(np.concatenate([c for c, _ in self.parts]), return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, index, np.concatenate([n for _, n in self.parts]))
        self.parts = [(codes, counts)]
        return codes, counts


def profiles(docs: DataFrame, *, text: str = "text", label: str = "lang") -> DataFrame:
    """(lang, rank, gram): the most frequent n-grams of each label over all rows that have a label and a text."""
    source = docs.select(named(docs, label)[0].cast("string").alias("lang"), named(docs, text)[0].cast("string").alias("text")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counts] = {}

        def out():
            rows = [(lang, spelled(c), n) for lang, counts in held.items() for c, n in zip(*map(np.ndarray.tolist, counts.total()))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

        for batch in slices(batches):
            waiting: dict[str, list[str]] = {}
            size: dict[str, int] = {}
            for lang, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if body := marked(body):
                    waiting.setdefault(lang, []).append(body)
                    size[lang] = size.get(lang, 0) + len(body)
                    if size[lang] >= CHARS_AT_ONCE:
                        held.setdefault(lang, Counts()).add("".join(waiting.pop(lang)))
                        size[lang] = 0
            for lang, bodies in waiting.items():
                held.setdefault(lang, Counts()).add("".join(bodies))
            if sum(len(counts.total()[0]) for counts in held.values()) >= COUNTS_AT_ONCE:
                yield out()
        yield out()

    counts = arrow_map(source, count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", place).filter(F.col("rank") <= PROFILE).select("lang", (F.col("rank") - 1).alias("rank"), "gram")


class Model:
    """Rank of every known n-gram in every language (PROFILE where it is missing)."""

    def __init__(self, rows: list[tuple[str, int, str]]):
        self.languages = sorted({lang for lang, _, _ in rows})
        column = {lang: i for i, lang in enumerate(self.languages)}
        self.codes = np.unique(np.array([coded(g) for _, _, g in rows], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), PROFILE, np.int64)
        for lang, rank, gram in rows:
            self.ranks[np.searchsorted(self.codes, coded(gram)), column[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); the score is 1 for a text with exactly the profile's order and 0 for one with none of its n-grams."""
        body = marked(text)
        if not body or not self.languages:
            return "und", 0.0
        own = ranked(body)
        at = np.searchsorted(self.codes, own)
        at = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == own, at, len(self.codes))
        known = self.ranks[at]
        moved = np.where(known == PROFILE, PROFILE, np.abs(known - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(moved.argmin())
        return self.languages[best], 1.0 - float(moved[best]) / (PROFILE * len(own))


def fit(docs: DataFrame, **options) -> list[tuple[str, int, str]]:
    """The profiles as a list: bounded by MOST_LANGUAGES times PROFILE rows, checked before they are fetched."""
    table = profiles(docs, **options).cache()
    try:
        if (n := table.select("lang").distinct().count()) > MOST_LANGUAGES:
            raise ValueError(f"{n} languages; a model holds {MOST_LANGUAGES} at most")
        return [tuple(r) for r in table.collect()]
    finally:
        table.unpersist()


def predict(docs: DataFrame, rows: list[tuple[str, int, str]], *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (carried columns), ``lang_pred`` and ``score``; only the text is read."""
    source = with_text(docs, text, keep)
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in slices(batches):
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
            ], names=["row", "lang_pred", "score"])

    return arrow_map(source, run, carried(source, ["row"], "lang_pred string, score double"))


def held_out(doc_id):
    """Whether a document's label is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def taught(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that may teach: not held out, and with an id to tell."""
    return docs.filter(~held_out(named(docs, doc_id)[0]))


def digest(docs: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    out = unpacked(predict(docs, fit(taught(docs, doc_id)), keep=[doc_id]), "lang_pred", "score")
    return out.select(doc_id, F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, *, doc_id: str = "doc_id", least: float = 0.0) -> DataFrame:
    """The documents in a language that was recognised with a score of ``least`` or more, with their own columns."""
    found = predict(docs, fit(taught(docs, doc_id)))
    return unpacked(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)))
