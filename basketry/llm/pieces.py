"""SentencePiece encoding and decoding by maximum-score segmentation.

An Aho-Corasick automaton over the pieces reads a text once. At each character its output links name all pieces that end
there, longest first; each relaxes the best score of that position, and the back pointers give the ids (Viterbi). No
piece reaches over the start of a space mark that follows another character, so the best path goes through every such
place and is found between them one after another; what was found for a stretch is remembered up to a bound.

A character without a piece costs the unknown score and becomes its UTF-8 byte pieces where the model has them.
Decoding joins the pieces, turns marks into spaces and drops the one that encoding put in front. A text that holds the
mark character itself comes back with a space in its place; every other text comes back unchanged when the model has
byte pieces.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; of equal scores the longer last
piece wins. Models that normalise characters or squeeze spaces are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import arrow_map, carried, file_bytes, free, lists, slices, unpacked, with_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Fixed values of the model format: kinds of pieces, and how far an unknown character scores below the worst piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNKNOWN_PENALTY = 10.0
# Stretches remembered, and as many older ones.
REMEMBERED = 250_000

_codecs: dict[int, Codec] = {}


class Codec:
    """One model, ready to encode and decode."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as format

        spec = format.ModelProto()
        spec.ParseFromString(model)
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep the text as it is are read")
        self.prefix = rules.add_dummy_prefix
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = []
        self.unknown = 0
        plain = [p.score for p in spec.pieces if p.type == NORMAL]
        least, most = min(plain, default=0.0), max(plain, default=0.0)
        cut = True
        for i, p in enumerate(spec.pieces):
            if p.type in (NORMAL, USER_DEFINED):
                score = p.score if p.type == NORMAL else len(p.piece) * most - 0.1
                self.automaton.add_word(p.piece, (len(p.piece), score, i))
                if len(p.piece) == 1:
                    self.single.add(p.piece)
                cut &= MARK not in p.piece.lstrip(MARK)
                self.surface.append(p.piece.replace(MARK, " ").encode())
            elif p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.surface.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.surface.append(spec.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else b"")
                if p.type == UNKNOWN:
                    self.unknown = i
        self.automaton.make_automaton()
        self.lowest = least - UNKNOWN_PENALTY
        # White space that is in no piece stands alone on every path, so stretches end there too.
        alone = "".join(c for c in "\n\t\r" if not any(c in p.piece for p in spec.pieces))
        self.stretches = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else "") if cut else "(?s).+")
        self.found: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path through one stretch."""
        n = len(text)
        score, start_of, piece_of = [0.0] + [float("-inf")] * n, [0] * (n + 1), [-1] * (n + 1)
        if self.single.issuperset(text):  # every position is reached by a piece
            for end, (length, value, piece) in self.automaton.iter(text):
                value += score[end + 1 - length]
                end += 1
                if value > score[end]:
                    score[end], start_of[end], piece_of[end] = value, end - length, piece
        else:
            unknown = [c not in self.single for c in text]
            lowest, done = self.lowest, 0
            for end, (length, value, piece) in chain(self.automaton.iter(text), [(n, (0, 0.0, 0))]):
                while done < end:  # all pieces that end before this one are in
                    if unknown[done] and score[done] + lowest > score[done + 1]:
                        score[done + 1], start_of[done + 1], piece_of[done + 1] = score[done] + lowest, done, -1
                    done += 1
                if length and score[end + 1 - length] + value > score[end + 1]:
                    score[end + 1], start_of[end + 1], piece_of[end + 1] = score[end + 1 - length] + value, end + 1 - length, piece
        ids: list[int] = []
        at = n
        while at:
            if piece_of[at] >= 0:
                ids.append(piece_of[at])
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(text[start_of[at]:at].encode())]
            else:
                ids.append(self.unknown)
            at = start_of[at]
        return ids[::-1]

    def packed(self, stretch: str) -> bytes:
        """Ids of a stretch that is not among the newest; what was used lately is kept when memory is full."""
        ids = self.older.get(stretch) or np.array(self.viterbi(stretch), np.int32).tobytes()
        if len(stretch) <= 64:
            if len(self.found) >= REMEMBERED:
                self.older, self.found = self.found, {}
            self.found[stretch] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        packed = self.packed
        return np.frombuffer(b"".join([self.found.get(s) or packed(s) for s in self.stretches.findall(text)]), np.int32)

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids))
        return (text[1:] if self.prefix and text[:1] == b" " else text).decode(errors="replace")


def codec(model: bytes) -> Codec:
    """The codec of a model, built once in each Python worker."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _encoded(batch: pa.RecordBatch, c: Codec) -> tuple[pa.Array, list]:
    ids = [None if t is None else c.encode(t) for t in batch.column("text").to_pylist()]
    column = lists(np.concatenate([np.empty(0, np.int32), *(i for i in ids if i is not None)]), [0 if i is None else len(i) for i in ids], pa.int32())
    return pa.ListArray.from_arrays(column.offsets, column.values, mask=pa.array([i is None for i in ids])), ids


def encode(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, model: str = MODEL, check: bool = False) -> DataFrame:
    """``row`` (carried columns), ``ids`` and ``n_pieces``; with ``check`` also whether they decode to the text (``lossless``)."""
    source = with_text(docs, text, keep)
    shared = docs.sparkSession.sparkContext.broadcast(file_bytes(docs.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in slices(batches):
            column, ids = _encoded(batch, c)
            out = [batch.column("row"), column, pa.array([0 if i is None else len(i) for i in ids], pa.int64())]
            if check:
                out.append(pa.array([None if i is None else c.decode(i.tolist()) == t for i, t in zip(ids, batch.column("text").to_pylist())], pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, names=["row", "ids", "n_pieces", *["lossless"] * check])

    return arrow_map(source, run, carried(source, ["row"], "ids array<int>, n_pieces long" + ", lossless boolean" * check))


def decode(encoded: DataFrame, *, ids: str = "ids", keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """``row`` (carried columns) and ``text`` of every list of ids; an id outside the model fails."""
    keep = encoded.columns if keep is None else keep
    source = encoded.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(file_bytes(encoded.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            found = [None if i is None else c.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], names=["row", "text"])

    return arrow_map(source, run, carried(source, ["row"], "text string"))


def with_ids(docs: DataFrame, **options) -> DataFrame:
    """The documents with their ids, the number of pieces and whether the ids decode to the text (null for a null text)."""
    added = ("ids", "n_pieces", "lossless")
    names = free(docs.columns, *added)
    return unpacked(encode(docs, check=True, **options), *[F.col(a).alias(b) for a, b in zip(added, names)])


def digest(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, ids, n_pieces and lossless of every document."""
    return unpacked(encode(docs, keep=[doc_id], check=True, **options), "ids", "n_pieces", "lossless")
