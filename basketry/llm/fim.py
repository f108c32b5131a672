"""Fill-in-middle transformation: documents cut at two random word boundaries and put in another order.

One full match of ``(unit)*`` with the regex library keeps the end of every repetition, so ``ends`` of its group gives
the number of units and both cut offsets at once. A unit is a word with the white space before it, or white space that
ends the text. Matching runs over UTF-8 bytes, where the same classes mean the same, since all of them are ASCII. A text
longer than PIECE is matched in pieces that end where a word ends, which is always the end of a unit: the library keeps
about 300 bytes for a unit and takes no more than some three million of them at once.

The draws come from a digest of seed and key, so a document is cut alike wherever and whenever it is read. Undoing is
native: sentinels never occur in a text that is cut, so each stands in the output once.

Defined results: a null text is an empty one; empty texts, texts that hold a sentinel and those not drawn stay plain; a
null key draws from the seed alone; equal keys draw alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import arrow_map, carried, free, named, slices, texts, unpacked, with_text

SENTINELS = ("<P>", "<S>", "<M>")
RATE = 50  # of 100 documents, how many are cut
SPM_RATE = 80  # of 100 cut documents, how many start with the suffix
PIECE = 512 << 10

_UNITS = regex.compile(rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)*")
_WORD_END = re.compile(rb"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")


def unit_ends(text: bytes, piece: int = PIECE) -> list[int]:
    """Where each unit of ``text`` ends."""
    if len(text) <= piece:
        return _UNITS.fullmatch(text).ends(1)
    found, start = [], 0
    while start < len(text):
        edge = _WORD_END.search(text, start + piece)
        stop = edge.end() if edge else len(text)
        found += _UNITS.fullmatch(text, start, stop).ends(1)
        start = stop
    return found


def draws(seed: int, key: Column) -> Column:
    """Four unsigned 32-bit numbers: the first hexadecimal digits of the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    """Sentinels that cannot arise where a text and a sentinel meet."""
    rest = "".join(s[1:] for s in sentinels)
    if len(sentinels) != 3 or not all(sentinels) or any(s[0] in rest for s in sentinels) or any(a != b and b.startswith(a) for a in sentinels for b in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("three sentinels are needed, none a start of another, whose first characters occur only there")
    return tuple(sentinels)


def transform(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE,
    sentinels: Sequence[str] = SENTINELS, keep: list[str] | None = None, piece: int = PIECE,
) -> DataFrame:
    """``row`` (carried columns), ``n``, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output``."""
    p, s, m = (x.encode() for x in checked(sentinels))
    source = with_text(docs, text, keep, drawn=draws(seed, named(docs, key)[0]))

    def cut(t: bytes, h: Sequence[int]) -> tuple:
        ends = [0, *unit_ends(t, piece)]
        n = len(ends) - 1
        if not t or p in t or s in t or m in t or h[2] % 100 >= rate:
            return n, "plain", None, None, t
        a, b = sorted((ends[h[0] % (n + 1)], ends[h[1] % (n + 1)]))
        prefix, middle, suffix = t[:a], t[a:b], t[b:]
        spm = h[3] % 100 < spm_rate
        output = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
        return n, "spm" if spm else "psm", len(prefix.decode()), len(middle.decode()), output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            drawn = batch.column("drawn").flatten().to_numpy().reshape(-1, 4).tolist()
            made = [cut(t or b"", h) for t, h in zip(texts(batch), drawn)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([x[k] for x in made], kind) for k, kind in enumerate(kinds)]
            columns[4] = columns[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", *NEW])

    return arrow_map(source, run, carried(source, ["row"], "n long, form string, prefix_chars long, middle_chars long, output string"))


NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output of ``transform`` was made from."""
    p, s, m = (F.lit(x) for x in checked(sentinels))
    part = lambda start, end: F.split_part(F.split_part(output, start, F.lit(2)), end, F.lit(1))
    middle = F.split_part(output, m, F.lit(2))
    return (
        F.when(form == "psm", F.concat(part(p, s), middle, part(s, m)))
        .when(form == "spm", F.concat(part(p, m), middle, part(s, p)))
        .otherwise(output)
    )


def with_output(docs: DataFrame, **options) -> DataFrame:
    """The documents with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``; a taken name gets an underscore."""
    names = free(docs.columns, *NEW)
    return unpacked(transform(docs, **options), *[F.col(a).alias(b) for a, b in zip(NEW, names)])


def digest(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text restored from it."""
    made = transform(docs, keep=[doc_id], key=doc_id, **options)
    back = restored(F.col("output"), F.col("form"), options.get("sentinels", SENTINELS))
    return unpacked(made, *NEW[:4], F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
