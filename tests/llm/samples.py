"""Small tables with the awkward cases: nulls, empty and odd texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, row STRING, shard STRING, ids STRING, fp STRING"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "", "a", "on", "é", "ß")) for _ in range(n))


def texts() -> list[str | None]:
    long_ = prose(1, 120)
    words = long_.split()
    return [
        long_, long_, None, "", " \n\t", "word", "two words", long_.upper(), " ".join(words[10:60]), prose(2, 30) + " " + " ".join(words[40:75]) + " " + prose(3, 15),
        "a " * 60, "b  b\tb\nb " * 12, prose(4, 2500), "日本語 テキスト ▁ 🎉", "A B C x", "\x00\x01 odd \x7f", "12 34 !! ##", prose(5, 60), prose(5, 60) + " tail",
        "Line one\nLine one\nLine two\n\nLine one",
    ]


def rows() -> list[tuple]:
    out = [(i, t, ("en", "fr", None)[i % 3], ("s0", None)[i % 2], "r", "s", "i", "f") for i, t in enumerate(texts())]
    out += [out[0], out[0], (None, out[0][1], "en", "s0", "r", "s", "i", "f"), (None, None, None, None, None, None, None, None), (7, prose(6, 40), "fr", "s0", "r", "s", "i", "f")]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def empty(spark):
    return frame(spark, [])
