"""Fill-in-middle against a plain re-implementation of its rules."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketry.llm import fim
from tests.llm import samples

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
EXTRA = ["has <P> inside", "has <S>", "<M>", "< P> almost <", " no break", "a\u0085b c", "é" * 30 + " ß\n\n 🎉 end \t", "x " * 700 + "y" * 900 + "  ", "<" * 50 + " <S <P"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(doc_id, text, seed=42, rate=50):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 80
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), sha(out), sha(text)


def rows():
    out = samples.rows()
    return out + [(1000 + 31 * i + k, t, "en", "s", "r", "s", "i", "f") for i, t in enumerate(EXTRA) for k in range(6)]


@pytest.mark.parametrize("rate,piece", [(50, fim.PIECE), (100, fim.PIECE), (100, 16)])
def test_digest(spark, rate, piece):
    got = Counter(map(tuple, fim.digest(samples.frame(spark, rows()), rate=rate, piece=piece).collect()))
    assert got == Counter(expected(r[0], r[1], rate=rate) for r in rows())
    assert {k[2] for k in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("text", [t for t in samples.texts() + EXTRA if t])
def test_pieces_change_no_unit(text):
    want = [len(text[:m.end()].encode()) for m in UNIT.finditer(text)]
    assert all(fim.unit_ends(text.encode(), piece) == want for piece in (1, 7, 64, fim.PIECE))


def test_a_very_long_text():
    text = b"hello  brave\nworld " * 400_000 + b" " * 1_000_000 + b"z" * 1_000_000
    ends = fim.unit_ends(text)
    assert len(ends) == 1_200_001 and ends[-1] == len(text) and ends[2] == 18


def test_texts_and_clashing_names(spark):
    docs = samples.frame(spark, rows()).withColumn("n", F.lit(7)).withColumn("output", F.lit("mine"))
    out = fim.with_output(docs, rate=100)
    assert out.columns == [*docs.columns, "n_", "form", "prefix_chars", "middle_chars", "output_"]
    back = out.withColumn("back", fim.restored(F.col("output_"), F.col("form")))
    assert back.filter("NOT back <=> coalesce(text, '')").isEmpty() and back.filter("form <> 'plain' AND output_ = text").isEmpty()
    assert fim.digest(samples.empty(spark)).count() == 0


def test_other_sentinels(spark):
    docs = samples.frame(spark)
    marks = ("[PRE]", "{SUF}", "|MID|x")
    with pytest.raises(ValueError):
        fim.transform(docs, sentinels=marks)
    for bad in (("<P>", "<P", "<M>"), ("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<S>")):
        with pytest.raises(ValueError):
            fim.checked(bad)
    marks = ("[PRE", "{SUF", "|MID")
    out = fim.with_output(docs, sentinels=marks, rate=100).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks))
    assert out.filter("NOT back <=> coalesce(text, '')").isEmpty() and not out.filter("form <> 'plain'").isEmpty()
