"""Pieces, token counts and language ID against brute force, round trips and held-out accuracy."""

import random
from collections import Counter

import pytest
import tiktoken  # noqa: F401

from basketry.llm import langid, pieces, token_counts
from basketry.llm.common import file_bytes
from tests.llm import samples


@pytest.fixture(scope="module")
def codec(spark):
    return pieces.codec(file_bytes(spark, pieces.MODEL))


def best_score(text, scores, lowest):
    """Highest total score of any segmentation, every substring tried."""
    best = [0.0] + [float("-inf")] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 16), e):
            if text[s:e] in scores:
                best[e] = max(best[e], best[s] + scores[text[s:e]])
        if text[e - 1] not in scores:
            best[e] = max(best[e], best[e - 1] + lowest)
    return best[-1]


def test_pieces_reach_the_best_score(codec):
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=pieces.MODEL)
    scores = {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
    for text in [t for t in samples.texts() if t] + ["  lead and  double ", "x" * 300, "mixed 日本 and ▁ marks"]:
        ids = codec.encode(text).tolist()
        plain = pieces.MARK + text.replace(" ", pieces.MARK)
        unknown = sum(c not in scores for c in plain)
        total = sum(p.get_score(i) for i in ids if not p.is_byte(i)) + unknown * codec.lowest
        assert total == pytest.approx(best_score(plain, scores, codec.lowest))


def test_pieces_round_trip(spark, codec):
    for text in samples.texts():
        if text is not None:
            assert codec.decode(codec.encode(text).tolist()) == text.replace(pieces.MARK, " ")
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice("ab é\n\t☃🎉0.,") for _ in range(r.randrange(30)))
        assert codec.decode(codec.encode(text).tolist()) == text
    docs = samples.frame(spark)
    rows = pieces.digest(docs).collect()
    assert len(rows) == len(samples.rows())
    assert all(r.lossless is None and r.ids is None and r.n_pieces == 0 or r.n_pieces == len(r.ids) for r in rows)
    encoded = pieces.encode(docs, keep=["doc_id"]).select("row.doc_id", "ids")
    back = Counter((r.row.doc_id, r.text) for r in pieces.decode(encoded, keep=["doc_id"]).collect())
    assert back == Counter((r[0], r[1] and r[1].replace(pieces.MARK, " ")) for r in samples.rows())
    added = pieces.with_ids(docs)
    assert added.columns == [*docs.columns, "ids_", "n_pieces"] and added.count() == len(rows)
    assert pieces.digest(samples.empty(spark)).count() == 0


def test_pieces_forget_without_change(codec, monkeypatch):
    want = [codec.encode(t).tolist() for t in samples.texts() if t]
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    codec.found, codec.older = {}, {}
    assert [codec.encode(t).tolist() for t in samples.texts() if t] == want


def test_token_counts(spark):
    sizes = [len(token_counts.encoding(file_bytes(spark, token_counts.VOCABULARY)).encode_ordinary(r[1] or "")) for r in samples.rows()]
    sums = token_counts.suffix_sums(token_counts.histogram(samples.frame(spark))).cache()
    rows = {r.n_tokens: r for r in sums.collect()}
    assert {n: r.n_docs for n, r in rows.items()} == Counter(sizes)
    for n, r in rows.items():
        over = [s for s in sizes if s > n]
        assert (r.docs_over, r.tokens_over, r.docs_within, r.tokens_within) == (len(over), sum(over), len(sizes) - len(over), sum(sizes) - sum(over))
        assert r.truncated_tokens == sum(min(s, n) for s in sizes) and r.share_within == pytest.approx(1 - len(over) / len(sizes))
    for limit in (-1, 0, 1, 57, 10 ** 6):
        got = token_counts.at_limits(sums, [limit])[0]
        within = [s for s in sizes if s <= limit]
        assert (got.docs_within, got.tokens_within, got.docs_over) == (len(within), sum(within), len(sizes) - len(within))
        assert got.truncated_tokens == (sum(min(s, limit) for s in sizes) if limit >= 0 else limit * len(sizes))
    ordered = sorted(sizes)
    assert token_counts.quantiles(sums, [0.0, 0.5, 1.0]) == [ordered[0], ordered[-(-len(ordered) // 2) - 1], ordered[-1]]
    none = token_counts.suffix_sums(token_counts.histogram(samples.empty(spark)))
    assert none.count() == 0 and token_counts.quantiles(none, [0.5]) == [None] and token_counts.at_limits(none, [5])[0].docs_over == 0


def test_token_counts_over_blocks(spark):
    counts = {1: 3, 4095: 2, 4096: 1, 9000: 5, 100_000: 1}
    sums = token_counts.suffix_sums(spark.createDataFrame(list(counts.items()), "n_tokens LONG, n_docs LONG"))
    assert {r.n_tokens: r.docs_over for r in sums.collect()} == {n: sum(d for m, d in counts.items() if m > n) for n in counts}


# -- language ID -----------------------------------------------------------------------------------------------------

def brute_grams(text):
    import re

    out = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        m = f"_{w}_"
        for n in (1, 2, 3):
            out.update(m[i:i + n] for i in range(len(m) - n + 1))
    out.pop("_", None)
    return out


def brute_rank(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:langid.PROFILE]]


def brute_predict(text, profiles):
    own = brute_rank(brute_grams(text))
    if not own or not profiles:
        return "und", 0.0
    far = lambda p: sum(abs(i - p[g]) if g in p else langid.PROFILE for i, g in enumerate(own))
    d, lang = min((far(p), lang) for lang, p in profiles.items())
    return lang, 1 - d / (langid.PROFILE * len(own))


@pytest.mark.parametrize("chars", [1 << 20, 50])
def test_language_id(spark, monkeypatch, chars):
    import zlib

    monkeypatch.setattr(langid, "CHARS_AT_ONCE", chars)
    rows = samples.rows()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts = {}
    for r in rows:
        if r[0] is not None and not out(r[0]) and r[1] is not None and r[2] is not None:
            counts.setdefault(r[2], Counter()).update(brute_grams(r[1]))
    profiles = {lang: {g: i for i, g in enumerate(brute_rank(c))} for lang, c in counts.items() if c}
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.digest(samples.frame(spark)).collect())
    want = Counter()
    for r in rows:
        lang, score = brute_predict(r[1], profiles)
        want[(r[0], out(r[0]), lang, round(score, 9))] += 1
    assert got == want
    kept = langid.accept(samples.frame(spark))
    assert kept.columns == samples.frame(spark).columns and kept.count() == sum(n for k, n in want.items() if k[2] != "und")
    assert langid.digest(samples.empty(spark)).count() == 0


def test_language_id_without_labels(spark):
    docs = samples.frame(spark, [(1, "some text", None, None, None, None, None, None)])
    assert [(r.lang_pred, r.score) for r in langid.digest(docs).collect()] == [("und", 0.0)]


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
