"""Sharding, quality outliers, license scans and tool calls."""

import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import licenses, quality, shards, tool_calls
from tests.llm import samples

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- sharding --------------------------------------------------------------------------------------------------------

def test_communication_matrix():
    rng = np.random.default_rng(1)
    m = shards.communication_matrix([5, 0, 17, 1, 40], shards.exact_sizes(63, 4), rng)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 1, 40] and m.sum(axis=0).tolist() == [16, 16, 16, 15]
    large = shards.communication_matrix([10 ** 9, 3 * 10 ** 9, 7], shards.exact_sizes(4 * 10 ** 9 + 7, 3), rng)
    assert large.sum(axis=1).tolist() == [10 ** 9, 3 * 10 ** 9, 7] and large.sum(axis=0).tolist() == shards.exact_sizes(4 * 10 ** 9 + 7, 3)
    assert abs(large[0, 0] - 10 ** 9 / 3) < 10 * (10 ** 9 / 3) ** 0.5


def test_hypergeometric_beyond_numpy(monkeypatch):
    rng = np.random.default_rng(2)
    want = rng.hypergeometric(30, 70, 20, 20_000)
    monkeypatch.setattr(shards, "_NUMPY_MOST", 0)
    got = np.array([shards.hypergeometric(30, 70, 20, rng) for _ in range(20_000)])
    assert abs(got.mean() - want.mean()) < 0.06 and abs(got.std() - want.std()) < 0.06
    assert shards.hypergeometric(5, 0, 3, rng) == 3 and shards.hypergeometric(0, 5, 3, rng) == 0 and shards.hypergeometric(5, 5, 10, rng) == 5


@pytest.mark.parametrize("bucket_rows", [500_000, 2])
def test_shuffle(spark, bucket_rows):
    docs = samples.frame(spark)
    out = shards.shuffle(docs, shards=4, bucket_rows=bucket_rows)
    assert out.columns == [*docs.columns, "shard_", "slot"]
    rows = out.collect()
    assert Counter(tuple(r)[:-2] for r in rows) == Counter(samples.rows())
    sizes = Counter(r.shard_ for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 4
    assert all(sorted(r.slot for r in rows if r.shard_ == s) == list(range(n)) for s, n in sizes.items())
    assert shards.shuffle(samples.empty(spark)).count() == 0


def test_shuffle_is_uniform(spark):
    docs = spark.range(0, 40, 1, 5)
    seen = np.zeros((40, 40))
    for seed in range(24):
        for r in shards.shuffle(docs, shards=2, seed=seed, bucket_rows=7).collect():
            seen[r.id, r.shard * 20 + r.slot] += 1
    quarters = seen.reshape(4, 10, 4, 10).sum(axis=(1, 3))  # 60 expected in each
    assert abs(quarters - 60).max() < 36


def test_shard_digest_and_files(spark, tmp_path):
    got = shards.digest(samples.frame(spark)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in samples.rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    shards.write(shards.shuffle(spark.range(100), shards=3), str(tmp_path / "out"), file_rows=10)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3


# -- quality ---------------------------------------------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    cover = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark):
    got = Counter(tuple(r)[:6] + (r.base_failed, r.kept) for r in quality.digest(samples.frame(spark)).collect())
    want = Counter()
    for r in samples.rows():
        c = brute_counts(r[1])
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want[(r[0], *c, failed, not failed)] += 1  # too few documents for an estimate
    assert got == want
    assert quality.digest(samples.empty(spark)).count() == 0
    kept = quality.accept(samples.frame(spark))
    assert kept.columns == samples.frame(spark).columns


def brute_estimate(x, w):
    """Concentration steps on the rows themselves."""
    x = np.repeat(x, w, axis=0).astype(float)
    mean = np.median(x, axis=0)
    spread = 1.4826 * np.median(abs(x - mean), axis=0)
    cov = np.diag(spread ** 2 + np.square(quality.FLOORS))
    for _ in range(quality.STEPS):
        d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
        bins = np.floor(32 * np.log2(d + 1e-6)).astype(int)
        last = min(b for b in set(bins) if (bins <= b).sum() >= quality.COVERAGE * len(x))
        near = x[bins <= last]
        mean = near.mean(axis=0)
        cov = quality.CONSISTENT * np.cov(near.T, bias=True) + np.diag(np.square(quality.FLOORS).astype(float))
    return mean, np.linalg.inv(cov)


def test_minimum_covariance(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n in (("a", 400), ("b", 120), ("tiny", 10)):
        x = rng.multivariate_normal([5000, 1700, 500, 0, 900], np.diag([700, 100, 500, 1, 800]) ** 2 + 20_000, n).round().astype(int)
        x[: n // 6] = x[: n // 6] + [0, 0, 4000, 3000, 0]
        rows += [(g, *map(int, v), int(w)) for v, w in zip(x, rng.integers(1, 4, n))]
    table = spark.createDataFrame(rows, "g STRING, x0 LONG, x1 LONG, x2 LONG, x3 LONG, x4 LONG, w LONG")
    got = {r.g: r for r in quality.estimates(table).collect()}
    assert set(got) == {"a", "b"}
    for g in got:
        part = np.array([r[1:] for r in rows if r[0] == g])
        mean, inverse = brute_estimate(part[:, :5], part[:, 5])
        assert np.allclose(got[g].mean, mean) and np.allclose(got[g].inverse, [inverse[i, j] for i, j in quality._PAIRS], rtol=1e-6, atol=1e-12)
        assert got[g].mean[2] < 800  # the contaminated sixth has no pull


def test_quality_rejects_junk(spark):
    rows = [(i, samples.prose(i, 80 + i), ("en", "fr")[i % 2], "s", "", "", "", "") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "***" for w in samples.prose(i, 90).split()), "en", "s", "", "", "", "") for i in range(20)]
    got = {r.doc_id: r.kept for r in quality.digest(samples.frame(spark, rows + junk)).collect()}
    assert all(got[r[0]] for r in rows) and not any(got[r[0]] for r in junk)


def _junk(kind, k):
    words = samples.prose(900 + k, 120).split()
    if kind == "symbols":
        return " ".join(w + "#" * (i % 2) for i, w in enumerate(words)).replace("#", "##", 12)
    if kind == "words":
        return " ".join(words[:90] + words[60:90])
    lines = [" ".join(words[i:i + 4]) for i in range(0, 120, 4)]
    return "\n".join(lines[:8] + lines[:8] + lines[8:14])


def test_quality_rejects_a_third_of_copies_and_clear_single_outliers(spark):
    rows = [(i, samples.prose(i, 80 + i), "en", "s", "", "", "", "") for i in range(200)]
    copies = [(1000 + i, " ".join(w + "***" for w in samples.prose(1, 90).split()), "en", "s", "", "", "", "") for i in range(100)]
    singles = [(2000 + i, _junk(kind, i), "en", "s", "", "", "", "") for i, kind in enumerate(("symbols", "words", "lines"))]
    got = {r.doc_id: r.kept for r in quality.digest(samples.frame(spark, rows + copies + singles)).collect()}
    assert not any(got[r[0]] for r in copies + singles) and sum(not got[r[0]] for r in rows) <= 4


def test_equal_vectors_count_once(spark):
    rng = np.random.default_rng(5)
    x = rng.multivariate_normal([5000, 1700, 0, 0, 300], np.diag([500, 60, 1, 1, 200]) ** 2, 200).round().astype(int).tolist()
    table = spark.createDataFrame([("a", *v, 1) for v in x + [[5000 + i, 1700, 3500, 3000, 0] for i in range(80)]], "g STRING, x0 LONG, x1 LONG, x2 LONG, x3 LONG, x4 LONG, w LONG")
    assert quality.estimates(table).first().mean[2] < 100  # 29 % of different junk


def test_quality_has_one_rule_for_groups_of_all_sizes(spark):
    """A source's own words are told from its language's before it has 100 documents, and change no step at 100."""
    def far(n):
        rows = [(i, samples.prose(i, 80 + i), "en", "big", "", "", "", "") for i in range(150)]
        rows += [(1000 + i, samples.prose(i, 400), "en", "small", "", "", "", "") for i in range(n)]
        return {r.doc_id: r.distance for r in quality.digest(samples.frame(spark, rows)).collect()}[1000]

    at = {n: far(n) for n in (5, 60, 99, 101)}
    assert at[60] < 0.9 * at[5] and abs(at[101] - at[99]) < 0.1 * at[99]


# -- licenses --------------------------------------------------------------------------------------------------------

def brute_licenses(rows):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for license, body in licenses.TEMPLATES:
        t = cut(body)
        k = min(5, len(t))
        want = {tuple(t[i:i + k]) for i in range(len(t) - k + 1)}
        m = len(t) - k + 1
        stride = max(1, m // 5)
        for r in rows:
            w = cut(r[1])
            grams = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
            for at in range(0, max(len(grams) - m, 0) + 1, stride):
                share = len(want & set(grams[at:at + m + stride - 1])) / len(want)
                if grams and share >= 0.8:
                    best, n, first = out.get((r[0], license), (0, 0, at))
                    out[(r[0], license)] = (max(best, share), n + 1, min(first, at))
    return Counter((*k, *v) for k, v in out.items())


def test_licenses(spark):
    notices = dict(licenses.TEMPLATES)
    mit = notices["MIT-notice"]
    texts = [
        f"{samples.prose(1, 70)}. {notices['MIT']} {samples.prose(2, 30)}", mit, mit.upper(), mit.replace("free of charge", "at no charge"), mit.replace("granted", "given"),
        f"{mit} {samples.prose(3, 9)} {mit}", notices["Apache-2.0"].replace(" ", "\n"), "All rights reserved", "all rights", f"x {notices['GPL-3.0']} {notices['CC-BY-4.0']}",
        "licensed licensed licensed", None, "",
    ]
    rows = [(i, t, "en", "s", "", "", "", "") for i, t in enumerate(texts)]
    got = Counter(map(tuple, licenses.scan(samples.frame(spark, rows)).collect()))
    assert got == brute_licenses(rows)
    assert licenses.scan(samples.frame(spark)).count() == 0 and licenses.scan(samples.empty(spark)).count() == 0
    assert licenses.scan(samples.frame(spark), [("none", "...")]).count() == 0


# -- tool calls ------------------------------------------------------------------------------------------------------

CALLS = "scope STRING, call_id STRING, at LONG, name STRING, arguments STRING, after STRING"
TOOLS = {
    "add": (tool_calls.Parameter("a", "integer", least=0), tool_calls.Parameter("b", "number"), tool_calls.Parameter("note", "string", required=False, shortest=2)),
    "now": (),
}


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        ("s", "c1", 1, "add", '{"b": 2.5, "a": 1}', None), ("s", "c2", 2, "add", '{"a": -1, "b": "x", "z": [1]}', "c1"), ("s", "c3", 3, "now", " { } ", "c2"),
        ("s", "c4", 4, "add", "[1]", "lost"), ("s", "c5", 5, "add", "{bad", None), ("s", "c6", 6, "add", None, None), ("s", "c7", 7, "fly", "{}", None),
        ("s", "x", 8, "now", "{}", "y"), ("s", "y", 9, "now", "{}", "x"), ("s", "behind", 10, "now", "{}", "y"), ("s", "self", 11, "now", "{}", "self"),
        ("s", None, 12, "now", "{}", None), ("s", "c1", 1, "add", '{"b": 2.5, "a": 1}', None), ("s", "c8", 13, "add", '{"a": 1, "b": 1, "note": "n"}', "c3"),
        ("s", "c9", 14, "add", '{"a": null, "b": 1}', None), ("s", "ca", 15, "add", '{"a": 1, "a": 2, "b": 1}', None),
    ], CALLS)
    results = spark.createDataFrame([("s", "c1", 'said "é"\n'), ("s", "c1", 'said "é"\n'), ("s", "zz", "lost"), ("s", None, "gone"), ("s", "c3", None)], "scope STRING, call_id STRING, content STRING")
    got = {r.call_id: r for r in tool_calls.link(calls, results, TOOLS).collect()}
    assert len(got) == 16
    said = {k: (r.level, r.status, r.errors, r.copies) for k, r in got.items()}
    assert said == {
        "c1": (0, "linked", "", 2), "c2": (1, "invalid", "a: too small; b: not number; z: not in the schema", 1), "c3": (2, "linked", "", 1),
        "c4": (0, "invalid", "arguments are not an object", 1), "c5": (0, "invalid", "arguments are not an object", 1), "c6": (0, "invalid", "arguments are not an object", 1),
        "c7": (0, "invalid", "unknown tool", 1), "x": (None, "cycle", "", 1), "y": (None, "cycle", "", 1), "behind": (None, "cycle", "", 1), "self": (None, "cycle", "", 1),
        None: (None, "no identifier", "", 1), "c8": (3, "invalid", "note: too short", 1), "c9": (0, "invalid", "a: missing", 1),
        "ca": (0, "invalid", "arguments are not an object", 1), "zz": (None, "orphan result", "", 1),
    }
    assert got["c1"].json == '{"arguments":{"a":1,"b":2.5},"id":"c1","level":0,"name":"add","result":"said \\"é\\"\\n","status":"linked"}'
    assert all(json.loads(r.json) for r in got.values())


@pytest.mark.parametrize("n", [1, 2, 33, 64])
def test_levels_of_a_long_chain(spark, n):
    chain = spark.range(n).select(F.col("id").cast("string").alias("call_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("after"))
    assert {int(r.call_id): r.level for r in tool_calls.levels(chain).collect()} == {i: i for i in range(n)}


def test_conversations(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "x" * 301), (1, 3, "user", "x" * 301), (1, 5, "assistant", "lost"),
        (None, 1, "user", "who"), (2, None, "user", "when"), (3, 0, "tool", "what"), (3, 1, None, "why"), (3, 2, "user", None),
    ]
    turns = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING")
    got = Counter((r.conv_id, r.turn, r.level, r.status, r.errors, r.copies) for r in tool_calls.digest(turns).collect() if r.call_id)
    assert got == Counter([
        (1, 0, 0, "no result", "", 1), (1, 1, 1, "linked", "", 1), (1, 3, 2, "invalid", "prompt: too long", 2), (1, None, None, "orphan result", "", 1),
        (3, 0, 0, "invalid", "unknown tool", 1), (3, 1, 1, "invalid", "unknown tool", 1), (3, 2, 2, "invalid", "prompt: missing", 1),
    ])
    assert tool_calls.digest(turns).filter("call_id IS NULL").count() == 2  # a record for each row without identifier
    assert tool_calls.digest(turns.limit(0)).count() == 0


def test_tool_calls_lose_no_row(spark):
    rows = [
        (None, 1, "user", "who"), (None, 2, "user", "what"), (None, 2, "user", "what"), (7, None, "user", "when"), (None, 3, "assistant", "nobody"), (8, None, "assistant", None),
        (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 2, "user", "next"), (1, 3, "assistant", "yes"), (1, 3, "assistant", "no"), (1, 3, "assistant", "yes"),
        (1, 9, "assistant", "lost"), (1, 9, "assistant", "gone"), (2, 0, "user", "x"), (2, 1, "assistant", None), (2, 1, "assistant", "y"),
    ]
    turns = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING")
    got = Counter()
    for r in tool_calls.digest(turns).collect():
        j = json.loads(r.json)
        got[(r.conv_id, r.turn, r.call_id, r.level, r.status, r.copies, j.get("arguments", {}).get("prompt"), j.get("result"))] += 1
    assert got == Counter([
        (None, 1, None, None, "no identifier", 1, "who", None), (7, None, None, None, "no identifier", 1, "when", None),
        (None, 2, None, None, "no identifier", 1, "what", None), (None, 2, None, None, "no identifier", 1, "what", None),
        (None, None, None, None, "no identifier", 1, None, "nobody"), (8, None, None, None, "no identifier", 1, None, None),
        (1, 0, "1:0", 0, "conflict", 1, "a", None), (1, 0, "1:0", 0, "conflict", 2, "b", None), (1, 2, "1:2", 1, "conflict", 1, "next", "no"),
        (1, None, "1:2", None, "conflict", 2, None, "yes"), (1, None, "1:8", None, "orphan result", 1, None, "lost"), (1, None, "1:8", None, "orphan result", 1, None, "gone"),
        (2, 0, "2:0", 0, "conflict", 1, "x", "y"), (2, None, "2:0", None, "conflict", 1, None, None),
    ])
    assert tool_calls.digest(turns.limit(0)).count() == 0
