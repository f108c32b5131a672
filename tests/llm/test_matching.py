"""Decontamination, substring dedup and SimHash against brute force."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash

from basketry.llm import components, decontaminate, simhash, substring_dedup
from tests.llm import samples

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def multiset(df):
    return Counter(map(tuple, df.collect()))


# -- decontamination -------------------------------------------------------------------------------------------------

def hit_words(text, items, window):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    words, hit, names = cut(text), set(), set()
    for item, body in items:
        b = cut(body)
        k = min(window, len(b))
        grams = {tuple(b[i:i + k]) for i in range(len(b) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                if item is not None:
                    names.add(str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def benchmark():
    words = samples.texts()[0].split()
    return [
        (1, " ".join(words[20:45])), (2, "two words"), (10, samples.prose(2, 30)), (None, "Line two"), (3, None), (4, ""), (5, "never seen at all"), (6, " ".join(words[20:45])),
        (1, "tail"), (7, "b b b"),
    ]


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_decontaminate(spark, block_bytes):
    bench = spark.createDataFrame(benchmark(), "item_id LONG, text STRING")
    got = multiset(decontaminate.digest(samples.frame(spark), bench, block_bytes=block_bytes))
    assert got == Counter((r[0], *hit_words(r[1], benchmark(), 10)) for r in samples.rows())


def test_decontaminate_edges(spark):
    none = spark.createDataFrame([], "item_id LONG, text STRING")
    assert not any(r.contaminated for r in decontaminate.digest(samples.frame(spark), none).collect())
    bench = spark.createDataFrame(benchmark(), "item_id LONG, text STRING")
    assert decontaminate.digest(samples.empty(spark), bench).count() == 0
    clean = decontaminate.clean(samples.frame(spark), bench)
    want = [r for r in samples.rows() if not hit_words(r[1], benchmark(), 10)[-1]]
    assert clean.columns == samples.frame(spark).columns and multiset(clean) == Counter(want)


def test_longest_matches(spark):
    words = samples.texts()[0].split()
    bench = spark.createDataFrame([(1, " ".join(["zz"] + words[20:45] + ["zz"])), (2, "nothing here")], "item_id LONG, text STRING")
    got = decontaminate.longest_matches(samples.frame(spark, samples.rows()[:1]), bench).collect()
    assert [(r.item_id, r.n_words, r.item_start, r.doc_id, r.doc_start) for r in got] == [("1", 25, 1, 0, 20)]


# -- substring dedup -------------------------------------------------------------------------------------------------

def removed(rows, window):
    """(id, words, removed words, kept digest) with rows in order of id, nulls first, equal ids as given."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        words = WORD.findall(rows[i][1] or "")
        gone = set()
        for s in range(len(words) - window + 1):
            gram = tuple(words[s:s + window])
            if gram in seen:
                gone |= set(range(s, s + window))
            seen.add(gram)
        kept = [w for j, w in enumerate(words) if j not in gone]
        out.append((rows[i][0], len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window,gram,shard_words", [(20, 8, 1 << 17), (20, 8, 50), (5, 8, 30), (3, 2, 1 << 17)])
def test_substring_dedup(spark, window, gram, shard_words):
    got = multiset(substring_dedup.digest(samples.frame(spark), window=window, gram=gram, shard_words=shard_words))
    assert got == removed(samples.rows(), window)


def test_substring_dedup_texts(spark):
    docs = samples.frame(spark)
    out = substring_dedup.dedup(docs)
    assert out.columns == docs.columns
    want = removed(samples.rows(), 20)
    left = Counter({k: n for k, n in want.items() if k[1] > k[2] or k[1] == 0})
    got = Counter((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in out.collect())
    assert got == Counter({k: n for k, n in Counter((x[0], x[3]) for x in left.elements()).items()})
    assert substring_dedup.dedup(samples.empty(spark)).count() == 0 and substring_dedup.digest(samples.empty(spark)).count() == 0


def test_suffix_automaton():
    text = "abcabcabdabcabd"
    a = substring_dedup.SuffixAutomaton()
    got = [a.extend(c) for c in text]
    want = [max((n for n in range(e + 2) if n == 0 or text[e + 1 - n:e + 1] in text[:e]), default=0) for e in range(len(text))]
    assert got == want


def test_cut_text():
    assert substring_dedup.cut_text(b"a  b c\nd e  f", [1, 2], 2) == b"a e  f"
    assert substring_dedup.cut_text(b"a b", [0], 2) == b""


# -- SimHash ---------------------------------------------------------------------------------------------------------

def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(values, radius=3):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash(spark):
    rows = samples.rows()
    prints = [fingerprint(r[1]) for r in rows]
    label = reachable(prints)
    ids = {root: min((rows[i][0] for i in range(len(rows)) if label[i] == root and rows[i][0] is not None), default=None) for root in set(label)}
    got = multiset(simhash.digest(samples.frame(spark)))
    assert got == Counter((r[0], f"{p:016x}", ids[label[i]]) for i, (r, p) in enumerate(zip(rows, prints)))
    kept = simhash.near_dedup(samples.frame(spark))
    assert kept.columns == samples.frame(spark).columns and kept.count() == len(set(label))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(ids.values())
    assert simhash.digest(samples.empty(spark)).count() == 0 and simhash.near_dedup(samples.empty(spark)).count() == 0


@pytest.mark.parametrize("many", [False, True])
def test_ball_links(spark, monkeypatch, many):
    import random

    if many:  # crowded halves are unfolded in turns, key by key
        monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 2000)
        monkeypatch.setattr(simhash, "ROWS_AT_ONCE", 300)
    r = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(25):
        x = r.getrandbits(64)
        values.add(x)
        for flips in (1, 2, 3, 3, 4):
            y = x
            for b in r.sample(range(64), flips):
                y ^= 1 << b
            values.add(y)
    x = r.getrandbits(64)
    values |= {x ^ (a << 40) for a in range(40)}  # many in one half
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    if many:
        import numpy as np

        keys, fps = [], []
        for v in values:
            for side, half in ((0, v >> 32), (1, v & 0xFFFFFFFF)):
                for f in [0, *(1 << b for b in range(32))]:
                    keys.append(side << 32 | half ^ f)
                    fps.append(v)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64)[order].view(np.int64)), pa.array(np.array(fps, np.uint64)[order].view(np.int64))], names=["key", "fp"])
        pairs = [p for b in simhash._meet(iter([batch.slice(0, 100), batch.slice(100)])) for p in zip(*map(lambda c: c.to_pylist(), b.columns))]
        edges = spark.createDataFrame(pairs, "u LONG, v LONG")
    else:
        edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp LONG"))
    roots = {n: k for n, k in components.components(edges).collect()}
    label = reachable(values)
    groups = {}
    for i, s in enumerate(signed):
        groups.setdefault(label[i], set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (200, 170), (150, 170)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "u LONG, v LONG")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 170: 150, 200: 150}
    assert components.components(spark.createDataFrame([], "u LONG, v LONG")).count() == 0
