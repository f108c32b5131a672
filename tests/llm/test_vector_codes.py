"""Vector codes against a plain re-implementation, the Hilbert curve, shortlists and odd tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketry.llm import vector_codes as vc

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, code STRING, row STRING, uid LONG"


def expected(rows, entries=256, rounds=4, parts=4):
    """(vec_id, code, error, label_error, digest) of (vec_id, vector, label) rows in Python integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), n) for n, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            members = defaultdict(list)
            for c, f in zip(cut, found):
                members[f[p][1]].append(c[p])
            for n, m in members.items():
                books[p][n] = [sum(x) // len(m) for x in zip(*m)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, y), e in zip(kept, errors):
        by_label[y] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{n:02x}" for _, n in f), e, by_label[y], digest) for (i, _, y), f, e in zip(kept, found, errors))


def rows(n=300, width=8, seed=1):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    out = [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)], r.choice([0, 1, 2, None])) for i in range(n)]
    out += [(1000 + i, out[3][1], 1) for i in range(120)]  # a crowd of copies
    out += [(5, out[6][1], 2), (5, out[5][1], 2), (None, out[9][1], 0), (None, out[10][1], None)]
    out += [(2000, None, 1), (2001, [], 1), (2002, [None] + [0.0] * (width - 1), 1), (2003, [float("nan")] * width, 1), (2004, [float("inf")] + [0.0] * (width - 1), 1), (1, [-float("inf")] * width, 1)]
    r.shuffle(out)
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, v, y, "c", "r", 1) for i, v, y in data], SCHEMA)


@pytest.mark.parametrize("block,entries,rounds", [(256, 256, 4), (4, 16, 4), (1, 5, 2), (7, 256, 0)])
def test_digest(spark, block, entries, rounds):
    docs = frame(spark, rows()).repartition(5)
    got = Counter(map(tuple, vc.digest(docs, block=block, entries=entries, rounds=rounds).collect()))
    assert got == expected(rows(), entries, rounds)


def test_far_values_stay_exact(spark):
    big = [(i, [x and x * 1e5 for x in v] if v else v, y) for i, v, y in rows(60)]
    got = Counter(map(tuple, vc.digest(frame(spark, big), entries=20).collect()))
    assert got == expected(big, 20)
    with pytest.raises(Exception, match="too large"):
        vc.digest(frame(spark, [(1, [1e30] * 8, 0)])).collect()


def test_few_and_no_rows(spark):
    few = rows()[:7] + [(0, [0.0] * 8, None)]
    assert Counter(map(tuple, vc.digest(frame(spark, few)).collect())) == expected(few)
    nothing = [(1, None, 0), (2, [None] * 8, 1)]
    out = vc.digest(frame(spark, nothing))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    assert vc.digest(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        vc.digest(frame(spark, [(1, [1.0] * 6, 0)]))
    with pytest.raises(Exception, match="throughout|one length"):
        vc.digest(frame(spark, [(1, [1.0] * 8, 0), (2, [1.0] * 4, 0)])).collect()


def test_columns_and_decoding(spark):
    vectors = frame(spark, rows())
    coded, codebooks = vc.with_codes(vectors)
    assert coded.columns == [*vectors.columns, "code_", "error"] and coded.count() == 424
    back = vc.decoded(coded, codebooks, code="code_").select("row.*", "vector").collect()
    for r in back:
        off = sum((math.floor(1024 * x) - round(1024 * y)) ** 2 for x, y in zip(r.embedding, r.vector))
        assert off == r.error


@pytest.mark.parametrize("axes,bits", [(1, 4), (2, 4), (3, 3), (5, 2), (6, 1)])
def test_hilbert_curve_visits_neighbours(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    place = vc.hilbert(grid, bits)
    assert sorted(place.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_every_nearest_entry():
    r = np.random.default_rng(2)
    for _ in range(30):
        entries = r.integers(-40, 40, (30, 5))
        x = r.integers(-40, 40, (9, 5)) // r.integers(1, 9)
        near = vc.shortlists(x.min(axis=0)[None], x.max(axis=0)[None], entries)[0]
        d = ((x[:, None] - entries) ** 2).sum(axis=2)
        assert near[d.argmin(axis=1)].all() and (vc.nearest(x, entries)[1] == d.min(axis=1)).all() and (vc.nearest(x, entries)[0] == d.argmin(axis=1)).all()
    one = vc.shortlists(np.array([[3, 3]]), np.array([[3, 3]]), np.array([[3, 3], [9, 9], [3, 3]]))
    assert one.tolist() == [[True, False, True]]  # ties stay, so the lower number can win
