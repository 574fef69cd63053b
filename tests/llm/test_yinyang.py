"""Product codes of Yinyang rounds against plain Lloyd rounds in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from harrow.llm import yinyang_codes
from harrow.llm.yinyang_codes import Codebooks, compress, reassign, squared


def lloyd(rows, parts, size, rounds, scale):
    kept = []
    for d, v, label in rows:
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((d, [math.floor(scale * x) for x in v], label))
    wide = len(kept[0][1]) // parts
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:size]
    books = [[r[1][p * wide : (p + 1) * wide] for r in start] for p in range(parts)]
    part = lambda v, p: v[p * wide : (p + 1) * wide]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for _, v, _ in kept:
                mine[near(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else b for b, m in zip(books[p], mine, strict=True)]
    out = [(d, [near(part(v, p), books[p]) for p in range(parts)], label) for d, v, label in kept]
    errors = [(d, "".join(f"{i:02x}" for _, i in x), sum(e for e, _ in x), label) for d, x, label in out]
    sums = {}
    for _, _, e, label in errors:
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((d, c, e, sums[label], sha) for d, c, e, label in errors), key=str)


def table(seed, n=400, dims=8):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) + 3 * (i % 5) for _ in range(dims)], i % 3 or None) for i in range(1, n)]
    grid = [(1000 + i, [float(r.randint(0, 1)) for _ in range(dims)], 7) for i in range(60)]  # ties
    bad = [(2000, None, 1), (2001, [], 1), (2002, [math.nan] * dims, 1), (2003, [math.inf] + [0.0] * (dims - 1), 1), (2004, [None] + [0.0] * (dims - 1), 1)]
    return [*rows, *grid, *bad, rows[5], rows[5], (None, rows[9][1], 1)]


@pytest.mark.parametrize("seed,size,cap", [(1, 40, 100_000), (2, 256, 0), (3, 1, 100_000)])
def test_equals_plain_rounds(spark, monkeypatch, seed, size, cap):
    monkeypatch.setattr(yinyang_codes, "GROUP_ENTRIES", 8)
    monkeypatch.setattr(yinyang_codes, "BROADCAST_LABELS", cap)
    rows = table(seed)
    frame = spark.createDataFrame([(*x, "e") for x in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = sorted(map(tuple, compress(frame, size=size).collect()), key=str)
    assert got == lloyd(rows, 4, size, 4, 1024)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert compress(spark.createDataFrame([(1, None, "a")], schema)).collect() == []
    got = compress(spark.createDataFrame([(5, [1.0] * 4, None), (5, [1.0] * 4, None), (6, [2.0] * 4, "x"), (7, [2.0] * 8, "x")], schema)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(5, "00000000", 0), (5, "00000000", 0), (6, "02020202", 0)]


def test_huge_components_are_exact():
    x = np.array([[2**26, -(2**26)], [1, 2]], np.int64)
    assert squared(x, -x).tolist() == [[2**55, (2**26 + 1) ** 2 + (2 - 2**26) ** 2], [(2**26 + 1) ** 2 + (2 - 2**26) ** 2, 20]]


def test_bounds_save_work_and_hold():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (64, 6))
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-40, 40, (3000, 6))
    books = Codebooks(centres[None] + rng.integers(-30, 30, (1, 64, 6)))
    own, low = np.full(3000, -1), np.zeros((3000, int(books.places[-1])), np.float32)
    for k in range(4):
        own, best, low, work = reassign(x, books, 0, own, low)
        full = ((x[:, None, :] - books.entries[0][None]) ** 2).sum(2)
        assert (own == full.argmin(1)).all() and (best == full.min(1)).all()
        full[np.arange(3000), own] = np.iinfo(np.int64).max
        for g, members in enumerate(books.members[0]):
            assert (low[:, g].astype(float) ** 2 <= full[:, members].min(1)).all()
        assert work < 0.3 * 3000 * 64 if k else work >= 3000 * 64
        books = books.moved(np.stack([[x[own == e].sum(0) // max(1, (own == e).sum()) if (own == e).any() else books.entries[0][e] for e in range(64)]]))
