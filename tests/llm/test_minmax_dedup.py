"""Min-max near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from harrow.llm import minmax_dedup
from harrow.llm.minmax_dedup import near_duplicates, signatures

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, share):
    sets = []
    for _, t in rows:
        w = tuple((t or "").translate(LOWER).encode().split())
        sets.append({w[i : i + width] for i in range(len(w) - width + 1)} if len(w) >= width else {w} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i))
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = [f"W{i}É" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one  two "), (7, "two one"), (8, "x " * 5000)]
    base = [r.choice(words) for _ in range(120)]
    for i in range(10, 90):  # a chain of copies, each changed a little more
        t = list(base) if i < 40 else [r.choice(words) for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, " ".join(t)))
        if i >= 40:
            rows.append((i + 200, " ".join(["changed", *t[1:]])))
            rows.append((i + 400, " ".join(t[: len(t) - len(t) // 9])))
    template = [r.choice(words) for _ in range(60)]
    rows += [(1000 + i, " ".join([f"a{i}"] * 8 + template + [f"b{i}"] * 8)) for i in range(50)]  # alike, not linked
    return [*rows, rows[20], rows[20], (None, rows[20][1]), (None, "alone here"), (None, "alone here")]


@pytest.mark.parametrize("crowd", [1000, 2])
@pytest.mark.parametrize("width", [4, 1])
def test_equals_all_pairs(spark, monkeypatch, crowd, width):
    monkeypatch.setattr(minmax_dedup, "CROWD", crowd)
    rows = corpus(width)
    frame = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, node int, `a.b` string").repartition(3)
    got = sorted(map(tuple, near_duplicates(frame, width=width).collect()), key=str)
    assert [x[:3] for x in got] == [x[:3] for x in brute(rows, width, 80)]
    assert all(k == (d == c) for d, _, c, k in got if d is not None)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimate_is_unbiased_and_lower_in_variance():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (160, 20, 20))
        low, high = signatures([np.concatenate([both, a]), np.concatenate([both, b])], 60)
        errors.append(((low[0] == low[1]).mean() + (high[0] == high[1]).mean()) / 2 - 0.8)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < (0.8 * 0.2 / 60) ** 0.5 * 0.85  # that of 60 minima alone, with room
