"""Importance resampling against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from harrow.llm import ngram_resampling
from harrow.llm.ngram_resampling import resample, suffix_array, word_ids

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, aims, longest, buckets, least, percent):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in rows for g in grams(t, longest)[1])
    t = Counter(bucket(g) for x in aims for g in grams(x, longest)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    out = []
    for d, x in rows:
        w, g = grams(x, longest)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(y)] for y in g)
        out.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=str)


def corpus(seed=5):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(40)] + ["Éa", "é", "naïve", "数据", "ab9", "x_y", "don't", "a b"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "!!! \n"), (903, "one"), (None, rows[7][1]), (None, None), rows[9], rows[9], (904, "tie " * 3000)]
    return rows, [t for _, t in rows[:9]] + [None, "", "zz Éa é w3 w3"]


@pytest.mark.parametrize("longest,buckets,piece", [(1, 10_000, 4 << 20), (3, 70_000, 300), (2, 7, 1)])
def test_equals_plain_counting(spark, monkeypatch, longest, buckets, piece):
    monkeypatch.setattr(ngram_resampling, "PIECE_TEXT", piece)
    rows, aims = corpus()
    docs = spark.createDataFrame([(*x, 0, "s") for x in rows], "doc_id long, text string, rank int, `a.b` string").repartition(3)
    target = spark.createDataFrame([(x,) for x in aims], "text string")
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"], r.n_words) for r in resample(docs, target, longest=longest, buckets=buckets, percent=30).collect()]
    want = brute(rows, aims, longest, buckets, 20, 30)
    bare = lambda x: sorted((r[:4] + r[5:] for r in x), key=str)
    assert bare(got) == bare(want)
    ranked = lambda x: sorted((r[4], r[0], r[3]) for r in x if r[4])
    assert ranked(got) == ranked(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert resample(docs, docs).collect() == []
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in resample(one, docs, least_words=1).collect()}
    assert got[2].weight == 0 and got[2].n_features == 0 and got[1]["rank"] is None


def test_suffixes_stand_in_order(spark):
    import numpy as np

    raw = np.frombuffer(b"b a b a b c a b", np.uint8)
    ids, words, bounds = word_ids(raw, np.array([0, 10, len(raw)]))
    assert [words[i] for i in ids] == [b"b", b"a", b"b", b"a", b"b", b"c", b"a", b"b"]
    order, shared = suffix_array(ids, bounds, 3)
    ends = [int(bounds[np.searchsorted(bounds, i, side="right")]) for i in order]
    heads = [tuple(ids[i : min(i + 3, e)].tolist()) for i, e in zip(order, ends, strict=True)]
    assert heads == sorted(heads)
    for i in range(1, len(heads)):
        k = 0
        while k < min(len(heads[i]), len(heads[i - 1])) and heads[i][k] == heads[i - 1][k]:
            k += 1
        assert shared[i] == k
