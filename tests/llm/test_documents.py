"""Exact dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from harrow.llm import vertical_join
from harrow.llm.chunk_recipes import dedup, dedup_report
from harrow.llm.components import components
from harrow.llm.vertical_join import first_grams, jaccard_components, one_of_each

SCHEMA = "doc_id long, text string, kept string, n long, label int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def corpus():
    r = random.Random(3)
    words = [f"w{i}ß" for i in range(300)]
    long = " ".join(r.choice(words) for _ in range(4000))
    rows = [(9, None), (8, ""), (7, " "), (6, "\t\n"), (5, long), (4, long.replace(" ", "\n ", 9)), (3, long + " "), (2, "q" * 200_000), (1, "q" * 200_000), (0, "q" * 199_999)]
    rows += [(20 + i, " ".join(r.choice(words[:3]) for _ in range(r.randint(0, 4)))) for i in range(60)]
    return [*rows, rows[4], rows[4], (None, long), (None, "alone")]


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(spark, bits):
    rows = corpus()
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (d, _), t in zip(rows, norm, strict=True):
        groups[t].append(d)
    got = dedup_report(frame(spark, rows), print_bits=bits).collect()
    low = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = sorted((str(d), str(low[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (d, _), t in zip(rows, norm, strict=True))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_kept_rows(spark):
    rows = corpus()
    out = dedup(frame(spark, rows)).collect()
    assert len(out) == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows}) and out[0].label == 2


def near_copies(seed):
    r = random.Random(seed)
    words = [f"W{i}É" for i in range(2000)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one two "), (7, "two one")]
    base = [r.choice(words) for _ in range(120)]
    for i in range(10, 100):
        t = list(base) if i < 60 else [r.choice(words) for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, " ".join(t)))
        if i >= 60:
            t[0] = "changed"
            rows.append((i + 200, " ".join(t)))
            rows.append((i + 400, " ".join(t[: len(t) - len(t) // 12])))
    return [*rows, rows[20], (None, rows[20][1])]


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = tuple((t or "").translate(lower).encode().split())
        sets.append({w[i : i + 3] for i in range(len(w) - 2)} if len(w) > 2 else {w} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 90 * (len(sets[a]) + len(sets[b]) - k):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join(spark, seed):
    rows = near_copies(seed)
    want = brute_components(rows)
    got = jaccard_components(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    if seed == 1:
        kept = one_of_each(frame(spark, rows)).collect()
        assert {str(r.doc_id) for r in kept} == {d for d, _, c in want if d == c}


@pytest.mark.parametrize("pieces", [300, 1 << 20])
def test_jaccard_join_in_small_pieces_and_many_fragments(spark, pieces, monkeypatch):
    monkeypatch.setattr(vertical_join, "FRAGMENT_TEXT", 1000)
    cut = vertical_join.kernels.pieces
    monkeypatch.setattr(vertical_join.kernels, "pieces", lambda texts: cut(texts, 100))
    r = random.Random(pieces)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(1, 60))]
        for _ in range(r.choice([1, 1, 2, 12])):
            t = list(base)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t)))
    batches = pa.record_batch({"doc_id": [d for d, _ in rows], "th": [0] * len(rows), "text": [t for _, t in rows]})
    monkeypatch.setattr(vertical_join, "PIECE_TEXT", pieces)
    monkeypatch.setattr(vertical_join.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))
    sent = [x for b in vertical_join._scan(3, 5)(iter([batches])) for x in b.to_pylist()]
    assert (len({x["piece"] for x in sent}) > 3) == (pieces == 300)
    told, schema = [], pa.schema({"piece": pa.int64(), "fragment": pa.int32(), "keys": pa.binary(), "who": pa.binary(), "known": pa.binary(), "docs": pa.binary()})
    for f in range(-1, 5):
        told += vertical_join._tell(pa.Table.from_pylist([x for x in sent if x["fragment"] == f], schema)).to_pylist()
    got = []
    for p in {x["piece"] for x in told}:
        got += vertical_join._gather(90, 100)(pa.Table.from_pylist([x for x in told if x["piece"] == p], pa.schema({k: schema.field(k).type for k in ("piece", "fragment", "keys", "who", "docs")}))).to_pylist()
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:])) or {t} for _, t in rows]
    of = {g: {frozenset(s) for s in sets if g in s} for s in sets for g in s}
    assert [x["doc_id"] for x in sorted(got, key=lambda x: x["doc_id"])] == list(range(len(rows)))
    for x in got:
        s = sets[x["doc_id"]]
        copies = sum(s == o for o in sets) if pieces == 300 else 1
        shared = sum(len(of[g]) > 1 for g in s)
        if x["keys"] is not None:
            assert len(x["keys"]) in ({shared} if copies == 1 else {shared, len(s)}) and len(s) - len(x["keys"]) < vertical_join.first_grams(len(s), 90, 100)
        elif copies == 1 and not any(s == sets[e] for e in range(x["doc_id"])):
            assert not shared or len(s) - shared >= vertical_join.first_grams(len(s), 90, 100)
    want = brute_components(rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(frame(spark, rows)).collect()) == want


@pytest.mark.parametrize("parts", [80, 90])
def test_near_sets_meet_in_a_list(parts):
    rng = np.random.default_rng(parts)
    for _ in range(4000):
        n = int(rng.integers(1, 12) if rng.random() < 0.5 else rng.integers(1, 400))
        a = rng.permutation(5000)[:n]
        keep = a[: n - int(rng.integers(0, max(1, n // 6) + 1))]
        b = np.concatenate([keep, 5000 + np.arange(int(rng.integers(0, max(1, n // 6) + 1)))])
        union = n + len(b) - len(keep)
        if len(b) and 100 * len(keep) >= parts * union:
            order = rng.permutation(len(a) + 5000 + len(b))
            rank = {int(g): k for k, g in enumerate(order)}
            x, y = sorted(a.tolist(), key=rank.__getitem__), sorted(b.tolist(), key=rank.__getitem__)
            meet = min(set(x) & set(y), key=rank.__getitem__)
            need = -(-parts * (len(x) + len(y)) // (100 + parts))
            for own in (x, y):
                assert own.index(meet) < first_grams(len(own), parts, 100) and len(own) - own.index(meet) >= need


def test_one_of_each_with_repeats_nulls_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(4, text, 1, 1, "a", 0), (4, text, 1, 1, "a", 0), (4, text, 1, 1, "a", 0), (5, text + " x", 1, 2, "b", 0), (4, text + " y", 2, 2, "c", 0)]
    rows += [(None, "only nulls here", 0, 0, "d", 0), (None, "only nulls here", 0, 0, "d", 0), (7, None, 0, 0, "e", 0), (7, None, 0, 0, "e", 0), (8, " ", 0, 0, "f", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _th int, label string, row int").repartition(3)
    out = one_of_each(docs, width=5, parts=80)
    assert out.columns == docs.columns
    assert sorted((r.label for r in out.collect())) in (["a", "d", "e", "e", "f"], ["c", "d", "e", "e", "f"])


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(label[n] == got.get(n, n) for n in label)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dedup_report(none).count() == dedup(none).count() == jaccard_components(none).count() == one_of_each(none).count() == 0
