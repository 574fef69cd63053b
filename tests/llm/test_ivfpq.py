import numpy as np

from harrow.llm import ivfpq
from harrow.llm.ivfpq import brute_force, exact, leading, search

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[100:900] = x[100]  # a crowded vector
    rows = [(i, v.tolist(), "s", 0) for i, v in enumerate(x)]
    odd = [(5000, None, "s", 0), (5020, [0.0] * 24, "s", 0), (5040, [float("nan")] * 24, "s", 0), (5060, [None] + [1.0] * 23, "s", 0), (5080, [1.0, 2.0], "s", 0), (None, [1.0] * 24, "s", 0), (5100, [float("inf")] + [0.0] * 23, "s", 0)]
    got = search(spark.createDataFrame(rows + odd, SCHEMA).repartition(4)).collect()
    want = brute_force(x, np.arange(3000), np.arange(0, 3000, 20), 20)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(want)
    hits = sum(len({v for v, _ in by[q]} & set(want[q])) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in by.items():
        assert len(found) == 20 and all(v != q for v, _ in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        for v, s in found:
            assert s == exact(x[q], x[v])
    # the copies of one vector all tie; the smallest ids win
    assert [v for v, _ in by[100]] == want[100]


def test_few_and_none(spark):
    few = [(0, [1.0, 0.0], "", 0), (1, [0.5, 0.5], "", 0), (20, [0.0, 1.0], "", 0)]
    got = search(spark.createDataFrame(few, SCHEMA)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_leading_prefers_first_places():
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (50, 40)).astype(np.float32) / 3
    x[:, 5] = -np.inf
    want = np.sort(np.argsort(-x, axis=1, kind="stable")[:, :11], axis=1)
    assert (np.sort(leading(x, 11), axis=1) == want).all()


def test_queries_in_blocks_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    key = lambda r: (r.query_id, r["rank"], r.vec_id, r.score)
    whole = sorted(map(key, ivfpq.search(frame, query_every=5).collect()))
    monkeypatch.setattr(ivfpq, "BLOCK_QUERIES", 16)
    assert sorted(map(key, ivfpq.search(frame, query_every=5).collect())) == whole and len(whole) == 240 * 20
