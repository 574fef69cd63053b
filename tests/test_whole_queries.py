"""Registered queries over their whole input, against brute force."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from harrow.functions import text as T
from harrow.operators import lexical, ranking
from harrow.plans.queries import QUERIES

WORDS = "red green blue cyan lime teal navy plum rust sand"
TEXTS = [
    (1, WORDS, "en", "web"),
    (2, WORDS.replace("navy", "grey"), "en", "web"),
    (3, "red green blue cyan lime teal", "en", "web"),
    (4, "of the navy; don't go. don t don't " * 3, "de", "web"),
    (5, WORDS.replace("navy", "grey"), "en", "web"),
    (6, "plum " * 9 + "sand", "fr", "web"),
    (7, "red", "fr", "src1"),
    (8, "", "fr", "src1"),
    (9, "nothing here that counts for anything else", "fr", "src1"),
    (10, WORDS, "en", "web"),
]
ASKED = [(1, WORDS), (2, "red green blue cyan lime teal navy zinc"), (3, "go there now and then say don't go"), (4, "..."), (5, "plum a_b sand red web"), (6, "zinc only")]


def ladder(chunks, asked, k):
    """(query_id, rung, rank, chunk_id, score) by the definition."""
    columns = {i: [T.py_tokens(T.py_bigrams(t)), T.py_tokens(p)] for i, t, p in chunks}
    size = {i: sum(map(len, c)) for i, c in columns.items()}
    mean = sum(size.values()) / len(size)
    out = set()
    for query_id, text in asked:
        for no, rung in enumerate(lexical.rungs(text)):
            total, found = defaultdict(float), defaultdict(int)
            for p in rung.phrases:
                tf = {i: sum(tuple(c[a : a + len(p)]) == p for c in cs for a in range(len(c))) for i, cs in columns.items()}
                tf = {i: n for i, n in tf.items() if n}
                idf = math.log((len(size) - len(tf) + 0.5) / (len(tf) + 0.5))
                for i, n in tf.items():
                    total[i] += (idf if idf > 0 else lexical.LEAST_IDF) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[i] / mean))
                    found[i] += 1
            hits = [i for i in found if not rung.every or found[i] == len(rung.phrases)]
            if hits:
                path = {i: p for i, _, p in chunks}
                hits.sort(key=lambda i: ("tests/" in path[i] or "__tests__/" in path[i], round(-total[i], 9), i))
                out |= {(str(query_id), no, r, i, round(-total[i], 6)) for r, i in enumerate(hits[:k], 1)}
                break
    return out


def test_match_ladder_asks_whole_texts(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ASKED, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in QUERIES["match_ladder_batch"](spark, str(tmp_path)).select("query_id", "rung", "rank", "chunk_id", "score").collect()}
    head = lambda i: "tests/" if i % 5 == 0 else "src/__tests__/" if i % 7 == 0 else "src/"
    chunks = [(i, t, f"{head(i)}{source}/{lang}_{i}.txt") for i, t, lang, source in TEXTS]
    want = ladder(chunks, ASKED, 5)
    assert {(q, n, r, i): pytest.approx(s, abs=2e-6) for q, n, r, i, s in want} == {x[:4]: x[4] for x in got}
    # the seventh word tells the first document from the second
    assert {x[3] for x in got if x[0] == "1"} == {1, 10}


def test_search_many_is_search(spark):
    rows = [(1, "def connect(self): return self.authenticate()", "connect", "src/a.py"), (2, "connect twice; foo_bar foo bar", "", "src/b.py"), (3, "数据库连接池 connect", "foo", "tests/c.py"), (4, "", "", "d.py")]
    found = spark.createDataFrame(rows, "chunk_id long, text string, symbol string, path string").withColumn("text_bigram", T.bigrams(F.col("text"))).withColumn("start_line", F.lit(1))
    index = lexical.postings(found), lexical.lengths(found)
    asked = {"a": "connect", "b": "foo_bar zzz", "c": "!!!", "d": "数据库 nothing", "e": "self.authenticate connect", "f": "foo"}
    table = lambda df: sorted((*r[:6], round(r[6], 9), round(r[7], 9)) for r in df.collect())
    assert table(lexical.search_many(*index, asked, 3)) == table(lexical.search(*index, asked, 3))
    assert lexical.search_many(*index, {"c": "!!!"}, 3).count() == lexical.search_many(*index, {}, 3).count() == 0


def nearest(rows, asked, k):
    out = set()
    for query_id, q in asked:
        size = math.hypot(*q)
        if not size:
            continue
        score = {i: sum(a * b for a, b in zip(v, q)) / (math.hypot(*v) * size) if any(v) else 0.0 for i, v in rows}
        first = sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]
        out |= {(query_id, r, i, round(score[i], 6)) for r, i in enumerate(first, 1)}
    return out


def test_every_fiftieth_vector_asks(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(230)]
    rows[7] = rows[13] = (7, rows[100][1])
    rows[13] = (13, rows[100][1])
    rows[150] = (150, [0.0] * 8)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(x) for x in QUERIES["cosine_batch_whole"](spark, str(tmp_path)).collect()}
    want = nearest(rows, [x for x in rows if x[0] % 50 == 0], 5)
    assert {x[:3]: pytest.approx(x[3], abs=2e-6) for x in want} == {x[:3]: x[3] for x in got}
    assert {x[0] for x in got} == {0, 50, 100, 200} and {x[2] for x in got if x[0] == 100 and x[1] <= 3} == {7, 13, 100}


def test_cosine_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROW_BLOCK", 16)
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 8)
    r = random.Random(4)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(150)]
    odd = [(500, None), (501, [1.0, 2.0]), (502, [None, 1.0, 2.0])]
    frame = lambda x, names: spark.createDataFrame(x, f"{names[0]} long, {names[1]} array<double>")
    got = ranking.cosine_batch(frame(rows + odd, ("chunk_id", "embedding")), frame(rows[:40], ("query_id", "q")), 7)
    got = {(q, n, i): s for q, n, i, s in got.collect()}
    assert {x[:3]: pytest.approx(x[3], abs=2e-6) for x in nearest(rows, rows[:40], 7)} == got
    few = ranking.cosine_batch(frame(odd + rows[:1], ("chunk_id", "embedding")), frame([(9, [1.0, 1.0, 1.0])], ("query_id", "q")), 3)
    assert [(x.chunk_id, x.score is None) for x in few.orderBy("rank").collect()] == [(0, False), (500, True), (501, True)]
    with pytest.raises(Exception, match="not finite"):
        ranking.cosine_batch(frame([(1, [math.nan, 1.0])], ("chunk_id", "embedding")), frame([(9, [1.0, 1.0])], ("query_id", "q")), 3).collect()
