"""Phrases counted chunk by chunk: the rows of ``search``, and no shuffle before the ranks."""

import random

from harrow.functions import text as T
from harrow.operators import lexical

QUERIES = {"and": "w1 w2", "phrase": "a_b w3", "long": "a_b_a w4", "or": "w18 w19 nowhere", "symbol": "helper w4", "cjk": "数据库", "none": "nothing_here", "bare": "!!!", "twice": "w7 w7"}


def test_chunks_are_searched_without_postings(spark):
    r = random.Random(5)
    words = [*[f"w{i}" for i in range(20)], "a_b", "a", "b", "数据库", "É"]
    rows = [(i, T.py_bigrams(" ".join(r.choices(words, k=r.randint(0, 30)))), r.choice(["", "helper", "a_b"]), r.choice(["src/", "tests/"]) + f"w{i % 9}.py", i) for i in range(300)]
    made = spark.createDataFrame(rows, "chunk_id long, text_bigram string, symbol string, path string, start_line int")
    rounded = lambda hits: sorted((h.query_id, h.rung, h["rank"], h.chunk_id, h.path, h.start_line, round(h.bm25, 9), round(h.score, 9)) for h in hits.collect())
    found = lexical.search_chunks(made, QUERIES, 5)
    assert rounded(found) == rounded(lexical.search(lexical.postings(made), lexical.lengths(made), QUERIES, 5))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "collect_list" not in plan
    assert lexical.search_chunks(made, {"q": "!!!"}, 5).isEmpty() and lexical.search_chunks(made.limit(0), QUERIES, 5).isEmpty()
