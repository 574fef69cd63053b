"""Links whose ids collide in 32 bits, and queries whose probed lists hold too few rows."""

import numpy as np
from pyspark.sql import functions as F

from harrow.llm import ivfpq, vertical_join


def test_colliding_ids_are_two_documents(spark, monkeypatch):
    a, b = 16_000, 8_590_124_765
    assert spark.range(1).select(F.hash(F.lit(a).cast("long")) == F.hash(F.lit(b).cast("long"))).first()[0]
    monkeypatch.setattr(vertical_join.F, "monotonically_increasing_id", lambda: F.when(F.col("doc_id") == 1, F.lit(a)).otherwise(F.lit(b)).cast("long"))
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "tail"]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in vertical_join.jaccard_components(docs).collect()} == {1: 1, 2: 1}


def test_short_lists_are_topped_up(spark, monkeypatch):
    centres = np.array([[1, 0], [0, 1], [-1, 0]], np.float32)
    monkeypatch.setattr(ivfpq, "fit", lambda sample, total, k: ivfpq.Index(centres, np.zeros((2, 1, 1), np.float32), 1))
    rows = [(0, [0.0, 3.0]), (1, [0.0, 2.0]), (2, [0.1, 2.0]), (20, [-4.0, 0.1]), (20, [-4.0, 0.2]), *((100 + i, [1.0 + i / 50, 0.1]) for i in range(30))]
    got = ivfpq.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == {0, 20, 100, 120} and all(len(v) == 20 and q not in v for q, v in found.items())
    assert found[0][:2] == [1, 2]
