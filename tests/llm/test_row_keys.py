"""Rows whose ids repeat, or are null, and whose texts collide in 32 bits are different rows."""

import pytest
from pyspark.sql import functions as F

from harrow.llm.chunk_recipes import dedup, dedup_report
from harrow.llm.interval_tree import drop_repeated_bytes
from harrow.llm.phrase_automata import drop_repeated_phrases

PAIR = ("text number 160605", "text number 363441")


@pytest.fixture(scope="module")
def passages(spark):
    """Two texts of 61 words, over 400 bytes, whose 32-bit hashes are equal; they share no window."""
    body = " ".join(f"passage-{i}" for i in range(60))
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit(body + " "), "id")).otherwise(F.concat("id", F.lit(" " + body[::-1])))
    found = spark.range(600_000).groupBy(F.hash(text).alias("h")).agg(F.collect_list("id").alias("ids")).filter("exists(ids, i -> i % 2 = 0) AND exists(ids, i -> i % 2 = 1)").first()
    texts = {r.id % 2: r.text for r in spark.createDataFrame([(i,) for i in found.ids], "id long").select("id", text.alias("text")).collect()}
    return texts[0], texts[1]



def test_the_pair_collides(spark):
    a, b = spark.createDataFrame([(t,) for t in PAIR], "text string").select(F.hash("text").alias("h")).collect()
    assert a.h == b.h


def test_dedup_keeps_both(spark):
    frame = spark.createDataFrame([(None, PAIR[0]), (None, PAIR[1]), (5, "five"), (5, PAIR[0] + "!"), (5, "five")], "`a.b` long, text string")
    assert sorted(r.text for r in dedup(frame, "a.b").collect()) == sorted([*PAIR, "five", PAIR[0] + "!"])
    frame = spark.createDataFrame([(5, PAIR[0]), (5, PAIR[1])], "doc_id long, text string")
    assert len(dedup(frame).collect()) == 2 and all(r.kept for r in dedup_report(frame).collect())


@pytest.mark.parametrize("drop,total", [(drop_repeated_phrases, "n_words"), (drop_repeated_bytes, "n_bytes")])
def test_only_the_repeated_text_goes(spark, passages, drop, total):
    one, other = passages
    frame = spark.createDataFrame([(5, one), (5, other), (9, one)], "`a.b` long, `t.x` string")
    got = sorted((r[0], r[1], r["n_removed"]) for r in drop(frame, "a.b", "t.x").collect())
    size = 61 if total == "n_words" else len(one)
    assert (9, size, size) in got and [r for r in got if r[0] == 5 and r[2]] == [(5, size, size)] and sum(r[2] == 0 for r in got) == 1
