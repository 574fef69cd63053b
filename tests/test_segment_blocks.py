"""Blocks are written by the tasks that make them: in order of terms, with the tokens that Spark cuts."""

import pathlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from harrow.functions.text import tokens
from harrow.operators import segments

ODD = ["", " ", "a", "A1_b-C", "Éa ßx straße ÑandÚ", "é", "x²y ¼ ªº µm", "end é", "é start", "İstanbul ŉx ſt Ÿ", "tab\tnl\nnul\x00z", "no—dash", "数据库 and é", "naïve×÷ ÆæØø", "ƀȺ", "Ωmega 中", "últimas páginas"]


def test_words_of_a_sweep_equal_spark(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, *[a + b for a in ODD[1:9] for b in ODD[1:9]]])], "id int, text string")
    want = {r.id: (r.text, r.words) for r in rows.select("id", "text", tokens(F.col("text")).alias("words")).collect()}
    plain = [i for i, (t, _) in want.items() if all(ord(c) < 0x180 for c in t)]
    # a slice, so that offsets do not begin at 0
    row, words = segments._latin_words(pa.array(["before é", *[want[i][0] for i in plain]])[1:])
    got = {i: [] for i in plain}
    for r, w in zip(row.tolist(), words.to_pylist()):
        got[plain[r]].append(w)
    assert got == {i: want[i][1] for i in plain} and len(plain) > 60


def test_blocks_are_written_without_a_shuffle(spark, tmp_path):
    texts = [" ".join(f"w{(i * 7 + j * j) % 97}" for j in range(40)) + " " + ODD[i % len(ODD)] for i in range(600)]
    files = spark.createDataFrame([(f"src/{i}.py", len(t), 0, str(i)) for i, t in enumerate(texts)], "path string, size long, mtime_ns long, content_hash string")
    found = spark.createDataFrame([(f"src/{i}.py", 0, 1, 1, None, None, t, "py", False) for i, t in enumerate(texts)], "path string, seq int, start_line int, end_line int, symbol_kind string, symbol_name string, text string, lang string, low_confidence boolean")
    index = segments.SegmentIndex(spark, str(tmp_path / "store"))
    facts = index.update(files, found)
    parts = list(pathlib.Path(tmp_path, "store", facts["segments"][0]["name"], "blocks").glob("*.parquet"))
    assert parts  # no folders of hashed terms
    for part in parts:
        rows = pq.read_table(part, columns=["term", "range"]).to_pylist()
        keys = [(r["term"].encode(), r["range"]) for r in rows]
        assert keys == sorted(keys)
    assert index.postings().count() == facts["segments"][0]["tokens"] == index.lengths().agg(F.sum("dl")).first()[0]


def test_a_run_has_one_row_for_a_term(spark, tmp_path):
    texts = [" ".join(f"w{(i * 7 + j * j) % 97}" for j in range(40)) for i in range(600)]
    files = spark.createDataFrame([(f"src/{i}.py", len(t), 0, str(i)) for i, t in enumerate(texts)], "path string, size long, mtime_ns long, content_hash string")
    found = spark.createDataFrame([(f"src/{i}.py", 0, 1, 1, None, None, t, "py", False) for i, t in enumerate(texts)], "path string, seq int, start_line int, end_line int, symbol_kind string, symbol_name string, text string, lang string, low_confidence boolean")
    index = segments.SegmentIndex(spark, str(tmp_path / "store"))
    made = segments.Segment(**index.update(files, found)["segments"][0])
    stored = index._of("blocks", segments._GROUPS, [made])
    blocks = segments._opened(stored, ["term"], True)
    assert blocks.count() == made.headers == blocks.select("term", "range").distinct().count() > 1.5 * stored.count()
    said = segments._unpacked(blocks, ["term", "range"]).groupBy("term", "range").agg(F.count("*").alias("c"), F.sum("tf").alias("t"), F.max("tf").alias("m"), F.min("dl").alias("d")).join(blocks, ["term", "range"])
    assert said.filter("c != n OR t != tokens OR m != max_tf OR d != min_dl").isEmpty() and said.count() == made.headers


def test_paths_are_picked_by_hash_or_not(spark, monkeypatch):
    rows = spark.createDataFrame([(f"p{i}", "x") for i in range(50)] + [(None, "x")], "path string, text string")
    paths = spark.createDataFrame([(f"p{i}",) for i in range(40, 60)], "path string")
    want = [f"p{i}" for i in range(40, 50)]
    assert sorted(r.path for r in segments._of_paths(rows, paths, 20).collect()) == want
    plan = segments._of_paths(rows, paths, 20)._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" in plan
    monkeypatch.setattr(segments, "HASHED_PATHS", 1)
    assert sorted(r.path for r in segments._of_paths(rows, paths, 20).collect()) == want


def test_first_build_compares_nothing_and_starts_no_python_for_empty_tables(spark, tmp_path, monkeypatch):
    """An empty index has no files to compare with, and its missing tables are made without lists of rows."""
    from harrow.operators import index

    files = spark.createDataFrame([("a.txt", 1, 0, "x"), ("b.txt", 1, 0, "y")], "path string, size long, mtime_ns long, content_hash string")
    found = spark.createDataFrame([(p, 0, 1, 1, None, None, t, "en", False) for p, t in (("a.txt", "one two"), ("b.txt", "two é"))], ", ".join(c for c in segments.CHUNKS.split(", ") if not c.startswith(("chunk_id", "content_hash"))))

    def refuse(*_):
        raise AssertionError("not needed")

    made = segments.SegmentIndex(spark, str(tmp_path / "store"))
    with monkeypatch.context() as m:
        m.setattr(index, "changes", refuse)
        m.setattr(type(spark), "createDataFrame", refuse)
        done = made.update(files, found)["changes"]
        got = {(r.term, r.df) for r in made.term_df().collect()}
    assert done == {"new": 2, "changed": 0, "deleted": 0, "unchanged": 0}
    assert got == {("one", 1), ("two", 2), ("e", 1), ("a", 1), ("b", 1), ("txt", 2)}
    assert made.update(files.limit(0), found)["changes"]["deleted"] == 2
    assert made.term_df().isEmpty()


def test_order_is_stable():
    numbers = np.random.default_rng(3).integers(0, 50, 10_000)
    want = np.argsort(numbers, kind="stable").tolist()
    assert segments._order(numbers, 50).tolist() == want == segments._order(numbers, 1 << 60).tolist()
