"""Segments against an index built at once: the same statistics and the same answers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from harrow.functions import text as T
from harrow.operators import lexical, segments
from harrow.operators.segments import SegmentIndex

WORDS = [f"w{i}" for i in range(60)] + ["Ünder", "数据库", "alpha_beta", "alpha", "beta", "x.y"]
FOUND = "path string, seq int, start_line int, end_line int, symbol_kind string, symbol_name string, text string, lang string, low_confidence boolean"
QUERIES = {"and": "w1 w2", "phrase": "alpha_beta w3", "or": "w50 w51 nowhere", "symbol": "helper w4", "cjk": "数据", "none": "nothing_here", "bare": "!!!", "one": "w7", "dots": "x.y"}


def corpus(seed, n=300):
    r = random.Random(seed)
    out = {}
    for i in range(n):
        folder = r.choice(["src", "tests", "lib/deep"])
        rows = []
        for seq in range(r.randint(1, 3)):
            body = " ".join(r.choice(WORDS[: r.choice([8, 30, len(WORDS)])]) for _ in range(r.randint(1, 60)))
            rows.append((f"{folder}/f{i}.py", seq, 1 + 10 * seq, 9 + 10 * seq, "function", r.choice([None, "helper", f"s{i}", "alpha_beta"]), body, "py", False))
        out[f"{folder}/f{i}.py"] = rows
    return out


def frames(spark, files):
    listed = [(p, len(rows), 0, str(hash(tuple(rows)))) for p, rows in files.items()]
    return spark.createDataFrame(listed, "path string, size long, mtime_ns long, content_hash string"), spark.createDataFrame([r for rows in files.values() for r in rows], FOUND)


def at_once(spark, files, queries, k, **options):
    """Ids by (path, seq), as a build at once numbers them."""
    rows = sorted(r for rows in files.values() for r in rows)
    made = spark.createDataFrame([(i + 1, T.py_bigrams(r[6]), r[5] or "", r[0], r[2]) for i, r in enumerate(rows)], "chunk_id long, text_bigram string, symbol string, path string, start_line int")
    hits = lexical.search(lexical.postings(made), lexical.lengths(made), queries, k, **options).collect()
    return sorted((r.query_id, r.rung, r["rank"], r.path, r.start_line, round(r.bm25, 9), round(r.score, 9)) for r in hits)


def found(index, queries, k, **options):
    rows, work = index.search(queries, k, **options)
    return sorted((r.query_id, r.rung, r["rank"], r.path, r.start_line, round(r.bm25, 9), round(r.score, 9)) for r in rows.collect()), work


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_updates_equal_a_build_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "RANGE_CHUNKS", 16)
    monkeypatch.setattr(segments, "CLASS_CHUNKS", 40)
    monkeypatch.setattr(segments, "LEAD_RANGES", 2)
    monkeypatch.setattr(segments, "MERGED", 3)
    index, files = SegmentIndex(spark, str(tmp_path / "store")), corpus(1, 120)
    assert index.manifest() is None
    index.update(*frames(spark, files))
    assert found(index, QUERIES, 5)[0] == at_once(spark, files, QUERIES, 5)
    r = random.Random(2)
    for step in range(2):
        paths = sorted(files)
        for p in r.sample(paths, 12):
            del files[p]
        for p in r.sample(sorted(files), 8):
            files[p] = [(*row[:6], row[6] + f" w{step} alpha_beta", *row[7:]) for row in files[p]]
        files |= {p.replace(".py", f"_{step}.py"): [(row[0].replace(".py", f"_{step}.py"), *row[1:]) for row in rows] for p, rows in corpus(10 + step, 15).items()}
        facts = index.update(*frames(spark, files))
        assert facts["changes"]["deleted"] == 12 and facts["changes"]["changed"] == 8 and facts["changes"]["new"] == 15
        assert facts["files"] == len(files) == index.files().count() and facts["chunks"] == sum(map(len, files.values())) == index.chunks().count()
    assert found(index, QUERIES, 5)[0] == at_once(spark, files, QUERIES, 5)
    index.update(*frames(spark, {p: [(*r[:6], r[6] + " w9", *r[7:])] for p, (r, *_) in files.items()}))
    files = {p: [(*r[:6], r[6] + " w9", *r[7:])] for p, (r, *_) in files.items()}
    assert len(index.segments()) == 1 and not index.manifest()["tombstones"]  # what was mostly dead is gone
    assert found(index, QUERIES, 4, scope="src", boost=False)[0] == at_once(spark, files, QUERIES, 4, scope="src", boost=False)
    plain = lexical.postings(index.chunks().select("chunk_id", T.bigrams(F.col("text")).alias("text_bigram"), F.coalesce("symbol_name", F.lit("")).alias("symbol"), "path", "start_line"))
    assert index.postings().exceptAll(plain.select("term", "chunk_id", "col", "pos")).isEmpty() and index.postings().count() == plain.count()
    assert {(r.term, r.df) for r in index.term_df().collect()} == {(r.term, r.df) for r in lexical.term_df(plain).collect()}
    n, mean = index.stats()
    want = lexical.corpus_stats(index.lengths()).first()
    assert n == want.n_docs and mean == pytest.approx(want.avgdl)
    assert index.vacuum() > 0 and found(index, QUERIES, 5)[0] == at_once(spark, files, QUERIES, 5)
    assert index.update(*frames(spark, files))["changes"] == {"new": 0, "changed": 0, "deleted": 0, "unchanged": len(files)}
    gone = index.update(frames(spark, files)[0].limit(0), frames(spark, files)[1].limit(0))
    assert gone["files"] == gone["chunks"] == 0 and found(index, QUERIES, 5)[0] == []


def test_one_changed_file_writes_little(spark, tmp_path):
    index, files = SegmentIndex(spark, str(tmp_path / "store")), corpus(3, 10_000)
    index.update(*frames(spark, files))
    before = size(tmp_path / "store")
    path = min(files)
    files[path] = [(*row[:6], row[6] + " freshly_changed", *row[7:]) for row in files[path]]
    index.update(*frames(spark, files))
    assert size(tmp_path / "store") - before < before / 100
    rows, _ = index.search({"q": "freshly_changed"})
    assert {r.path for r in rows.collect()} == {path}


def test_few_postings_are_scored(spark, tmp_path):
    """Words as frequent as in language: common ones are left out where the rare one does not reach."""
    r = random.Random(4)
    words, weight = [f"z{i}" for i in range(3000)], [1 / (i + 1) for i in range(3000)]
    files = {f"src/{i:05d}.py": [(f"src/{i:05d}.py", 0, 1, 2, None, None, " ".join(r.choices(words, weight, k=r.randint(5, 400))), "py", False)] for i in range(4000)}
    index = SegmentIndex(spark, str(tmp_path / "store"))
    index.update(*frames(spark, files))
    got, work = found(index, {"q": "z0 z2 z2500 nowhere"}, 5)
    assert got == at_once(spark, files, {"q": "z0 z2 z2500 nowhere"}, 5) and len(got) == 5
    assert work["postings"] > 6_000 and work["scored"] < work["postings"] / 4
