"""The match language against SQLite's FTS5, and the pieces around it."""

import math
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from harrow.functions import text as T
from harrow.operators import lexical, paths, ranking

DOCS = [
    (1, "def connect(self): return self.authenticate()", "connect", "src/db/pool.py"),
    (2, "the connection pool, connected twice; foo_bar foo bar", "", "src/db/other.py"),
    (3, "std::vector<int> foo; the the the", "vector", "tests/test_pool.py"),
    (4, "Café déjà vu connect connect connect", "", "src/café.py"),
    (5, "数据库连接池 connect", "", "src/cjk.py"),
    (6, "Ωμέγα und straße 42 foo bar foo bar", "", "src/__tests__/x.py"),
    (7, "", "", "lib/empty.py"),
]
QUERIES = ["connect", "foo_bar", "self.authenticate", "the connect", "std::vector", "deja", "数据库", "foo !!! bar", "straße 42", "missing words foo"]


@pytest.fixture(scope="module")
def built(spark):
    found = spark.createDataFrame(DOCS, "chunk_id long, text string, symbol string, path string").withColumn("text_bigram", T.bigrams(F.col("text"))).withColumn("start_line", F.lit(1))
    return lexical.postings(found).cache(), lexical.lengths(found).cache()


def fts5(query, every):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text_bigram, symbol, path, chunk_id UNINDEXED, tokenize='unicode61')")
    con.executemany("INSERT INTO t VALUES (?,?,?,?)", [(T.py_bigrams(t), s, p, i) for i, t, s, p in DOCS])
    words = [w for w in T.py_bigrams(query).split() if T.py_tokens(w)]
    match = (" AND " if every else " OR ").join('"' + w.replace('"', '""') + '"' for w in words)
    return {i: b for i, b in con.execute("SELECT chunk_id, bm25(t) FROM t WHERE t MATCH ?", (match,))}


@pytest.mark.parametrize("query", QUERIES)
def test_bm25_equals_fts5(built, query):
    every = fts5(query, True)
    want, rung = (every, 0) if every else (fts5(query, False), None)
    got = lexical.search(*built, {"q": query}, 50, boost=False, only_rung=rung).collect()
    if rung is None:
        got = [g for g in got if g.chunk_id in want]
        assert {g.chunk_id for g in got} <= set(want)
        return
    assert {g.chunk_id: pytest.approx(g.bm25, abs=1e-12) for g in got} == want
    tier = lambda i: DOCS[i - 1][3].startswith("tests/") or "__tests__/" in DOCS[i - 1][3]
    assert [g.chunk_id for g in sorted(got, key=lambda g: g["rank"])] == sorted(want, key=lambda i: (tier(i), want[i], i))


def test_boost_scope_and_limit(built):
    hits = lexical.search(*built, {"q": "connect"}, 1).collect()
    assert [(h.chunk_id, h.rank if False else h["rank"]) for h in hits] == [(1, 1)]
    assert {h.chunk_id for h in lexical.search(*built, {"q": "connect"}, 9, scope="src/db").collect()} == {1}
    with pytest.raises(ValueError):
        lexical.search(*built, {"q": "a"}, 0)


def test_batch_runs_all_queries_in_one_plan(built):
    got = lexical.search(*built, {"a": "connect", "b": "foo_bar", "c": "!!!"}, 3).collect()
    assert {g.query_id for g in got} == {"a", "b"}


def test_rungs():
    assert lexical.rungs("...") == [] and lexical.rungs("") == []
    first, second, third = lexical.rungs("foo.bar baz 数据库")
    assert first.every and first.phrases == (("foo", "bar"), ("baz",), ("数据",), ("据库",))
    assert second.phrases == (("foo",), ("bar",), ("baz",)) and not third.every


@pytest.mark.parametrize("text", ["数据库", "a数据b", "连", "plain  two", "数据 库", ""])
def test_bigrams_agree_with_the_driver(spark, text):
    assert spark.range(1).select(T.bigrams(F.lit(text))).first()[0] == T.py_bigrams(text)


@pytest.mark.parametrize("path,tier", [("tests/a.py", 1), ("a/tests/b.py", 1), ("__tests__/x", 1), ("a/x.spec.ts", 1), ("a.test.js", 1), ("latest/a.py", 0), ("tests_helper.py", 0), ("contest.py", 0), ("spec.py", 0)])
def test_tiers_agree(spark, path, tier):
    row = spark.range(1).select(paths.test_tier(F.lit(path)), paths.is_test_path(F.lit(path)).cast("int")).first()
    assert tuple(row) == (tier, tier)


def test_scope():
    assert paths.resolve_scope("a/./b/../c") == "a/c" and paths.resolve_scope(".") is None
    for bad in ("../x", "/etc", "a/../../b"):
        with pytest.raises(ValueError):
            paths.resolve_scope(bad)


@pytest.mark.parametrize("path,secret", [(".env", True), ("a/.env.local", True), ("x.pem", True), ("id_rsa.pub", True), ("a/.ssh/config", True), ("environment.py", False), ("my_rsa", True), ("Credentials", False), ("credentials.json", True)])
def test_secret_paths(spark, path, secret):
    assert spark.range(1).select(paths.is_secret_path(F.lit(path))).first()[0] is secret


def test_secret_shapes(spark):
    key = "AK" + "IA" + "Q" * 16
    rows = spark.createDataFrame([(f"x {key}",), ("nothing",), ("-----BEGIN RSA PRIVATE " + "KEY-----",)], "t string")
    assert [r[0] for r in rows.select(paths.secret_shape(F.col("t"))).collect()] == ["aws_access_key", None, "private_key"]


def test_ignore_rules(spark):
    rules = paths.IgnoreRules("# c\n*.log\n!keep.log\n/build/\ndocs/**/x.md\ntmp/\na?c\n[bc]d\n")
    cases = {"a.log": True, "d/a.log": True, "keep.log": False, "build/x": True, "src/build/x": False, "docs/x.md": True, "docs/p/q/x.md": True, "u/tmp/f": True, "abc": True, "bd": True, "ad": False}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.i for r in df.select("p", rules.column(F.col("p")).alias("i")).collect()} == cases


def test_prefix_round_trip_and_mentions(spark):
    df = spark.createDataFrame([("p.py", 1, 2, "function", "f", "body\nmore"), ("q.py", 3, 3, None, None, "one")], "p string, s int, e int, k string, n string, t string")
    cols = [F.col(c) for c in "psekn"]
    full = df.select(T.context_prefix(*cols).alias("h"), T.strip_prefix(F.concat(T.context_prefix(*cols), F.lit("\n"), F.col("t"))).alias("b"), "t").collect()
    assert full[0].h == "// file: p.py  |  symbol: function f  |  lines 1-2" and full[1].h == "// file: q.py  |  lines 3-3"
    assert all(r.b == r.t for r in full)
    one = spark.range(1)
    yes = lambda t, w, i=True: one.select(T.mentions(F.lit(t), F.lit(w), i)).first()[0]
    assert yes("call Foo.bar()", "foo") and not yes("call Foo.bar()", "foo", False) and not yes("food", "foo") and yes("a.b(c", "b(c")


def test_cosine_rules(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0])], "chunk_id long, embedding array<double>")
    assert [r.chunk_id for r in ranking.cosine_topk(rows, [1.0, 1.0], 3).orderBy("rank").collect()] == [3, 4, 1]
    assert ranking.cosine_topk(rows, [0.0, 0.0], 3).count() == 0
    tier = F.when(F.col("chunk_id") == 3, 1).otherwise(0)
    assert [r.chunk_id for r in ranking.cosine_topk(rows, [1.0, 1.0], 2, tier).orderBy("rank").collect()] == [4, 1]
    bad = spark.createDataFrame([(1, [math.nan, 1.0])], "chunk_id long, embedding array<double>")
    with pytest.raises(Exception, match="not finite"):
        ranking.cosine_topk(bad, [1.0, 1.0], 1).collect()


def test_fusion_and_budget(spark):
    schema = "path string, seq int, rank int, start_line int, text string"
    a = spark.createDataFrame([("x", 0, 1, 5, "t" * 35), ("tests/y", 0, 2, 1, "t" * 35), ("z", 1, 3, 9, "t" * 350)], schema)
    b = spark.createDataFrame([("z", 1, 1, 9, "other"), ("w", 0, 2, 1, "t" * 7)], schema)
    fused = ranking.rrf(a, b)
    by = {(r.path, r.seq): r for r in fused.collect()}
    assert by["z", 1].rrf == pytest.approx(1 / 63 + 1 / 61) and by["z", 1].text == "t" * 350 and by["w", 0].rrf == pytest.approx(1 / 62)
    best = ranking.fused_topk(fused, 4)
    assert [r.path for r in best.orderBy("rank").collect()] == ["z", "x", "w", "tests/y"]
    # the first stays although it is too long; nothing after it fits
    assert [r.path for r in ranking.budget_prefix(best, 50, ["rank"]).collect()] == ["z"]
    assert [r.path for r in ranking.budget_prefix(best.filter("path != 'z'"), 12, ["rank"]).orderBy("rank").collect()] == ["x", "w"]


def test_phrase_is_not_across_columns(built):
    assert lexical.search(*built, {"q": "connect_src"}, 5, only_rung=0).count() == 0
    assert not re.search("x", "")
