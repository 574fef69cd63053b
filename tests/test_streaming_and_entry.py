import duckdb
import pytest

from harrow.plans.queries import ORACLES, QUERIES
from harrow.streaming.flows import session_stream, upsert_files

SF = "/root/testdata/sf0.001"


def test_upsert_adds_each_version_once(spark, tmp_path):
    source, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), "path string, content_hash string"
    spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], schema).write.parquet(source)
    upsert_files(spark, source, schema, target, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("a", "2"), ("b", "1")], schema).write.mode("append").parquet(source)
    upsert_files(spark, source, schema, target, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [("a", "1"), ("a", "2"), ("b", "1")]


def test_session_stream(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS user_id, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,x,0) AS ts FROM VALUES (0),(10),(100),(1000) t(x)")
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    q = session_stream(stream).writeStream.outputMode("append").format("memory").queryName("sess").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("sess").collect())[-1] == 2


def _same(x):
    return round(float(x), 6) + 0.0 if x.__class__.__name__ in ("float", "Decimal") else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted([tuple(_same(r[c]) for c in cols) for r in got.collect()], key=str)
    assert rows == sorted([tuple(_same(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()], key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
