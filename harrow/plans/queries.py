"""Registered queries of the retrieval engine, each with its SQL twin.

``documents`` stands for chunks, ``embeddings`` for vectors, ``benchmark`` for
queries, ``labels`` for judgements, ``conversations`` and ``events`` for logs.
Every query runs over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions import text as T
from harrow.functions.vectors import cosine, norm
from harrow.operators import chunking, evaluation, index, lexical, paths, ranking, segments, traces
from harrow.plans.scratch import fresh_path
from harrow.plans.ship import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PATH_SQL = "CASE WHEN doc_id % 5 = 0 THEN 'tests/' WHEN doc_id % 7 = 0 THEN 'src/__tests__/' ELSE 'src/' END || source || '/' || lang || '_' || doc_id || '.txt'"
TOKENS_SQL = f"regexp_extract_all(lower(translate(regexp_replace(coalesce({{}}, ''), '[\\x{{{{0300}}}}-\\x{{{{036f}}}}]', '', 'g'), '{T.LATIN}', '{T.ASCII}')), '[\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{Co}}}}]+')"
CHUNKS_SQL = f"SELECT doc_id AS chunk_id, {PATH_SQL} AS path, '' AS symbol, 1 AS start_line, text, source, lang FROM documents"
TIER_SQL = "CASE WHEN " + " OR ".join(f"path ILIKE '{p}'" for p in paths.TEST_LIKE) + " THEN 1 ELSE 0 END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)  # before any Python function is planned
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 5 == 0, "tests/").when(F.col("doc_id") % 7 == 0, "src/__tests__/").otherwise("src/")
    path = F.concat(head, F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), path.alias("path"), F.lit("").alias("symbol"), F.lit(1).alias("start_line"), "text", "source", "lang")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = docs_as_chunks(spark, sf_dir).withColumn("text_bigram", T.bigrams(F.col("text")))
    return lexical.postings(found), lexical.lengths(found)


def _tokens_sql(x: str) -> str:
    return TOKENS_SQL.format(x).replace("{{", "{").replace("}}", "}")


def _tf_sql(phrase: tuple[str, ...], column: str) -> str:
    test = " AND ".join(f"{column}[i + {o}] = '{t}'" if o else f"{column}[i] = '{t}'" for o, t in enumerate(phrase))
    return f"len(list_filter(range(1, CAST(greatest(len({column}) - {len(phrase) - 1}, 0) AS BIGINT) + 1), lambda i: {test}))"


def _bm25_sql(rung: lexical.Rung, k: int, scope: str | None = None, ties: str = "chunk_id") -> str:
    n = len(rung.phrases)
    tf = ", ".join(f"{_tf_sql(p, 'tt')} + {_tf_sql(p, 'tp')} AS f{i}" for i, p in enumerate(rung.phrases))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(n))
    idf = [f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END" for i in range(n)]
    part = " + ".join(f"CASE WHEN f{i} > 0 THEN ({idf[i]}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a)) ELSE 0 END" for i in range(n))
    found = (" AND " if rung.every else " OR ").join(f"f{i} > 0" for i in range(n))
    scoped = f" AND (path = '{scope}' OR starts_with(path, '{scope}/'))" if scope else ""
    return f"""
        WITH c AS ({CHUNKS_SQL}), t AS (SELECT chunk_id, path, {_tokens_sql('text')} AS tt, {_tokens_sql('path')} AS tp FROM c),
             x AS (SELECT chunk_id, path, len(tt) + len(tp) AS dl, {tf} FROM t),
             s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS a, {df} FROM x),
             r AS (SELECT chunk_id, path, -({part}) AS bm25, {TIER_SQL} AS tier FROM x, s WHERE ({found}){scoped})
        SELECT CAST(row_number() OVER (ORDER BY tier, bm25, {ties}) AS INTEGER) AS rank, chunk_id, path, round(bm25, 6) AS bm25
        FROM r ORDER BY rank LIMIT {k}
    """


def _bm25(text: str, rung: int, k: int = 10, scope: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, n = _index(spark, sf_dir)
        hits = lexical.search(p, n, {"q": text}, k, scope, only_rung=min(rung, len(lexical.rungs(text)) - 1))
        return hits.select("rank", "chunk_id", "path", F.round("bm25", 6).alias("bm25"))

    return run


for _name, _text, _rung, _scope in (
    ("bm25_and_topk", "the of", 0, None),
    ("bm25_identifier_topk", "the, ention!", 1, None),
    ("bm25_or_topk", "ention anble edes", 2, None),
    ("bm25_phrase_topk", "of_the", 0, None),
    ("bm25_multicolumn_topk", "src3 de", 0, None),
    ("bm25_scoped_topk", "the of", 0, "src"),
):
    QUERIES[_name] = _bm25(_text, _rung, scope=_scope)
    _found = lexical.rungs(_text)
    ORACLES[_name] = _bm25_sql(_found[min(_rung, len(_found) - 1)], 10, _scope)


def _as_files(spark: SparkSession, sf_dir: str, earlier: bool) -> tuple[DataFrame, DataFrame]:
    """Documents as files and their chunks; ``earlier``, every seventh had other words and every eleventh another path."""
    rows = docs_as_chunks(spark, sf_dir).select("chunk_id", "path", F.coalesce("text", F.lit("")).alias("text"), "lang")
    if earlier:
        rows = rows.withColumn("text", F.when(F.col("chunk_id") % 7 == 0, F.concat(F.lit("earlier words "), "text")).otherwise(F.col("text")))
        rows = rows.withColumn("path", F.when(F.col("chunk_id") % 11 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")))
    files = rows.select("path", F.length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), F.sha2("text", 256).alias("content_hash"))
    none = F.lit(None).cast("string")
    return files, rows.select("path", F.lit(0).alias("seq"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), none.alias("symbol_kind"), none.alias("symbol_name"), "text", "lang", F.lit(False).alias("low_confidence"))


def _segments(spark: SparkSession, sf_dir: str, update: bool = True) -> segments.SegmentIndex:
    made = segments.SegmentIndex(spark, fresh_path(spark, "segments"))
    made.update(*_as_files(spark, sf_dir, update))
    if update:
        made.update(*_as_files(spark, sf_dir, False))
    return made


EARLIER_SQL = f"SELECT CASE WHEN chunk_id % 11 = 0 THEN 'old/' ELSE '' END || path AS path, CASE WHEN chunk_id % 7 = 0 THEN 'earlier words ' ELSE '' END || coalesce(text, '') AS text FROM ({CHUNKS_SQL})"


@query(f"""
    WITH c AS (SELECT 'earlier' AS state, path, text FROM ({EARLIER_SQL}) UNION ALL SELECT 'now', path, text FROM ({CHUNKS_SQL})),
         t AS (SELECT state, list_distinct(list_concat({_tokens_sql('text')}, {_tokens_sql('path')})) AS terms FROM c),
         p AS (SELECT state, unnest(terms) AS term FROM t)
    SELECT state, term, count(*) AS df FROM p GROUP BY state, term
""")
def segment_term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of an index before and after an update by segments and tombstones."""
    made = segments.SegmentIndex(spark, fresh_path(spark, "segments"))
    out = []
    for state in ("earlier", "now"):
        made.update(*_as_files(spark, sf_dir, state == "earlier"))
        out.append(made.term_df().select(F.lit(state).alias("state"), "term", "df"))
    return out[0].unionByName(out[1])


def _segment_bm25(text: str, rung: int, scope: str | None = None, k: int = 10) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The best of an index that was updated, with bounds of blocks deciding what is scored."""
        hits, _ = _segments(spark, sf_dir).search({"q": text}, k, scope, only_rung=min(rung, len(lexical.rungs(text)) - 1))
        return hits.select("rank", "path", F.round("bm25", 6).alias("bm25"))

    return run


for _name, _text, _rung, _scope in (
    ("segment_and_topk", "the of", 0, None),
    ("segment_or_topk", "ention anble edes", 2, None),
    ("segment_phrase_topk", "of_the", 0, None),
    ("segment_scoped_topk", "the of", 0, "src"),
):
    QUERIES[_name] = _segment_bm25(_text, _rung, _scope)
    _found = lexical.rungs(_text)
    ORACLES[_name] = "SELECT rank, path, bm25 FROM (" + _bm25_sql(_found[min(_rung, len(_found) - 1)], 10, _scope, "path") + ")"


@query()
def segment_ladder_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text, whole, as a query against stored segments: rung by rung, five hits each."""
    asked = {str(r["item_id"]): r["text"] for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()}
    hits, _ = _segments(spark, sf_dir, False).search(asked, 5)
    return hits.select("query_id", "rung", "rank", "path", F.round("score", 6).alias("score"))


@query(f"""
    WITH c AS ({CHUNKS_SQL}), t AS (SELECT chunk_id, {_tokens_sql('text')} AS tt, {_tokens_sql('path')} AS tp FROM c),
         p AS (SELECT chunk_id, unnest(tt) AS term FROM t UNION ALL SELECT chunk_id, unnest(tp) FROM t)
    SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM p GROUP BY term
""")
def term_document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_df(_index(spark, sf_dir)[0])


@query(f"""
    WITH c AS ({CHUNKS_SQL}), t AS (SELECT len({_tokens_sql('text')}) + len({_tokens_sql('path')}) AS dl FROM c)
    SELECT count(*) AS n_docs, round(avg(dl), 6) AS avgdl FROM t
""")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(_index(spark, sf_dir)[1]).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query()
def match_ladder_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text, whole, as a query, first rung that finds something, five hits each, one plan."""
    asked = {str(r["item_id"]): r["text"] for r in table(spark, sf_dir, "benchmark").collect()}
    found = docs_as_chunks(spark, sf_dir).withColumn("text_bigram", T.bigrams(F.col("text")))
    return lexical.search_chunks(found, asked, 5).select("query_id", "rung", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("SELECT CAST(i AS INTEGER) AS i, b AS bigrams FROM (VALUES (1, '数据 据库 连接'), (2, 'connect 数据 据库 pool'), (3, '连 a'), (4, 'plain text')) t(i, b)".replace("'数据 据库 连接'", "'数据 据库 库连 连接'"))
def cjk_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "数据库连接"), (2, "connect数据库pool"), (3, "连a"), (4, "plain text")], "i int, text string")
    return rows.select("i", T.bigrams(F.col("text")).alias("bigrams"))


@query(f"SELECT chunk_id, {TIER_SQL} AS like_tier, CASE WHEN regexp_matches(path, '{paths.TEST_REGEX}') THEN 1 ELSE 0 END AS regex_tier FROM ({CHUNKS_SQL})")
def test_path_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_as_chunks(spark, sf_dir).select("chunk_id", paths.test_tier(F.col("path")).alias("like_tier"), F.when(paths.is_test_path(F.col("path")), 1).otherwise(0).alias("regex_tier"))


@query(f"SELECT chunk_id, path FROM ({CHUNKS_SQL}) WHERE path = 'src/src1' OR starts_with(path, 'src/src1/')")
def path_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_as_chunks(spark, sf_dir).filter(paths.in_scope(F.col("path"), "src/src1")).select("chunk_id", "path")


_SECRET_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in paths.SECRET_SHAPES.items()) + " END"


@query(f"SELECT coalesce({_SECRET_SQL}, 'none') AS pattern, count(*) AS n FROM documents GROUP BY 1")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(paths.secret_shape(F.col("text")), F.lit("none")).alias("pattern")).agg(F.count("*").alias("n"))


@query(f"""
    WITH f AS (SELECT {PATH_SQL} AS path, strlen(text) AS size FROM documents),
         r AS (SELECT CASE WHEN path LIKE 'src/src4/%' THEN 'gitignored' WHEN size > 4000 THEN 'too_large' END AS reason FROM f)
    SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ROLLUP (reason)
""")
def skip_reason_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = docs_as_chunks(spark, sf_dir).select("path", F.octet_length("text").alias("size"))
    reason = paths.skip_reason(F.col("path"), F.col("size"), paths.IgnoreRules("src/src4/\n"), 4000, (".txt",))
    return paths.skip_counts(files.withColumn("reason", reason))


_LINES_SQL = f"lines AS (SELECT path, unnest(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) AS content, generate_subscripts(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)), 1) AS line FROM ({CHUNKS_SQL}))"


@query(f"""
    WITH {_LINES_SQL},
         m AS (SELECT path, line, trim(regexp_replace(content, '\\s', '', 'g')) = '' AS blank FROM lines),
         i AS (SELECT *, sum(CAST(blank AS INT)) OVER (PARTITION BY path ORDER BY line) AS run FROM m),
         w AS (SELECT *, (row_number() OVER (PARTITION BY path, run ORDER BY line) - 1) // 200 AS part FROM i WHERE NOT blank)
    SELECT path, CAST(min(line) AS INTEGER) AS start_line, CAST(max(line) AS INTEGER) AS end_line FROM w GROUP BY path, run, part
""")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paragraph_windows(chunking.text_lines(docs_as_chunks(spark, sf_dir)))


@query(f"""
    SELECT chunk_id, '// file: ' || path || '  |  symbol: text ' || lang || '  |  lines 1-9' AS prefix, text AS body,
           '── ' || path || ':1-9  [text ' || lang || ']  (chunk 0)' AS label, round(length(text) / 3.5, 6) AS tokens
    FROM ({CHUNKS_SQL})
""")
def prefixes_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, one, nine, zero = F.lit("text"), F.lit(1), F.lit(9), F.lit(0)
    x = docs_as_chunks(spark, sf_dir)
    prefix = T.context_prefix(F.col("path"), one, nine, kind, F.col("lang"))
    return x.select("chunk_id", prefix.alias("prefix"), T.strip_prefix(F.concat(prefix, F.lit("\n"), F.col("text"))).alias("body"), T.location_label(F.col("path"), one, nine, kind, F.col("lang"), zero).alias("label"), F.round(T.token_estimate(F.col("text")), 6).alias("tokens"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = docs_as_chunks(spark, sf_dir)
    old = x.filter("chunk_id % 11 != 0").select("path", F.sha2("text", 256).alias("content_hash"), "chunk_id")
    new = x.filter("chunk_id % 13 != 0").select("path", F.sha2(F.when(F.col("chunk_id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"), "chunk_id")
    return old, new


_SNAP_SQL = f"x AS ({CHUNKS_SQL}), o AS (SELECT path, sha256(text) AS h, chunk_id FROM x WHERE chunk_id % 11 <> 0), n AS (SELECT path, sha256(CASE WHEN chunk_id % 17 = 0 THEN text || '!' ELSE text END) AS h, chunk_id FROM x WHERE chunk_id % 13 <> 0)"


@query(f"WITH {_SNAP_SQL} SELECT path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n USING (path)")
def incremental_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.changes(*_snapshots(spark, sf_dir))


@query(f"""
    WITH {_SNAP_SQL}
    SELECT (SELECT count(*) FROM n) AS chunks, (SELECT count(*) FROM n JOIN o USING (chunk_id, h)) AS reusable,
           (SELECT count(*) FROM n ANTI JOIN o USING (chunk_id, h)) AS pending, (SELECT count(*) FROM o ANTI JOIN n USING (chunk_id, h)) AS stale
""")
def vector_reuse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return index.vector_status(new, old)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.when(F.col("vec_id") % 5 == 0, "tests/v").otherwise("src/v"), F.col("vec_id").cast("string")).alias("path"))


_QUERY_VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(map(str, _QUERY_VECTOR)) + "]::DOUBLE[]"
_COSINE_SQL = f"SELECT vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], {_VECTOR_SQL}) AS score, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS tier FROM embeddings"


@query(f"SELECT CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM ({_COSINE_SQL}) ORDER BY score DESC, chunk_id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cosine_topk(_vectors(spark, sf_dir), _QUERY_VECTOR, 10).select("rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY tier, score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM ({_COSINE_SQL}) ORDER BY tier, score DESC, chunk_id LIMIT 10")
def cosine_topk_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cosine_topk(_vectors(spark, sf_dir), _QUERY_VECTOR, 10, paths.test_tier(F.col("path"))).select("rank", "chunk_id", F.round("score", 6).alias("score"))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id < 5),
         s AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM embeddings, q),
         r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 5
""")
def cosine_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir)
    asked = x.filter("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    return ranking.cosine_batch(x, asked, 5).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
         s AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM embeddings, q),
         r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 5
""")
def cosine_batch_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``cosine_batch_topk``, asked by every row whose id divides by 50."""
    x = _vectors(spark, sf_dir)
    asked = x.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    return ranking.cosine_batch(x, asked, 5).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, 0.0::DOUBLE AS zero_row, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS row_norm FROM embeddings")
def zero_norm_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), 64)
    return table(spark, sf_dir, "embeddings").select("vec_id", cosine(zero, F.col("embedding")).alias("zero_row"), F.round(norm(F.col("embedding")), 6).alias("row_norm"))


def _two_rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = docs_as_chunks(spark, sf_dir).withColumn("seq", F.lit(0))
    a = x.orderBy(F.desc(F.length("text")), "chunk_id").limit(40)
    b = x.filter("lang = 'en'").orderBy(F.desc(F.length("text")), F.desc("chunk_id")).limit(40)
    rank = lambda df, *o: df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.length("text")), *o)))
    return rank(a, "chunk_id"), rank(b, F.desc("chunk_id"))


_FUSED_SQL = f"""
    x AS ({CHUNKS_SQL}), a AS (SELECT *, row_number() OVER (ORDER BY length(text) DESC, chunk_id) AS ra FROM x QUALIFY ra <= 40),
    b AS (SELECT *, row_number() OVER (ORDER BY length(text) DESC, chunk_id DESC) AS rb FROM x WHERE lang = 'en' QUALIFY rb <= 40),
    f AS (SELECT path, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(a.text, b.text) AS text, coalesce(1.0 / (60 + ra), 0) + coalesce(1.0 / (60 + rb), 0) AS rrf FROM a FULL JOIN b USING (path)),
    t AS (SELECT *, CASE WHEN regexp_matches(path, '{paths.TEST_REGEX}') THEN 1 ELSE 0 END AS tier FROM f),
    k AS (SELECT *, CAST(row_number() OVER (ORDER BY tier, rrf DESC, path) AS INTEGER) AS rank FROM t QUALIFY rank <= 12)
"""


@query(f"WITH {_FUSED_SQL} SELECT chunk_id, round(rrf, 6) AS rrf FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rrf(*_two_rankings(spark, sf_dir)).select("chunk_id", F.round("rrf", 6).alias("rrf"))


@query(f"WITH {_FUSED_SQL} SELECT rank, chunk_id, path, round(rrf, 6) AS rrf FROM k")
def fused_topk_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fused_topk(ranking.rrf(*_two_rankings(spark, sf_dir)), 12).select("rank", "chunk_id", "path", F.round("rrf", 6).alias("rrf"))


@query(f"""
    WITH {_FUSED_SQL}, b2 AS (SELECT *, sum(length(text) / 3.5) OVER (ORDER BY rank) AS used FROM k), kept AS (SELECT * FROM b2 WHERE rank = 1 OR used <= 30000)
    SELECT rank, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS shown, chunk_id FROM kept
""")
def budget_and_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.fused_topk(ranking.rrf(*_two_rankings(spark, sf_dir)), 12)
    kept = ranking.budget_prefix(best, 30000, ["rank"])
    return kept.select("rank", F.row_number().over(Window.orderBy("path", "start_line")).alias("shown"), "chunk_id")


def _results(spark: SparkSession, sf_dir: str, salt: int = 0) -> DataFrame:
    """Judged documents as evaluation results, by fixed arithmetic on their ids."""
    x = table(spark, sf_dir, "labels")
    turn = (F.col("doc_id") * 7 + salt * 3) % 13
    return x.select(
        F.col("doc_id").alias("id"),
        F.element_at(F.array(F.lit("exact"), F.lit("crossfile"), F.lit("natural")), (F.col("doc_id") % 3 + 1).cast("int")).alias("class"),
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query"),
        F.when(turn < 9, (turn + 1).cast("int")).alias("rank"),
        (turn < 9).alias("hit"),
        F.when(F.col("quality") == 1, True).otherwise(False).alias("symbol_hit"),
        F.array(F.lit("a"), F.lit("b"), F.when(F.col("toxic") == 1, "bad").otherwise("c")).alias("returned_paths"),
        F.array(F.lit("bad")).alias("must_not_hit"),
        (F.col("doc_id") % 4001).alias("token_estimate"),
        F.when(turn < 9, F.lit("a")).alias("matched_path"),
    )


def _results_sql(salt: int = 0) -> str:
    turn = f"((doc_id * 7 + {salt * 3}) % 13)"
    return f"SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'crossfile' ELSE 'natural' END AS class, CASE WHEN {turn} < 9 THEN {turn} + 1 END AS rank, {turn} < 9 AS hit, quality = 1 AS symbol_ok, toxic = 1 AS bad, doc_id % 4001 AS tokens FROM labels"


@query(f"""
    WITH r AS ({_results_sql()}), ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
         h AS (SELECT r.*, k, coalesce(rank <= k, false) AND symbol_ok AND NOT (bad AND k >= 3) AS ok FROM r, ks),
         b AS (SELECT coalesce(class, 'overall') AS bucket, k, count(*) AS total, sum(CAST(ok AS BIGINT))::BIGINT AS hits, median(tokens) AS med FROM h GROUP BY GROUPING SETS ((k), (class, k))),
         m AS (SELECT coalesce(class, 'overall') AS bucket, avg(CASE WHEN ok THEN 1.0 / rank ELSE 0 END) AS mrr FROM h WHERE k = 5 GROUP BY GROUPING SETS ((), (class))),
         w AS (SELECT *, hits / total AS p, 1.959963984540054 AS z FROM b JOIN m USING (bucket))
    SELECT bucket, CAST(k AS INTEGER) AS k, total, hits, round(p, 6) AS success,
           round(CASE WHEN hits = 0 THEN 0 ELSE greatest((p + z*z/(2*total)) / (1 + z*z/total) - z / (1 + z*z/total) * sqrt(p*(1-p)/total + z*z/(4*total*total)), 0) END, 6) AS low,
           round(CASE WHEN hits = total THEN 1 ELSE least((p + z*z/(2*total)) / (1 + z*z/total) + z / (1 + z*z/total) * sqrt(p*(1-p)/total + z*z/(4*total*total)), 1) END, 6) AS high,
           round(mrr, 6) AS mrr, med AS median_tokens
    FROM w
""")
def layered_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = evaluation.layered_metrics(_results(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return x.select("bucket", "k", "total", "hits", r("success"), r("low"), r("high"), r("mrr"), "median_tokens")


@query("""
    WITH g AS (SELECT lang, count(*) AS total, sum(quality)::BIGINT AS hits FROM documents JOIN labels USING (doc_id) GROUP BY lang), w AS (SELECT *, hits / total AS p, 1.959963984540054 AS z FROM g)
    SELECT lang, total, hits, round(CASE WHEN hits = 0 THEN 0 ELSE greatest((p + z*z/(2*total)) / (1 + z*z/total) - z / (1 + z*z/total) * sqrt(p*(1-p)/total + z*z/(4*total*total)), 0) END, 6) AS low,
           round(CASE WHEN hits = total THEN 1 ELSE least((p + z*z/(2*total)) / (1 + z*z/total) + z / (1 + z*z/total) * sqrt(p*(1-p)/total + z*z/(4*total*total)), 1) END, 6) AS high FROM w
""")
def wilson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("total"), F.sum("quality").alias("hits"))
    low, high = evaluation.wilson(F.col("hits"), F.col("total"))
    return x.select("lang", "total", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.diff_runs(_results(spark, sf_dir).filter("id % 10 != 0"), _results(spark, sf_dir, 1).filter("id % 9 != 0"))


_DIFF_SQL = f"""
    b AS (SELECT * FROM ({_results_sql()}) WHERE id % 10 <> 0), c AS (SELECT * FROM ({_results_sql(1)}) WHERE id % 9 <> 0),
    d AS (SELECT id, b.class AS class, b.hit AS bh, c.hit AS ch, b.rank AS br, c.rank AS cr,
                 CASE WHEN b.hit AND NOT c.hit THEN 'regression' WHEN c.hit AND NOT b.hit THEN 'improvement' WHEN b.hit AND c.hit AND c.rank < b.rank THEN 'rank_improved'
                      WHEN b.hit AND c.hit AND c.rank > b.rank THEN 'rank_regressed' ELSE 'unchanged' END AS change FROM b JOIN c USING (id))
"""


@query(f"WITH {_DIFF_SQL} SELECT id, change FROM d")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).select("id", "change")


@query(f"WITH {_DIFF_SQL} SELECT " + ", ".join(f"count(*) FILTER (change = '{c}') AS {c}" for c in evaluation.CHANGES) + " FROM d")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.change_counts(_diff(spark, sf_dir))


@query(f"""
    WITH {_DIFF_SQL}, g AS (SELECT coalesce(class, 'overall') AS bucket, count(*) AS total, avg(CAST(bh AS INT)) AS b, avg(CAST(ch AS INT)) AS c FROM d GROUP BY GROUPING SETS ((), (class)))
    SELECT bucket, total, round(b, 6) AS baseline, round(c, 6) AS current, round(c - b, 6) AS delta FROM g
""")
def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = evaluation.hit_rates(_diff(spark, sf_dir))
    return x.select("bucket", "total", *[F.round(c, 6).alias(c) for c in ("baseline", "current", "delta")])


@query(f"WITH {_DIFF_SQL} SELECT id, 'baseline' AS side FROM b ANTI JOIN c USING (id) UNION ALL SELECT id, 'current' FROM c ANTI JOIN b USING (id)")
def only_in_one_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _results(spark, sf_dir).filter("id % 10 != 0"), _results(spark, sf_dir, 1).filter("id % 9 != 0")
    return evaluation.only_in(a, b).withColumn("side", F.lit("baseline")).unionByName(evaluation.only_in(b, a).withColumn("side", F.lit("current")))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, some = F.col("doc_id"), lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.element_at(F.array(F.lit("exact"), F.lit("crossfile"), F.lit("natural")), (d % 3 + 1).cast("int")).alias("class"),
        some(d % 11 == 0).alias("must_not_hits"), F.when(d % 7 == 0, 3).alias("probe_rank"), (d % 5 == 0).alias("symbol_missing"), some(d % 4 != 0).alias("indexed_paths"),
        (d % 23).alias("index_file_count"), some(d % 8 == 0).alias("missing_paths"), some(F.lit(False)).alias("non_code_paths"), some(d % 6 != 1).alias("tokens_present"), some(d % 9 < 4).alias("tokens_missing"),
    )


_CODES_SQL = """
    e AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'crossfile' ELSE 'natural' END AS class,
          CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 OR (doc_id % 5 = 0 AND doc_id % 4 <> 0) THEN 'A4' WHEN doc_id % 23 = 0 THEN 'A6'
               WHEN doc_id % 4 = 0 AND doc_id % 8 = 0 THEN 'A7' WHEN doc_id % 4 = 0 THEN 'A2' WHEN doc_id % 6 = 1 AND doc_id % 9 >= 4 THEN 'A1'
               WHEN doc_id % 6 = 1 THEN 'A5' WHEN doc_id % 9 < 4 THEN 'A1' ELSE 'A3' END AS code FROM labels)
"""


@query(f"WITH {_CODES_SQL} SELECT doc_id, code FROM e")
def attribution_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("doc_id", evaluation.attribution_code().alias("code"))


@query(f"WITH {_CODES_SQL} SELECT CASE WHEN grouping(class) = 1 THEN 'overall' ELSE class END AS bucket, code, count(*) AS n FROM e GROUP BY GROUPING SETS ((code), (class, code))")
def attribution_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.attribution_distribution(_evidence(spark, sf_dir).withColumn("code", evaluation.attribution_code()))


@query(f"WITH {_CODES_SQL} SELECT round(avg(CASE WHEN code = 'A5' THEN 1.0 ELSE 0 END), 6) AS share FROM e WHERE class = 'natural'")
def natural_a5_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.natural_a5_share(_evidence(spark, sf_dir).withColumn("code", evaluation.attribution_code())).select(F.round("share", 6).alias("share"))


@query("""
    SELECT conv_id, count(*) FILTER (role = 'user') AS steps, coalesce(max_by(text, turn) FILTER (role = 'assistant'), '') AS final_text,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS chars FROM conversations GROUP BY conv_id
""")
def conversation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda r: F.col("role") == r
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.when(is_("user"), 1)).alias("steps"), F.coalesce(F.max_by("text", F.when(is_("assistant"), F.col("turn"))), F.lit("")).alias("final_text"), F.sum(F.when(is_("assistant"), F.length("text")).otherwise(0)).alias("chars"))


@query("""
    WITH s AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id)
    SELECT conv_id, len(list_filter(roles, lambda r: r = 'user')) > 0 AND list_position(roles, 'user') IS NOT NULL
           AND list_position(roles[list_position(roles, 'user') + 1:], 'assistant') IS NOT NULL AS answered FROM s
""")
def tool_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    x = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles.alias("roles"))
    return x.select("conv_id", traces.is_subsequence(F.col("roles"), F.array(F.lit("user"), F.lit("assistant"))).alias("answered"))


@query("""
    WITH g AS (SELECT source, count(*) AS trials, sum(quality)::BIGINT AS successes FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, trials, successes,
           round(CASE WHEN trials >= 3 THEN 1 - CASE WHEN trials - successes < 3 THEN 0 ELSE ((trials - successes) / trials) * ((trials - successes - 1) / (trials - 1)) * ((trials - successes - 2) / (trials - 2)) END END, 6) AS pass_at_3,
           round(CASE WHEN trials >= 3 THEN CASE WHEN successes < 3 THEN 0 ELSE (successes / trials) * ((successes - 1) / (trials - 1)) * ((successes - 2) / (trials - 2)) END END, 6) AS pass_hat_3
    FROM g
""")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("trials"), F.sum("quality").alias("successes"))
    c, n = F.col("successes"), F.col("trials")
    return x.select("source", "trials", "successes", F.round(evaluation.pass_at_k(c, n, 3), 6).alias("pass_at_3"), F.round(evaluation.pass_hat_k(c, n, 3), 6).alias("pass_hat_3"))


@query("""
    WITH x AS (SELECT source, quality, toxic FROM documents JOIN labels USING (doc_id)), g AS (SELECT source AS c, count(*) AS t, sum(quality) AS a, sum(1 - toxic) AS b FROM x GROUP BY source)
    SELECT count(*) AS cases, round(sum(a) / sum(t), 6) AS baseline, round(sum(b) / sum(t), 6) AS current, round(sum(b) / sum(t) - sum(a) / sum(t), 6) AS gain,
           count(*) FILTER (b < a) AS worse, sum(b) / sum(t) - sum(a) / sum(t) >= 0.1 AS met FROM g
""")
def ab_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("source").alias("case")).agg(F.count("*").alias("trials"), F.sum("quality").alias("q"), F.sum(1 - F.col("toxic")).alias("n"))
    arm = lambda c: x.select("case", "trials", F.col(c).alias("successes"))
    r = lambda c: F.round(c, 6).alias(c)
    return evaluation.ab_gate(arm("q"), arm("n")).select("cases", r("baseline"), r("current"), r("gain"), F.size("regressions").cast("long").alias("worse"), "met")


@query("""
    WITH o AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 1800000000 AS fresh FROM events),
         s AS (SELECT user_id, ts, sum(CAST(coalesce(fresh, false) AS INT)) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session FROM o)
    SELECT user_id, session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, session
""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = traces.sessions(table(spark, sf_dir, "events"), 1800)
    return x.select("user_id", "session", F.unix_micros(F.col("start_ts").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end_ts").cast("timestamp")).alias("end_us"), "n")


@query("SELECT user_id, arg_max(event_type, event_id) AS state, count(*) AS n FROM events GROUP BY user_id")
def task_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(url, '^.+(\\.[^./]+)$', 1) AS last_suffix, trim(regexp_replace(html, '\\s+', ' ', 'g'), ' ') AS one_line FROM pages")
def page_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^.+(\.[^./]+)$", 1).alias("last_suffix"), T.one_line(F.col("html")).alias("one_line"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the chunker."""
    from harrow.plans.ship import ship

    ship(spark)
    return chunking.chunks(docs_as_chunks(spark, sf_dir)).drop("text")


@query(f"""
    WITH c AS ({CHUNKS_SQL}), q AS (SELECT item_id, text AS q FROM benchmark), t AS (SELECT item_id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(q, '\\s+'),
         lambda w: regexp_replace(w, '^[^0-9A-Za-z_\\x{{4e00}}-\\x{{9fff}}]+|[^0-9A-Za-z_\\x{{4e00}}-\\x{{9fff}}]+$', '', 'g')), lambda w: w <> ''))) AS token FROM q)
    SELECT item_id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM t GROUP BY item_id
""")
def query_edge_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.edge_tokens(F.col("text"))).alias("token"))
    return x.groupBy("item_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("token").alias("n_distinct"))
