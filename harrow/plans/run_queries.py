"""Registered queries of sessions, task states, task sets and fused rankings, with SQL twins.

They go through the operators themselves, over whole tables; where an input has to be
shaped (conversations as session events), the SQL starts from the table all the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import text as T
from harrow.operators import evaluation, index, lexical, paths, ranking, traces, validate
from harrow.plans import queries as engine
from harrow.plans.queries import CHUNKS_SQL, EARLIER_SQL, query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as session events: questions call a tool, answers are messages, an answer at the end ends the turn."""
    x = table(spark, sf_dir, "conversations")
    said = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))).alias("content"), F.struct(F.col("turn").alias("input"), F.length(F.coalesce("text", F.lit(""))).alias("output")).alias("usage")))
    asked = F.to_json(F.struct(F.concat(F.lit("mcp__tools__"), F.when(F.col("role") == "user", "ask").otherwise("set_up")).alias("name"), F.coalesce("text", F.lit("")).alias("arguments")))
    rows = x.select(F.col("conv_id").alias("session"), (2 * F.col("turn")).alias("ord"), F.when(F.col("role") == "assistant", "assistant/message").otherwise("tool/call").alias("type"), F.when(F.col("role") == "assistant", said).otherwise(asked).alias("data"))
    steps = x.filter("role = 'user'").select(F.col("conv_id").alias("session"), (2 * F.col("turn") - 1).alias("ord"), F.lit("step/start").alias("type"), F.lit("{}").alias("data"))
    last = x.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role")).filter("role = 'assistant'")
    ends = last.select(F.col("conv_id").alias("session"), (2 * F.col("turn") + 1).alias("ord"), F.lit("turn/end").alias("type"), F.lit('{"reason": {"kind": "stop"}}').alias("data"))
    return rows.unionByName(steps).unionByName(ends)


_FOLD_SQL = """
    c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    f AS (SELECT conv_id, count(*) FILTER (role = 'user') AS steps, count(*) FILTER (role <> 'assistant') AS n_calls,
                 coalesce(arg_max(text, turn) FILTER (role = 'assistant' AND text <> ''), '') AS final_text,
                 coalesce(sum(turn + length(text)) FILTER (role = 'assistant'), 0) AS total_tokens,
                 arg_max(role, turn) <> 'assistant' AS interrupted,
                 list(CASE WHEN role = 'user' THEN 'ask' ELSE 'set_up' END ORDER BY turn) FILTER (role <> 'assistant') AS names,
                 list(text ORDER BY turn) FILTER (role <> 'assistant') AS args FROM c GROUP BY conv_id)
"""


@query(f"WITH {_FOLD_SQL} SELECT conv_id AS session, steps, n_calls, sha256(final_text) AS final_text, CAST(total_tokens AS BIGINT) AS total_tokens, interrupted, sha256(array_to_string(args, chr(10))) AS arguments, names[1] AS first_tool FROM f")
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``traces.fold`` over all conversations."""
    x = traces.fold(_events(spark, sf_dir))
    args = F.array_join(F.transform("calls", lambda c: c["arguments"]), "\n")
    return x.select("session", "steps", F.size("calls").cast("long").alias("n_calls"), F.sha2("final_text", 256).alias("final_text"), F.col("total_tokens").cast("long").alias("total_tokens"), "interrupted", F.sha2(args, 256).alias("arguments"), F.get(F.transform("calls", lambda c: c["name"]), F.lit(0)).alias("first_tool"))


@query(f"""
    WITH {_FOLD_SQL}, n AS (SELECT *, coalesce(names, []) AS own FROM f)
    SELECT conv_id AS session, array_to_string(list_filter([
        CASE WHEN interrupted THEN 'turn_end' END,
        CASE WHEN len(list_filter(own, lambda x: x = 'ask')) < 2 THEN 'tools_called' END,
        CASE WHEN list_contains(own, 'set_up') THEN 'tools_not_called' END,
        CASE WHEN len(list_filter(list_zip(own, coalesce(args, [])), lambda z: z[1] = 'ask' AND contains(z[2], 'the'))) = 0 THEN 'tool_args_contains' END,
        CASE WHEN NOT contains(final_text, 'an') THEN 'output_contains' END,
        CASE WHEN NOT regexp_matches(final_text, '(?m)^[A-Z].*[.]$') THEN 'output_matches' END,
        CASE WHEN steps > 3 THEN 'max_steps' END,
        CASE WHEN total_tokens > 900 THEN 'max_tokens' END], lambda x: x IS NOT NULL), ' ') AS failures
    FROM n
""")
def session_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``traces.failures``: all conversations held to one case."""
    none = F.array().cast("array<string>")
    case = {
        "want_turn_end": F.lit("stop"), "tools_called": F.array(F.lit("ask"), F.lit("ask")), "tools_not_called": F.array(F.lit("set_up")),
        "tool_args_contains": F.create_map(F.lit("ask"), F.array(F.lit("the"))), "tool_result_contains": none, "output_contains": F.array(F.lit("an")),
        "output_matches": F.array(F.lit("^[A-Z].*[.]$")), "max_steps": F.lit(3), "max_tokens": F.lit(900), "no_tool_errors": F.lit(True),
    }
    x = traces.fold(_events(spark, sf_dir)).withColumns(case)
    return x.select("session", F.array_join(traces.failures(x), " ").alias("failures"))


@query("""
    WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'running' WHEN 'view' THEN 'running' WHEN 'click' THEN 'ready' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS state FROM events),
         r AS (SELECT user_id, min(event_id) FILTER (state = 'running') AS run, min(event_id) FILTER (state = 'cancelled') AS stop FROM e GROUP BY user_id),
         t AS (SELECT user_id, arg_min(state, event_id) AS ended FROM e JOIN r USING (user_id) WHERE event_id > run AND state <> 'running' GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS task, CASE WHEN stop < coalesce(run, stop + 1) THEN 'cancelled' WHEN run IS NULL THEN 'pending' ELSE coalesce(ended, 'running') END AS state FROM r LEFT JOIN t USING (user_id)
""")
def task_states_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``traces.task_states``: each user's events as the transitions of a task."""
    state = F.when(F.col("event_type").isin("signup", "view"), "running").when(F.col("event_type") == "click", "ready").when(F.col("event_type") == "error", "failed").otherwise("cancelled")
    return traces.task_states(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task"), F.col("event_id").alias("ord"), state.alias("state")))


@query("""
    WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'aeiou', '数据库连接'), '[一-鿿]+|[^一-鿿]+') AS runs FROM documents),
         p AS (SELECT doc_id, list_transform(runs, lambda x: CASE WHEN regexp_matches(x, '^[一-鿿]') AND len(x) > 1 THEN array_to_string(list_transform(range(1, len(x)), lambda i: substr(x, i, 2)), ' ') ELSE x END) AS p FROM t)
    SELECT doc_id, sha256(array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i > 1 AND NOT regexp_matches(p[i - 1], '\\s$') AND NOT regexp_matches(p[i], '^\\s') THEN ' ' ELSE '' END || p[i]), '')) AS bigrams FROM p
""")
def document_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams of every whole text; vowels stand in for ideographs, of which the texts have none."""
    x = table(spark, sf_dir, "documents")
    return x.select("doc_id", F.sha2(T.bigrams(F.translate(F.coalesce("text", F.lit("")), "aeiou", "数据库连接")), 256).alias("bigrams"))


#: Hits of each leg that are fused.
LEG = 50
_WORDS = "ention anble edes"
_ANY = len(lexical.rungs(_WORDS)) - 1
_TEST_TIER = f"CASE WHEN regexp_matches(path, '{paths.TEST_REGEX}') THEN 1 ELSE 0 END"


@query(f"""
    WITH c AS ({CHUNKS_SQL}), l AS ({engine._bm25_sql(lexical.rungs(_WORDS)[_ANY], LEG)}),
         q AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, CAST(list_transform(range(len(embedding)), lambda i: 0.1) AS DOUBLE[]) AS q FROM embeddings),
         s AS (SELECT chunk_id, path, {_TEST_TIER} AS tier, CASE WHEN list_inner_product(v, v) = 0 THEN 0 ELSE list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))) END AS score FROM q JOIN c USING (chunk_id)),
         v AS (SELECT chunk_id, row_number() OVER (ORDER BY tier, score DESC, chunk_id) AS rank FROM s QUALIFY rank <= {LEG}),
         f AS (SELECT chunk_id, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) AS rrf FROM l FULL JOIN v USING (chunk_id))
    SELECT CAST(row_number() OVER (ORDER BY {_TEST_TIER}, rrf DESC, path) AS INTEGER) AS rank, chunk_id, path, round(rrf, 6) AS rrf FROM f JOIN c USING (chunk_id) QUALIFY rank <= 12
""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits of BM25 and of cosine similarity, fused by their ranks."""
    x = engine.docs_as_chunks(spark, sf_dir).withColumn("seq", F.lit(0))
    found = lexical.search(*engine._index(spark, sf_dir), {"q": _WORDS}, LEG, only_rung=_ANY).select("chunk_id", "rank")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(x.select("chunk_id", "path"), "chunk_id")
    near = ranking.cosine_topk(vectors, [0.1] * 64, LEG, paths.test_tier(F.col("path")))
    legs = [x.join(F.broadcast(leg.select("chunk_id", "rank")), "chunk_id") for leg in (found, near)]  # LEG rows each
    return ranking.fused_topk(ranking.rrf(*legs), 12).select("rank", "chunk_id", "path", F.round("rrf", 6).alias("rrf"))


@query(f"""
    WITH o AS (SELECT path, sha256(text) AS h FROM ({EARLIER_SQL})), n AS (SELECT path, sha256(coalesce(text, '')) AS h FROM ({CHUNKS_SQL}))
    SELECT path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n USING (path)
""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``index.changes`` between two states of all documents, of other words and other paths."""
    return index.changes(*(engine._as_files(spark, sf_dir, earlier)[0] for earlier in (True, False)))


@query(f"""
    WITH b AS ({engine._results_sql()}), c AS ({engine._results_sql(1)})
    SELECT id, b.rank AS baseline_rank, c.rank AS current_rank,
           CASE WHEN b.hit AND NOT c.hit THEN 'regression' WHEN c.hit AND NOT b.hit THEN 'improvement' WHEN b.hit AND c.hit AND c.rank < b.rank THEN 'rank_improved'
                WHEN b.hit AND c.hit AND c.rank > b.rank THEN 'rank_regressed' ELSE 'unchanged' END AS change FROM b JOIN c USING (id)
""")
def run_diff_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``evaluation.diff_runs`` of two runs over the same tasks; only their outcomes differ."""
    return evaluation.diff_runs(engine._results(spark, sf_dir), engine._results(spark, sf_dir, 1)).select("id", "baseline_rank", "current_rank", "change")


_TASK_SQL = f"""
    c AS ({CHUNKS_SQL}), p AS (SELECT chunk_id, path, coalesce(text, '') AS text FROM c),
    t AS (SELECT 'L-' || CAST(item_id AS VARCHAR) AS id, CASE item_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'crossfile' ELSE 'natural' END AS class,
                 b.text || CASE WHEN item_id % 4 = 0 THEN ' ' || p.path ELSE '' END AS query, CASE WHEN item_id % 5 = 0 THEN '/' || p.path ELSE p.path END AS path FROM benchmark b JOIN p ON p.chunk_id = b.item_id),
    w AS (SELECT *, list_distinct(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS words FROM t),
    g AS (SELECT id, class, query, t.path, unnest(words) AS word, p.text FROM w t LEFT JOIN p USING (path)),
    x AS (SELECT id, query, unnest(list_distinct([ltrim(path, '/'), regexp_extract(path, '[^/]*$'), regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')])) AS piece FROM t),
    n AS (SELECT count(*) AS total, count(*) FILTER (class = 'exact') AS e, count(*) FILTER (class = 'crossfile') AS f, count(*) FILTER (class = 'natural') AS u FROM t)
"""


@query(f"""
    WITH {_TASK_SQL}
    SELECT 'path_format' AS "check", id, path || ': absolute' AS detail FROM t WHERE starts_with(path, '/')
    UNION ALL SELECT 'path_missing', id, path FROM t ANTI JOIN p USING (path)
    UNION ALL SELECT 'query_leak', id, piece FROM x WHERE length(piece) >= 4 AND contains(lower(query), lower(piece))
    UNION ALL SELECT 'exact_identifier', id, array_to_string(list_sort(words), ' ') FROM w WHERE class = 'exact' AND id NOT IN (SELECT id FROM g WHERE contains(text, word))
    UNION ALL SELECT DISTINCT 'natural_identifier', id, word FROM g WHERE class = 'natural' AND contains(text, word)
    UNION ALL SELECT 'ratio', NULL, 'exact: ' || e FROM n WHERE abs(e - total * 12 / 43) > 1
    UNION ALL SELECT 'ratio', NULL, 'crossfile: ' || f FROM n WHERE abs(f - total * 11 / 43) > 1
    UNION ALL SELECT 'ratio', NULL, 'natural: ' || u FROM n WHERE abs(u - total * 20 / 43) > 1
""")
def task_set_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``validate.violations`` of a task set made of benchmark texts, each expecting the document of its number."""
    texts = engine.docs_as_chunks(spark, sf_dir)
    x = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("asked")).join(texts.select("chunk_id", "path"), F.col("item_id") == F.col("chunk_id"))
    leaky = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit(" "), "path")).otherwise("")
    tasks = x.select(
        F.concat(F.lit("L-"), F.col("item_id").cast("string")).alias("id"),
        F.get(F.array(F.lit("exact"), F.lit("crossfile"), F.lit("natural")), (F.col("item_id") % 3).cast("int")).alias("class"),
        F.concat("asked", leaky).alias("query"),
        F.array(F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("/"), "path")).otherwise(F.col("path"))).alias("expect_paths"),
        F.array().cast("array<string>").alias("must_not_paths"), F.array().cast("array<string>").alias("expect_symbols"),
    )
    return validate.violations(tasks, texts)
