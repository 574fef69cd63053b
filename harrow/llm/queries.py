"""Queries of this subpackage over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harrow.llm import chunk_recipes, id_store, interval_tree, ivfpq, matching_pack, minmax_dedup, ngram_resampling, pareto_mix, phrase_automata, rff_quality, toxicity, vertical_join, yinyang_codes
from harrow.plans.ship import ship

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The public vocabulary that packing and id files are asked to use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)  # before any Python function is planned
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.drop_repeated_phrases(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching_pack.pack(_documents(spark, sf_dir), tokenizer_path())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_tree.drop_repeated_bytes(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix_report(_documents(spark, sf_dir))


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_store.read_ids(spark, id_store.write_ids(_documents(spark, sf_dir), tokenizer_path()))


def op6_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(_table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recipes.dedup_report(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertical_join.jaccard_components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return rff_quality.score(docs, rff_quality.learn(docs, _table(spark, sf_dir, "labels")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_resampling.resample(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(_documents(spark, sf_dir), width=4)


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pareto_mix": op4_pareto_mix,
    "op5_token_id_files": op5_token_id_files,
    "op6_ivfpq_search": op6_ivfpq_search,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality": op10_quality,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_yinyang_codes": op12_yinyang_codes,
    "op13_minmax_dedup": op13_minmax_dedup,
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LETTERS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _lloyd_sql(rounds: int) -> str:
    """Plain Lloyd rounds as common tables: distances, nearest entries (a), means (m), codebooks (c)."""
    out = []
    for k in range(rounds + 1):
        distance = "list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x)"
        out.append(f"a{k} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := {distance}, e := e)) AS near FROM p JOIN c{k} c USING (part) GROUP BY r, part)")
        if k < rounds:
            out.append(f"s{k} AS (SELECT part, near.e AS e, unnest(x) AS x, unnest(range(len(x))) AS i FROM p JOIN a{k} USING (r, part))")
            out.append(f"m{k} AS (SELECT part, e, list(mean ORDER BY i) AS x FROM (SELECT part, e, i, floor(sum(x) / count(*)) AS mean FROM s{k} GROUP BY part, e, i) GROUP BY part, e)")
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (part, e))")
    return ",\n             ".join(out)



def _linked_sql(width: int, percent: int, more: str = "") -> str:
    """Components of documents whose word n-gram sets share ``percent`` of their union."""
    return rf"""
        WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
             g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i : i + {width - 1}], ' ')) END) AS x FROM t WHERE len(w) > 0),
             n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
             k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
             l AS (SELECT a, b FROM k JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= {percent} * (na.n + nb.n - k)),
             reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{more}
        FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
    """


#: The queries that SQL can express on whole tables, in DuckDB's.
ORACLES: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
             g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)
    """,
    "op1_substring_dedup": rf"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
             s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM t WHERE len(w) >= 35),
             k AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS x FROM s),
             again AS (SELECT x FROM k GROUP BY x HAVING count(*) > 1),
             gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM k SEMI JOIN again USING (x)),
             m AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
             p AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t),
             kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM p ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM t LEFT JOIN m USING (r) LEFT JOIN kept USING (r)
    """,
    "op9_jaccard_join": _linked_sql(3, 90),
    "op13_minmax_dedup": _linked_sql(4, 80, ", doc_id = component_id AS kept"),
    "op11_importance_resampling": rf"""
        WITH polynomial AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: xor(c >> 1, (c & 1) * 3988292384))) AS p),
             d AS (SELECT doc_id, {_LETTERS} AS w FROM documents), b AS (SELECT {_LETTERS} AS w FROM benchmark),
             x AS (SELECT unnest(w) AS word, 1 AS raw FROM d UNION ALL SELECT unnest(w), 0 FROM b),
             n AS (SELECT word, sum(raw) AS s, sum(1 - raw) AS t FROM x GROUP BY word),
             y AS (SELECT word, s, t, hex(encode(word)) AS h FROM n),
             z AS (SELECT word, s, t, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, e: xor(c >> 8, p[xor(c & 255, e) + 1])), 4294967295) % 10000 AS bucket FROM y, polynomial),
             c AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM z GROUP BY bucket),
             a AS (SELECT sum(s) AS su, sum(t) AS tu FROM c),
             g AS (SELECT word, CAST(floor(1000 * ln(CAST((c.t + 1) * (su + 10000) AS DOUBLE) / CAST((c.s + 1) * (tu + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM z JOIN c USING (bucket), a),
             r AS (SELECT row_number() OVER () AS r, doc_id, w FROM d),
             e AS (SELECT r, unnest(w) AS word FROM r),
             m AS (SELECT r, sum(gain) AS weight FROM e JOIN g USING (word) GROUP BY r),
             v AS (SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r LEFT JOIN m USING (r)),
             o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn FROM v)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM o
    """,
    "op12_yinyang_codes": f"""
        WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
                                FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM k, range(4) t(part)),
             c0 AS MATERIALIZED (SELECT part, r AS e, x FROM p WHERE r < 256),
             {_lloyd_sql(4)},
             f AS (SELECT r, lower(string_agg(printf('%02x', near.e), '' ORDER BY part)) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a4 GROUP BY r),
             h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c4)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), h
    """,
}
