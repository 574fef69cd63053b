"""Vector ranking, fusion of rankings, token budgets, presentation order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.text import CHARS_PER_TOKEN
from harrow.functions.vectors import cosine, doubles, norm
from harrow.operators.paths import is_test_path

RRF_K = 60
#: Rows and queries that meet in one task of a batch of vector queries.
ROW_BLOCK, QUERY_BLOCK = 4_096, 1_024


def cosine_topk(rows: DataFrame, query: list[float], k: int, tier: Column | None = None) -> DataFrame:
    """The ``k`` rows (chunk_id, embedding) nearest to one query vector.

    The tier is a leading sort key, so it applies before the cut.  A query of norm 0
    finds nothing; a row of norm 0 scores 0.
    """
    size = math.sqrt(sum(x * x for x in query))
    if size == 0:
        rows = rows.filter(F.lit(False))
    vector = F.array(*[F.lit(float(x)) for x in query])
    x = rows.withColumn("score", cosine(F.col("embedding"), vector, F.lit(size or 1.0))).withColumn("tier", F.lit(0) if tier is None else tier)
    best = x.orderBy("tier", F.desc("score"), "chunk_id").limit(k)
    order = Window.orderBy("tier", F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).drop("embedding")


def _best_of_block(k: int):
    """The ``k`` nearest rows of a block for each query of a block."""

    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_id", kind="stable")
        ids, norms = rows["chunk_id"].to_numpy(), rows["row_norm"].to_numpy(np.float64)
        width = np.array([-1 if v is None else len(v) for v in rows["embedding"]])
        out = []
        by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for query_id, q, q_norm in zip(queries["query_id"], queries["q"], queries["q_norm"]):
            if len(q) not in by_width:
                # a null score where components are null or not as many as the query's
                at = np.flatnonzero((width == len(q)) & rows["row_norm"].notna().to_numpy())
                by_width[len(q)] = at, np.array([rows["embedding"].iloc[i] for i in at], np.float64).reshape(len(at), len(q))
            at, x = by_width[len(q)]
            size, score = norms[at] * q_norm, np.full(len(rows), np.nan)
            # one order of addition for every pair, so equal rows tie
            with np.errstate(all="ignore"):
                score[at] = np.where(size == 0, 0.0, (x * np.asarray(q, np.float64)).sum(axis=1) / np.where(size == 0, 1.0, size))
            if not np.isfinite(score[at]).all():
                raise ValueError("a similarity score is not finite")
            first = np.argsort(-score, kind="stable")[:k]
            out.append(pd.DataFrame({"query_id": query_id, "chunk_id": ids[first], "score": score[first]}))
        return pd.concat(out) if out and len(rows) else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})

    return best


def cosine_batch(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows of each query (query_id, q), blocks of queries against blocks of rows."""
    from harrow.plans.ship import ship

    ship(rows.sparkSession)
    x = rows.select(F.col("chunk_id").cast("long").alias("chunk_id"), doubles(F.col("embedding")).alias("embedding")).withColumn("row_norm", F.when(~F.exists("embedding", lambda v: v.isNull()), norm(F.col("embedding"))))
    # as in the scores, a norm that is NaN must not pass for a null
    x = x.withColumn("row_norm", F.when(F.isnan("row_norm"), F.lit(float("inf"))).otherwise(F.col("row_norm")))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), doubles(F.col("q")).alias("q")).withColumn("q_norm", norm(F.col("q"))).filter("q_norm > 0")
    many = lambda df, size, name: F.broadcast(df.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias(name)))
    blocks = many(rows, ROW_BLOCK, "row_blocks").crossJoin(many(queries, QUERY_BLOCK, "query_blocks"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    x = x.crossJoin(F.broadcast(blocks)).withColumn("a", own("chunk_id", "row_blocks")).withColumn("b", all_of("query_blocks")).drop("row_blocks", "query_blocks")
    asked = asked.crossJoin(F.broadcast(blocks)).withColumn("b", own("query_id", "query_blocks")).withColumn("a", all_of("row_blocks")).drop("row_blocks", "query_blocks")
    found = x.groupBy("a", "b").cogroup(asked.groupBy("a", "b")).applyInPandas(_best_of_block(k), "query_id long, chunk_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def rrf(lexical: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """Full outer fusion of two rankings (path, seq, rank, ...); the first one's attributes win."""
    a, b = lexical.withColumnRenamed("rank", "rank_a"), vector.withColumnRenamed("rank", "rank_b")
    keys = ["path", "seq"]
    rest = [c for c in a.columns if c not in (*keys, "rank_a")]
    both = a.join(b.withColumnsRenamed({c: f"_{c}" for c in b.columns if c not in (*keys, "rank_b")}), keys, "full_outer")
    picked = [F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if f"_{c}" in both.columns else F.col(c) for c in rest]
    share = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return both.select(*keys, *picked, "rank_a", "rank_b", (share("rank_a") + share("rank_b")).alias("rrf"))


def fused_topk(fused: DataFrame, k: int) -> DataFrame:
    """Tests last, then fused score, then place."""
    tier = F.when(is_test_path(F.col("path")), 1).otherwise(0)
    order = [F.col("tier"), F.desc("rrf"), F.col("path"), F.col("start_line"), F.col("seq")]
    best = fused.withColumn("tier", tier).orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def budget_prefix(hits: DataFrame, max_tokens: float, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The leading hits whose token estimates fit the budget; the first stays in any case.

    Running sums never fall, so what fits is a prefix.
    """
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    running = F.sum(F.length("text") / CHARS_PER_TOKEN).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = hits.withColumn("_n", F.row_number().over(w)).withColumn("_sum", running)
    return x.filter((F.col("_n") == 1) | (F.col("_sum") <= max_tokens)).drop("_n", "_sum")


def source_order(hits: DataFrame) -> DataFrame:
    """Hits as a reader meets them; ``rank`` keeps the order of relevance."""
    return hits.orderBy("path", "start_line")
