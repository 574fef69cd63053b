"""The match language and its BM25 ranking, over an inverted index of postings.

A query is blank-separated tokens; each is a phrase of one or more terms that must
stand side by side in one column.  Three rungs are tried: all phrases, any of the
query's identifiers, any phrase; the first that finds something decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions.text import py_bigrams, py_tokens, tokens
from harrow.operators.paths import in_scope, test_tier

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
SYMBOL_BOOST = 2.0
COLUMNS = ("text", "symbol", "path")
#: Postings are laid out in so many folders by hash of the term; a search opens those of its terms.
TERM_BUCKETS = 64

CHUNK_COLUMNS = ("chunk_id", "text_bigram", "symbol", "path", "start_line")


@dataclass(frozen=True)
class Rung:
    """Phrases, each a tuple of terms, and whether all of them must be there."""

    phrases: tuple[tuple[str, ...], ...]
    every: bool


def _phrases(words: list[str]) -> tuple[tuple[str, ...], ...]:
    # punctuation alone has no terms: dropped under "all", never found under "any"
    return tuple(p for p in dict.fromkeys(tuple(py_tokens(w)) for w in words) if p)


def identifiers(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", query)))


def is_punctuation_only(query: str) -> bool:
    return bool(query.strip()) and not re.search(r"[A-Za-z_一-鿿]", query)


def rungs(query: str) -> list[Rung]:
    """The rungs of a query without repeats; none for punctuation alone."""
    if not query.strip() or is_punctuation_only(query):
        return []
    words = py_bigrams(query).split()
    out = [Rung(_phrases(words), True), Rung(_phrases(identifiers(query)), False), Rung(_phrases(words), False)]
    return [r for r in dict.fromkeys(out) if r.phrases]


def token_columns(chunks: DataFrame) -> DataFrame:
    """Chunks with their tokens by column and their length over all columns."""
    x = chunks.withColumns({"t_text": tokens(F.col("text_bigram")), "t_symbol": tokens(F.col("symbol")), "t_path": tokens(F.col("path"))})
    return x.withColumn("dl", F.size("t_text") + F.size("t_symbol") + F.size("t_path"))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, col, pos) of every token."""
    x = token_columns(chunks)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"t_{c}").alias("terms")) for c in COLUMNS])).alias("c")
    return x.select("chunk_id", each).select("chunk_id", "c.col", F.posexplode("c.terms").alias("pos", "term"))


def lengths(chunks: DataFrame) -> DataFrame:
    return token_columns(chunks).select("chunk_id", "path", "symbol", "start_line", "dl")


def corpus_stats(lengths_: DataFrame) -> DataFrame:
    return lengths_.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_df(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term").agg(F.countDistinct("chunk_id").alias("df"), F.count("*").alias("cf"))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def phrase_table(spark: SparkSession, queries: list[tuple[str, Rung]]) -> DataFrame:
    """(query_id, rung, every, phrase, offset, term, size, wanted): as long as the queries."""
    rows = []
    for query_id, rung_no, rung in ((q, i, r) for q, i, r in queries):
        for p, phrase in enumerate(rung.phrases):
            rows += [(query_id, rung_no, rung.every, p, o, t, len(phrase), len(rung.phrases)) for o, t in enumerate(phrase)]
    return spark.createDataFrame(rows, "query_id string, rung int, every boolean, phrase int, offset int, term string, size int, wanted int")


def phrase_counts(postings_: DataFrame, phrases: DataFrame) -> DataFrame:
    """How often each phrase stands in each chunk.

    A phrase of m terms stands at p when its k-th term is at p + k for each k, in
    one column; overlapping occurrences count.
    """
    hits = postings_.join(F.broadcast(phrases), "term").withColumn("start", F.col("pos") - F.col("offset"))
    whole = hits.groupBy("query_id", "rung", "every", "phrase", "size", "wanted", "chunk_id", "col", "start").agg(F.count("*").alias("k")).filter("k = size")
    return whole.groupBy("query_id", "rung", "every", "phrase", "wanted", "chunk_id").agg(F.count("*").alias("tf"))


def scored(counts: DataFrame, lengths_: DataFrame) -> DataFrame:
    """(query_id, rung, chunk_id, bm25): smaller is better, as a negated BM25."""
    key = ["query_id", "rung", "phrase"]
    often = F.broadcast(counts.groupBy(*key).agg(F.count("*").alias("df")))  # as long as the queries
    stats = corpus_stats(lengths_)
    x = counts.join(often, key).join(lengths_.select("chunk_id", "dl"), "chunk_id").crossJoin(F.broadcast(stats))
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    grouped = x.withColumn("s", idf * tf).groupBy("query_id", "rung", "every", "wanted", "chunk_id").agg(F.sum("s").alias("s"), F.count("*").alias("found"))
    return grouped.filter("NOT every OR found = wanted").select("query_id", "rung", "chunk_id", (-F.col("s")).alias("bm25"))


def search(
    postings_: DataFrame,
    lengths_: DataFrame,
    queries: dict[str, str],
    k: int = 10,
    scope: str | None = None,
    boost: bool = True,
    only_rung: int | None = None,
) -> DataFrame:
    """(query_id, rung, rank, chunk_id, path, bm25, score) of the best ``k`` for each query.

    All queries run as one plan.  Statistics are those of the whole corpus, also
    under a scope.  Order: tests last, then bm25 less the boost of a chunk whose
    symbol the query names, then chunk_id.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = postings_.sparkSession
    wanted = [(q, i, r) for q, text in queries.items() for i, r in enumerate(rungs(text)) if only_rung in (None, i)]
    terms = sorted({t for _, _, r in wanted for p in r.phrases for t in p})
    part = postings_.filter(F.col("term").isin(terms)) if terms else postings_.limit(0)
    if "bucket" in postings_.columns and terms:
        buckets = spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term")).alias("b")).distinct().collect()
        part = part.filter(F.col("bucket").isin([r["b"] for r in buckets]))
    hits = scored(phrase_counts(part, phrase_table(spark, wanted)), lengths_)
    hits = hits.join(lengths_.drop("dl"), "chunk_id").filter(in_scope(F.col("path"), scope))
    if boost:
        names = spark.createDataFrame([(q, s) for q, text in queries.items() for s in identifiers(text)], "query_id string, symbol string")
        hits = hits.join(F.broadcast(names.withColumn("named", F.lit(1))), ["query_id", "symbol"], "left")
        score = F.col("bm25") - F.when(F.col("named") == 1, SYMBOL_BOOST).otherwise(0.0)
    else:
        score = F.col("bm25")
    hits = hits.withColumn("score", score).withColumn("tier", test_tier(F.col("path")))
    first = Window.partitionBy("query_id")
    order = Window.partitionBy("query_id").orderBy("rung", "tier", "score", "chunk_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # the k best by rung and rank hold all that the first rung needs
    return hits.withColumn("least", F.min("rung").over(first)).filter("rung = least").select("query_id", "rung", "rank", "chunk_id", "path", "start_line", "bm25", "score")


#: Chunks scored at once against all queries of ``search_many``.
SCORED_ROWS = 2_000
_MANY = "query_id string, rung int, chunk_id long, path string, start_line int, bm25 double, score double, tier int"


@dataclass(frozen=True)
class _Board:
    """All rungs of all queries as columns: what each phrase counts for."""

    uses: list[np.ndarray]  # of each phrase, the columns that have it
    every: np.ndarray
    wanted: np.ndarray
    asked: list[tuple[str, list[tuple[int, int]]]]  # query_id, (rung, column) in order
    named: dict[str, np.ndarray]  # symbol to the places in ``asked`` that name it
    k: int
    idf: np.ndarray | None = None  # of each phrase, and the mean length, unless the rows have them
    mean: float | None = None

    def best(self, ids: np.ndarray, tier: np.ndarray, symbols: list, at: np.ndarray, phrase: np.ndarray, s: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(query_id, rung, places, bm25, score) of the ``k`` best chunks by the first rung that finds some here."""
        total, found = np.zeros((len(ids), len(self.every))), np.zeros((len(ids), len(self.every)), np.int32)
        order = np.argsort(phrase, kind="stable")
        edges = np.flatnonzero(np.diff(phrase[order], prepend=-1))
        # one phrase after the other, so equal chunks have equal sums
        for lo, hi in zip(edges, [*edges[1:], len(order)]):
            part = order[lo:hi]
            place = at[part][:, None], self.uses[phrase[part[0]]]
            total[place] += s[part][:, None]
            found[place] += 1
        hit = np.where(self.every, found == self.wanted, found > 0)
        boost = np.zeros((len(ids), len(self.asked)))
        for i, symbol in enumerate(symbols):
            if symbol in self.named:
                boost[i, self.named[symbol]] = SYMBOL_BOOST
        for j, (query_id, columns) in enumerate(self.asked):
            for rung, c in columns:
                rows = np.flatnonzero(hit[:, c])
                if len(rows):
                    bm25 = -total[rows, c]
                    score = bm25 - boost[rows, j]
                    first = np.lexsort((ids[rows], score, tier[rows]))[: self.k]
                    yield query_id, rung, rows[first], bm25[first], score[first]
                    break

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SCORED_ROWS):
                batch = whole.slice(lo, SCORED_ROWS)
                entries = batch.column("entries")
                flat = entries.flatten()
                number = lambda c: np.asarray(c, np.float64)
                at = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(entries)))
                mean = number(batch.column("avgdl")) if self.mean is None else self.mean
                tf, room = number(flat.field("tf")), 1 - B + B * number(batch.column("dl")) / mean
                idf = number(flat.field("idf")) if self.idf is None else self.idf[np.asarray(flat.field("phrase"))]
                s = idf * (tf * (K1 + 1) / (tf + K1 * room[at]))
                ids, tier = np.asarray(batch.column("chunk_id")), np.asarray(batch.column("tier"))
                out = list(self.best(ids, tier, batch.column("symbol").to_pylist(), at, np.asarray(flat.field("phrase")), s))
                if out:
                    rows = np.concatenate([o[2] for o in out])
                    sizes = [len(o[2]) for o in out]
                    took = batch.select(["chunk_id", "path", "start_line", "tier"]).take(pa.array(rows))
                    query_id = pa.array([o[0] for o in out]).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
                    rung = pa.array(np.repeat([o[1] for o in out], sizes), pa.int32())
                    bm25, score = (pa.array(np.concatenate([o[i] for o in out])) for i in (3, 4))
                    columns = [query_id, rung, took.column("chunk_id"), took.column("path"), took.column("start_line"), bm25, score, took.column("tier")]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "rung", "chunk_id", "path", "start_line", "bm25", "score", "tier"])


def _board(queries: dict[str, str], k: int) -> tuple[_Board, dict[tuple[str, ...], int]]:
    """The queries as a board, and the number of each phrase."""
    numbers: dict[tuple[str, ...], int] = {}
    uses, every, wanted, asked, named = [], [], [], [], {}
    for query_id, text in queries.items():
        columns = []
        for rung_no, rung in enumerate(rungs(text)):
            columns.append((rung_no, len(every)))
            for phrase in rung.phrases:
                if numbers.setdefault(phrase, len(numbers)) == len(uses):
                    uses.append([])
                uses[numbers[phrase]].append(len(every))
            every.append(rung.every)
            wanted.append(len(rung.phrases))
        for symbol in identifiers(text):
            named.setdefault(symbol, []).append(len(asked))
        asked.append((query_id, columns))
    return _Board([np.array(u) for u in uses], np.array(every, bool), np.array(wanted), asked, {s: np.array(n) for s, n in named.items()}, k), numbers


def search_many(postings_: DataFrame, lengths_: DataFrame, queries: dict[str, str], k: int = 10) -> DataFrame:
    """What ``search`` finds in the whole corpus, for many or long queries.

    A phrase is counted once, not for each query and rung that has it.  The phrases of
    a chunk meet in one row, and chunks are scored against all queries in Arrow batches,
    which return the ``k`` best of each query; so no row stands for a query, a phrase
    and a chunk.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    from harrow.plans.ship import ship

    spark = postings_.sparkSession
    ship(spark)
    board, numbers = _board(queries, k)
    phrases = spark.createDataFrame([(t, n, o, len(p)) for p, n in numbers.items() for o, t in enumerate(p)], "term string, phrase int, offset int, size int")
    alone = F.col("size") == 1
    hits = postings_.join(F.broadcast(phrases), "term")
    # occurrences of one term need no places
    starts = hits.groupBy("phrase", "size", "chunk_id", F.when(~alone, F.col("col")).alias("col"), F.when(~alone, F.col("pos") - F.col("offset")).alias("start")).agg(F.count("*").alias("n"))
    tf = starts.groupBy("phrase", "chunk_id").agg(F.sum(F.when(alone, F.col("n")).when(F.col("n") == F.col("size"), 1).otherwise(0)).alias("tf")).filter("tf > 0")
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = tf.groupBy("phrase").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus_stats(lengths_)))
    known = known.select("phrase", F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw).alias("idf"), "avgdl")
    met = tf.join(F.broadcast(known), "phrase").groupBy("chunk_id").agg(F.collect_list(F.struct("phrase", "tf", "idf")).alias("entries"), F.first("avgdl").alias("avgdl"))
    rows = met.join(lengths_, "chunk_id").withColumn("tier", test_tier(F.col("path")))
    rows = rows.select(F.col("chunk_id").cast("long").alias("chunk_id"), "path", F.col("start_line").cast("int").alias("start_line"), F.col("tier").cast("int").alias("tier"), "symbol", "dl", "avgdl", "entries")
    return _first_rung(rows.mapInArrow(board, _MANY), k)


def _first_rung(best: DataFrame, k: int) -> DataFrame:
    """Of the best rows by task, the ``k`` best of each query by the first rung that finds some."""
    order = Window.partitionBy("query_id").orderBy("rung", "tier", "score", "chunk_id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    least = F.min("rung").over(Window.partitionBy("query_id"))
    return best.withColumn("least", least).filter("rung = least").select("query_id", "rung", "rank", "chunk_id", "path", "start_line", "bm25", "score")


def _phrase_counter(numbers: dict[tuple[str, ...], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often each phrase stands in each chunk: a chunk has all its tokens, so nothing needs to meet first."""
    vocabulary = sorted({t for p in numbers for t in p})
    code = {t: i for i, t in enumerate(vocabulary)}
    single = np.full(len(vocabulary) + 1, -1, np.int64)  # the last is for words that no query has
    for p, i in numbers.items():
        if len(p) == 1:
            single[code[p[0]]] = i
    several = [(i, [code[t] for t in p]) for p, i in numbers.items() if len(p) > 1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for whole in batches:
            for lo in range(0, whole.num_rows, SCORED_ROWS):
                batch = whole.slice(lo, SCORED_ROWS)
                met = []
                for name in COLUMNS:
                    column = batch.column(f"t_{name}")
                    row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(column).fill_null(0)))
                    term = np.asarray(pc.index_in(column.flatten(), value_set=known).fill_null(len(vocabulary))).astype(np.int64)
                    phrase = single[term]
                    met.append(row[phrase >= 0] * len(numbers) + phrase[phrase >= 0])
                    order = np.argsort(term, kind="stable")
                    edges = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
                    for i, terms in several:
                        start = order[edges[terms[0]] : edges[terms[0] + 1]]
                        start = start[start + len(terms) <= len(term)]
                        for o, t in enumerate(terms[1:], 1):
                            start = start[term[start + o] == t]
                        start = start[row[start] == row[start + len(terms) - 1]]
                        met.append(row[start] * len(numbers) + i)
                pairs, tf = np.unique(np.concatenate(met), return_counts=True)
                sizes = np.bincount(pairs // len(numbers), minlength=batch.num_rows)
                entries = pa.StructArray.from_arrays([pa.array((pairs % len(numbers)).astype(np.int32)), pa.array(tf.astype(np.int64))], names=["phrase", "tf"])
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), entries)
                kept = ["chunk_id", "path", "start_line", "tier", "symbol", "dl"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], listed], names=[*kept, "entries"])

    return count


def search_chunks(chunks: DataFrame, queries: dict[str, str], k: int = 10) -> DataFrame:
    """What ``search_many`` finds, from chunks (chunk_id, text_bigram, symbol, path, start_line).

    Phrases are counted where a chunk is cut into tokens, batch by batch, so no task
    holds more than a batch, however large its part of the input.  What was counted is
    staged; the driver gets a number for each phrase.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    from harrow.plans.scratch import stage
    from harrow.plans.ship import ship

    ship(chunks.sparkSession)
    board, numbers = _board(queries, k)
    if not numbers:
        return _first_rung(chunks.sparkSession.createDataFrame([], _MANY), k)
    x = token_columns(chunks).withColumn("tier", test_tier(F.col("path")))
    x = x.select(F.col("chunk_id").cast("long").alias("chunk_id"), "path", F.col("start_line").cast("int").alias("start_line"), F.col("tier").cast("int").alias("tier"), "symbol", F.col("dl").cast("int").alias("dl"), *[f"t_{c}" for c in COLUMNS])
    counted = stage(x.mapInArrow(_phrase_counter(numbers), "chunk_id long, path string, start_line int, tier int, symbol string, dl int, entries array<struct<phrase: int, tf: bigint>>"), "counted")
    n, mean = counted.agg(F.count("*"), F.avg("dl")).first()
    df = np.zeros(len(numbers))
    for r in counted.select(F.explode("entries.phrase").alias("phrase")).groupBy("phrase").count().collect():  # one row for each phrase asked
        df[r["phrase"]] = r["count"]
    raw = np.log((n - df + 0.5) / (df + 0.5))
    board = replace(board, idf=np.where(raw <= 0, LEAST_IDF, raw), mean=mean or 1.0)
    return _first_rung(counted.filter(F.size("entries") > 0).mapInArrow(board, _MANY), k)
