"""Approximate nearest neighbours by largest inner product.

An inverted file of coarse centroids; inside a list, vectors are held as
product-quantised residuals, each a length and the codes of its direction, so that
rows close to their centroid are told apart as well as rows far from it.  A query
probes its best lists: its inner products with the codewords of every subspace are
tabulated once (the asymmetric tables), a row's estimate is a sum of table entries,
and the best estimates are reranked by exact inner products in double precision.

Centroids and codebooks are fitted on a bounded sample; every row is indexed.  How
many lists a query must probe depends on the data: it is read off the sample, whose
exact neighbours are known; a query whose lists hold too few rows probes more.  Lists are dealt out in blocks, so a crowded one (many
copies of one vector) does not meet in one task, and so are the queries of a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.plans.scratch import stage

#: Rows that centroids and codebooks are fitted on.
SAMPLE_ROWS = 16_384
SUBSPACES = 32
CODEWORDS = 64
#: Lists: the root of the number of rows over 4, within these bounds.
LISTS = (4, 1024)
BLOCK_ROWS = 4_096
#: Queries that meet a block of a list at once.
BLOCK_QUERIES = 8_192
#: Exact reranking of so many best estimates of a query in each block.
RERANK = 320
#: Share of the sample's true neighbours that the probed lists must hold.
COVER = 0.98
SAMPLE_QUERIES = 256
TURNS = 10
SEED = 11


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # (lists, dim)
    codebooks: np.ndarray  # (subspaces, codewords, width)
    probes: int

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def assign(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the residuals and codes of their directions."""
        length, rest = polar(x - self.centroids[at])
        rest = self.split(rest)
        return length, np.stack([nearest(rest[:, m], self.codebooks[m]) for m in range(len(self.codebooks))], axis=1).astype(np.uint8)

    def split(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.codebooks.shape
        padded = np.zeros((len(x), m * width), x.dtype)
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), m, width)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with each codeword: (queries, subspaces, codewords)."""
        return np.einsum("qmw,mcw->qmc", self.split(queries), self.codebooks, optimize=True)


def polar(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((x**2).sum(axis=1))
    return length.astype(np.float32), x / np.where(length > 0, length, 1)[:, None]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre by Euclidean distance, in slices."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[k : k + 4096] @ centres.T - half).argmax(axis=1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(TURNS):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def fit(sample: np.ndarray, total: int, k: int) -> Index:
    rng = np.random.default_rng(SEED)
    lists = int(np.clip(round(total**0.5 / 4), *LISTS))
    centroids = kmeans(sample, min(lists, len(sample)), rng)
    dim = sample.shape[1]
    m = min(SUBSPACES, dim)
    width = -(-dim // m)
    index = Index(centroids, np.zeros((m, 1, width), np.float32), 1)
    rest = index.split(polar(sample - centroids[index.assign(sample)])[1])
    books = np.stack([kmeans(np.ascontiguousarray(rest[:, j]), CODEWORDS, rng) for j in range(m)])
    # lists that hold the true neighbours of sample queries, in the order a query probes
    asked = rng.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    probes = 1
    if k > 0:
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-(sample[asked] @ centroids.T), axis=1).argsort(axis=1)
        held = np.take_along_axis(order, index.assign(sample)[top], axis=1)
        probes = int(np.quantile(held, COVER, method="higher")) + 1
    return Index(centroids, books.astype(np.float32), probes)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, without those that take no part."""
    for batch in batches:
        ids, out = [], []
        for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            if vec_id is None or not v or None in v:
                continue
            x = np.array(v, np.float32)
            if np.isfinite(x).all() and x.any():
                ids.append(vec_id)
                out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])


def _index_rows(index: Index):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("v"), index.dim)
            at = index.assign(x)
            length, codes = index.encode(x, at)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(at.astype(np.int32)), pa.array(length), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "v", "list", "length", "code"])

    return add


def _probe(index: Index, sizes: np.ndarray, k: int):
    """The index's number of lists, and further ones until they hold ``k`` rows besides the query's own."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _vectors(batch.column("v"), index.dim)
            order = np.argsort(-(x @ index.centroids.T), axis=1, kind="stable")
            short = np.cumsum(sizes[order], axis=1) < k + np.asarray(batch.column("own"))[:, None]
            taken = np.arange(order.shape[1]) < np.maximum(index.probes, short.sum(axis=1) + 1)[:, None]
            best = order[taken]
            take = pa.array(np.repeat(np.arange(len(x)), taken.sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(best.astype(np.int32))], names=["query_id", "q", "list"])

    return probe


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, in double precision and one order of addition."""
    return (queries.astype(np.float64, copy=False) * rows.astype(np.float64, copy=False)).sum(axis=-1)


def leading(estimate: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest of each row, in no order; of equals, the first places."""
    n = estimate.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), estimate.shape)
    bits = np.ascontiguousarray(estimate, np.float32).view(np.int32)
    ordered = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64)  # integers in the order of the floats
    return np.argpartition(ordered * -n + np.arange(n), k - 1, axis=1)[:, :k]


def _search(index: Index, k: int, rerank: int):
    """Best rows of one block for the queries that probe it."""

    def search(rows: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(probes):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        rows = rows.sort_values("vec_id", kind="stable")
        x = np.frombuffer(b"".join(rows["v"]), np.float32).reshape(len(rows), -1).astype(np.float64)
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        ids, length = rows["vec_id"].to_numpy(), rows["length"].to_numpy()
        base = index.centroids[int(rows["list"].iloc[0])]
        found = []
        for lo in range(0, len(probes), 64):
            part = probes.iloc[lo : lo + 64]
            q = np.frombuffer(b"".join(part["q"]), np.float32).reshape(len(part), -1)
            tables = index.tables(q)
            estimate = np.zeros((len(part), len(rows)), np.float32)
            for m in range(codes.shape[1]):
                estimate += np.take(tables[:, m], codes[:, m], axis=1)
            estimate = estimate * length + (q @ base)[:, None]
            asker = part["query_id"].to_numpy()
            estimate[asker[:, None] == ids[None, :]] = -np.inf
            best = leading(estimate, rerank)
            score = exact(q[:, None, :], x[best])
            score[asker[:, None] == ids[best]] = -np.inf
            order = np.lexsort((best, -score), axis=1)[:, :k]
            best, score = np.take_along_axis(best, order, axis=1), np.take_along_axis(score, order, axis=1)
            real = score > -np.inf
            found.append(pd.DataFrame({"query_id": np.repeat(asker, best.shape[1])[real.ravel()], "vec_id": ids[best][real], "score": score[real]}))
        return pd.concat(found)

    return search


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, all of the commonest dimension."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"))
    packed = stage(rows.mapInArrow(_pack, "vec_id long, v binary"), "vectors")
    common = packed.groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return packed.filter(F.length("v") == common["n"]) if common else packed


def build(packed: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS) -> Index | None:
    """Fit on the ``sample_rows`` first vectors by hash of the id."""
    total = packed.count()
    if not total:
        return None
    sample = packed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toPandas()
    return fit(np.stack([np.frombuffer(b, np.float32) for b in sample["v"]]), total, k)


def search(vectors: DataFrame, query_every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query.

    Queries are the rows whose id divides by ``query_every``; candidates are all rows
    but those of the query's own id.  Nearest first, ties to the smaller vec_id.
    Vectors that are null, zero, of another dimension than most, or that hold null or
    non-finite components take no part, nor do null ids.  Rows that repeat a query's
    id ask once, with the least of their vectors; as candidates each row counts.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    packed = usable(vectors, id_col, vector_col)
    index = build(packed, k)
    if index is None:
        return spark.createDataFrame([], schema)
    rows = stage(packed.mapInArrow(_index_rows(index), "vec_id long, v binary, list int, length float, code binary"), "index")
    # one row for each list, of which there are at most LISTS[1]
    blocks = F.broadcast(rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
    dealt = rows.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    asked = packed.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in rows.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    probes = asked.mapInArrow(_probe(index, sizes, k), "query_id long, q binary, list int")
    # a list is copied as often as its own probes need, and not at all without any; one row for each list
    parts = F.broadcast(probes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts")))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.join(parts, "list").withColumn("part", each).drop("parts")
    probes = probes.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
    probes = probes.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = dealt.groupBy("list", "block", "part").cogroup(probes.groupBy("list", "block", "part")).applyInPandas(_search(index, k, rerank), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[int]]:
    """Exact answers for tests and for measuring recall."""
    out = {}
    for i in queries:
        score = exact(x[i][None, :], x)
        order = np.lexsort((ids, -score))
        out[int(ids[i])] = [int(j) for j in ids[order] if j != ids[i]][:k]
    return out
