"""What an index is made of: markers that commit, changes between two states, vectors and their cache.

``segments`` keeps the index itself; its marker is written last.
"""

from __future__ import annotations

import json

from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.text import bigrams
from harrow.operators.embedding import Embedder, embedded
from harrow.operators.paths import secret_shape

SCHEMA_VERSION = 2
MARKER = "_READY.json"
#: Texts embedded between two commits to the cache.
CACHE_TEXTS = 256


def _path(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, name: str) -> bool:
    fs, p = _path(spark, name)
    return fs.exists(p)


def write_marker(spark: SparkSession, store: str, facts: dict) -> None:
    fs, p = _path(spark, f"{store}/{MARKER}")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(facts).encode()))
    out.close()


def clear_marker(spark: SparkSession, store: str) -> None:
    fs, p = _path(spark, f"{store}/{MARKER}")
    fs.delete(p, False)


def read_marker(spark: SparkSession, store: str) -> dict | None:
    fs, p = _path(spark, f"{store}/{MARKER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status) of files (path, content_hash): new, changed, unchanged or deleted."""
    a, b = before.select("path", F.col("content_hash").alias("was")), now.select("path", F.col("content_hash").alias("is"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(F.col("was") == F.col("is"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def split_secrets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks that may be kept, and (path, pattern) of those that hold a secret."""
    marked = found.withColumn("pattern", secret_shape(F.col("text")))
    return marked.filter("pattern IS NULL").drop("pattern"), marked.filter("pattern IS NOT NULL").select("path", "pattern")


def redacted_whole(kept: DataFrame, secrets: DataFrame) -> DataFrame:
    """Paths all of whose chunks hold secrets."""
    return secrets.select("path").distinct().join(kept.select("path").distinct(), "path", "left_anti")


def searchable(found: DataFrame) -> DataFrame:
    return found.select("chunk_id", bigrams(F.col("text")).alias("text_bigram"), F.coalesce("symbol_name", F.lit("")).alias("symbol"), "path", "start_line")


def reuse_vectors(found: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors that still fit their chunk, and chunks that need one."""
    keys = ["chunk_id", "content_hash"]
    return vectors.join(found.select(*keys), keys, "left_semi"), found.join(vectors.select(*keys), keys, "left_anti")


def vector_status(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, with a vector, without one, and vectors of no chunk."""
    keys = ["chunk_id", "content_hash"]
    have = found.select(*keys).join(vectors.select(*keys).withColumn("v", F.lit(1)), keys, "full_outer").join(found.select(*keys).withColumn("c", F.lit(1)), keys, "left")
    n = lambda cond: F.count(F.when(cond, 1))
    return have.agg(n(F.col("c") == 1).alias("chunks"), n((F.col("c") == 1) & (F.col("v") == 1)).alias("reusable"), n((F.col("c") == 1) & F.col("v").isNull()).alias("pending"), n(F.col("c").isNull()).alias("stale"))


def embed(pending: DataFrame, embedder: Embedder, model: str, cache: DataFrame | None = None, count: Accumulator | None = None) -> DataFrame:
    """(chunk_id, content_hash, embedding): each distinct text is embedded once, if no cache has it."""
    keyed = pending.withColumn("sha", F.sha2("text", 256))
    texts = keyed.select("sha", "text").dropDuplicates(["sha"])
    if cache is not None:
        known = cache.filter(F.col("model") == model).select("sha", "embedding").dropDuplicates(["sha"])
        texts = texts.join(known, "sha", "left_anti")
    made = embedded(texts, embedder, count)
    if cache is not None:
        made = made.unionByName(known)
    return keyed.join(made, "sha").select("chunk_id", "content_hash", "embedding")


def load_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """(model, sha, embedding) of what was embedded before, each once; None if nothing was."""
    fs, p = _path(spark, path)
    if not fs.exists(p) or not any(f.getPath().getName().startswith("part-") for f in fs.listStatus(p)):
        return None
    return spark.read.schema("model string, sha string, embedding array<float>").parquet(path).dropDuplicates(["model", "sha"])


def cache_records(spark: SparkSession, path: str) -> int:
    """How many records the cache holds, from the footers of its files."""
    fs, p = _path(spark, path)
    if not fs.exists(p) or not any(f.getPath().getName().startswith("part-") for f in fs.listStatus(p)):
        return 0
    return spark.read.schema("model string, sha string, embedding array<float>").parquet(path).count()


def fill_cache(spark: SparkSession, pending: DataFrame, embedder: Embedder, model: str, path: str, count: Accumulator | None = None) -> int:
    """Embed the texts of which the cache has no vector, and append them.

    Returns how many there were.  Tasks of about ``CACHE_TEXTS`` texts commit on their
    own (the committer's second algorithm), so what was embedded before an interruption
    stays.
    """
    cache = load_cache(spark, path)
    texts = pending.select("text", F.sha2("text", 256).alias("sha")).dropDuplicates(["sha"])
    if cache is not None:
        texts = texts.join(cache.filter(F.col("model") == model).select("sha"), "sha", "left_anti")
    n = texts.count()
    if not n:
        return 0
    made = embedded(texts.repartition(-(-n // CACHE_TEXTS), "sha"), embedder, count)
    made.select(F.lit(model).alias("model"), "sha", "embedding").write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return n
