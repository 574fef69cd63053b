"""Stored tables that can be told apart: missing, corrupt, of another model, or sound.

Beside a table stands a sheet with the size and SHA-256 of each of its part files, made
by tasks that read the parts; the marker has the digest of the sheet, so two digests
vouch for any number of bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import index

SHEET = "part string, bytes long, sha string"
#: Rows of a part file at most, so that a task can hold the bytes of one.
PART_ROWS = 100_000


class StoreError(ValueError):
    """Why a stored table is of no use; ``code`` says which of the kinds it is."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


MISSING, CORRUPT, MISMATCH = "SEMANTIC_INDEX_MISSING", "SEMANTIC_INDEX_CORRUPT", "SEMANTIC_MODEL_MISMATCH"


def _parts(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha"))


def _digest(sheet: DataFrame) -> dict:
    """Number of parts, and a digest of the sheet that does not depend on its order."""
    line = F.xxhash64("part", "bytes", "sha").cast("decimal(38,0)")
    row = sheet.agg(F.count("*").alias("parts"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(line), F.lit(0)).cast("string").alias("sheet")).first()
    return row.asDict()


def write(table: DataFrame, path: str, facts: dict) -> dict:
    """Write a table and its sheet; returns the facts that its marker is to hold."""
    spark = table.sparkSession
    table.write.option("maxRecordsPerFile", PART_ROWS).parquet(f"{path}/rows")
    _parts(spark, f"{path}/rows").write.parquet(f"{path}/sheet")
    return facts | {"path": path, **_digest(spark.read.schema(SHEET).parquet(f"{path}/sheet"))}


def problems(spark: SparkSession, facts: dict) -> DataFrame:
    """(part, problem) of each part that is not as it was written: missing, corrupt or unknown."""
    sheet = spark.read.schema(SHEET).parquet(f"{facts['path']}/sheet")
    found = _parts(spark, f"{facts['path']}/rows").select("part", F.col("bytes").alias("now_bytes"), F.col("sha").alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha").isNull(), "unknown").when(F.col("sha") != F.col("now"), "corrupt")
    return sheet.join(found, "part", "full_outer").select("part", problem.alias("problem")).filter("problem IS NOT NULL")


def verify(spark: SparkSession, facts: dict) -> None:
    """Raise unless every byte is as it was written; the first bad parts are named."""
    if not index.exists(spark, f"{facts['path']}/sheet"):
        raise StoreError(CORRUPT, "the sheet of checksums is missing")
    try:
        now = _digest(spark.read.schema(SHEET).parquet(f"{facts['path']}/sheet"))
    except Exception as e:  # Parquet's readers raise many kinds
        raise StoreError(CORRUPT, f"the sheet of checksums cannot be read: {type(e).__name__}") from e
    if any(now[k] != facts[k] for k in now):
        raise StoreError(CORRUPT, "the sheet of checksums is not the one that was written")
    bad = problems(spark, facts).orderBy("part").limit(5).collect()
    if bad:
        raise StoreError(CORRUPT, "; ".join(f"{r['part']} is {r['problem']}" for r in bad))


def open_vectors(spark: SparkSession, store: str, model: str, dim: int | None = None) -> tuple[DataFrame, dict]:
    """The vectors of a store, if they are there and of this model and length."""
    try:
        facts = index.read_marker(spark, store)
    except ValueError as e:
        raise StoreError(CORRUPT, "the marker is not JSON") from e
    if facts is None or not index.exists(spark, f"{facts.get('path', store)}/rows"):
        raise StoreError(MISSING, f"no vectors under {store}")
    if not {"path", "model", "dim", "parts", "bytes", "sheet"} <= facts.keys():
        raise StoreError(CORRUPT, "the marker lacks fields")
    if facts["model"] != model or dim not in (None, facts["dim"]):
        raise StoreError(MISMATCH, f"vectors of model {facts['model']!r} (dimension {facts['dim']}), asked for {model!r}" + (f" ({dim})" if dim else ""))
    return spark.read.schema("chunk_id long, content_hash string, embedding array<float>").parquet(f"{facts['path']}/rows"), facts
