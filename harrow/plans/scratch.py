"""Tables in the shared folder: how plans cut their lineage.

A staged table is plain Parquet under ``spark.checkpoint.dir``, so it outlives
any executor.  The folder is removed when the JVM that made it ends.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from harrow.plans.ship import ship

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this application's own, below the shared one."""
    ship(spark)
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                base = spark.conf.get("spark.sql.warehouse.dir")  # shared, unlike a temporary folder
            else:
                base = tempfile.mkdtemp(prefix="harrow-")
        root = f"{base.rstrip('/')}/harrow-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS[app] = fs.makeQualified(path).toString()
    return _ROOTS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def drop(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = table.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._staged_at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is staged by now.

    It does so when the driver's JVM collects its garbage, which may take long.  The
    last query is still held by the event that tells its end, hence a second time.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
