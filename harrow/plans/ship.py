"""Give Python workers this package, wherever they run."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    target = pathlib.Path(tempfile.mkdtemp(prefix="harrow-ship-")) / "harrow.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _DONE.add(app)
