"""Run reports as a sink: tasks write the results, the commit puts the report together.

    results.write.format("run-report").option("path", p).option("k", 5).mode("overwrite").save()

Each task writes its results as JSON into a folder beside the report and tells the
driver how many there are of each class, and how many hit.  The commit streams those
files, in the order of the partitions, behind a head with the totals, and renames the
whole into place; a reader sees the old report or the new one.  An aborted run leaves
nothing.  The path is one that the driver and the executors share.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from harrow.plans.ship import ship

#: Schema tags of reports: a name of the writer's own before it.
TAG = re.compile(r"[\w.-]+/eval-run/v1")
OWN_TAG = "harrow/eval-run/v1"


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    name: str
    counts: dict[str, tuple[int, int]]  # class: results, hits


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = os.path.abspath(options["path"]), overwrite
        self.head = {"schema": options.get("schema", OWN_TAG), "k": int(options.get("k", "5")), "corpus_root": options.get("corpusroot"), "tasks_file": options.get("tasksfile"), "golden_version": options.get("goldenversion")}
        if not TAG.fullmatch(self.head["schema"]):
            raise ValueError(f"{self.head['schema']!r} is no schema tag of a run report")
        self.classes = [c for c in options.get("classes", "").split(",") if c]
        self.parts = f"{self.path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator[Row]) -> _Part:
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.json"
        os.makedirs(self.parts, exist_ok=True)
        counts: dict[str, tuple[int, int]] = {}
        with open(os.path.join(self.parts, name), "w", encoding="utf-8") as f:
            for row in iterator:
                record = row.asDict(recursive=True)
                if not isinstance(record.get("id"), str):
                    raise ValueError("a result has no id")
                n, hit = counts.get(record.get("class"), (0, 0))
                counts[record.get("class")] = n + 1, hit + (record.get("hit") is True)
                f.write(json.dumps(record, ensure_ascii=False) + "\n")
        return _Part(context.partitionId(), name, counts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        counts = {c: [0, 0] for c in self.classes}
        for m in parts:
            for c, (n, hit) in m.counts.items():
                own = counts.setdefault(c, [0, 0])
                own[0] += n
                own[1] += hit
        head = self.head | {"task_count": sum(n for n, _ in counts.values()), "hit_count": sum(h for _, h in counts.values()), "class_counts": {str(c): {"total": n, "hit": h} for c, (n, h) in counts.items()}}
        whole = f"{self.path}.{uuid.uuid4().hex}.tmp"
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        try:
            if os.path.exists(self.path) and not self.overwrite:
                raise FileExistsError(self.path)
            with open(whole, "w", encoding="utf-8") as out:
                out.write(json.dumps(head, ensure_ascii=False, indent=2)[:-2] + ',\n  "results": [')
                between = "\n    "
                for m in parts:
                    with open(os.path.join(self.parts, m.name), encoding="utf-8") as f:
                        for line in f:  # one result at a time
                            out.write(between + line.rstrip("\n"))
                            between = ",\n    "
                out.write("\n  ]\n}\n")
                out.flush()
                os.fsync(out.fileno())
            os.replace(whole, self.path)
        finally:
            shutil.rmtree(self.parts, ignore_errors=True)
            if os.path.exists(whole):
                os.remove(whole)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run-report"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def write_report(results: DataFrame, path: str, k: int = 5, overwrite: bool = True, classes: tuple[str, ...] = (), **facts: str | None) -> None:
    """Write results (id, class, query, hit, rank, ..) as a run report.

    ``facts``: schema, corpusRoot, tasksFile, goldenVersion.  Classes that are named have
    counts even if no result has them.
    """
    spark: SparkSession = results.sparkSession
    ship(spark)
    spark.dataSource.register(ReportSink)
    options = {n: v for n, v in facts.items() if v is not None} | {"path": path, "k": k, "classes": ",".join(classes)}
    results.write.format("run-report").options(**options).mode("overwrite" if overwrite else "append").save()
