"""The report sink and its renders, the task-set validator, task states on a stream."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from harrow.operators import traces, validate
from harrow.operators.validate import violations
from harrow.plans import reports
from harrow.sources.records import REPORT, RecordError, load_report
from harrow.sources.report_sink import write_report
from harrow.streaming.task_states import PROVIDER, task_state_stream

RESULTS = [("L-001", "exact", "where is | a", True, 1, "src/a.py", True, ["src/a.py"], [], 12), ("L-002", "natural", "zwei\nlines", False, None, None, None, [], ["tests/x.py"], 0), ("L-003", "exact", "数据", True, 3, "src/b.py", None, ["q", "r", "src/b.py"], [], 90)]


def test_report_comes_back_equal(spark, tmp_path):
    path = str(tmp_path / "runs/report.json")
    results = spark.createDataFrame(RESULTS, REPORT)
    write_report(results.repartition(3).sortWithinPartitions("id"), path, 3, classes=("exact", "crossfile", "natural"), goldenVersion="g1", corpusRoot="/c")
    assert sorted(map(tuple, load_report(spark, path).collect())) == sorted(map(tuple, results.collect()))
    report = json.loads(open(path, encoding="utf-8").read())
    assert report["k"] == 3 and report["task_count"] == 3 and report["hit_count"] == 2 and report["golden_version"] == "g1"
    assert report["class_counts"] == {"exact": {"total": 2, "hit": 2}, "crossfile": {"total": 0, "hit": 0}, "natural": {"total": 1, "hit": 0}}
    write_report(results.orderBy("id"), path)
    assert [r["id"] for r in json.loads(open(path, encoding="utf-8").read())["results"]] == ["L-001", "L-002", "L-003"]
    write_report(results.limit(0), str(tmp_path / "none.json"))
    assert load_report(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(Exception, match="FileExists|exists"):
        write_report(results, path, overwrite=False)
    report["schema"] = "someone/eval-run/v1"
    (tmp_path / "other.json").write_text(json.dumps(report))
    assert load_report(spark, str(tmp_path / "other.json")).count() == 3
    (tmp_path / "other.json").write_text(json.dumps(report | {"schema": "someone/eval-run/v2"}))
    with pytest.raises(RecordError):
        load_report(spark, str(tmp_path / "other.json"))


def test_an_aborted_report_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "report.json")
    results = spark.createDataFrame(RESULTS, REPORT)
    write_report(results, path)
    before = open(path, encoding="utf-8").read()
    with pytest.raises(Exception, match="no id"):
        write_report(results.withColumn("id", F.when(F.col("id") != "L-003", F.col("id"))).repartition(3), path)
    assert open(path, encoding="utf-8").read() == before and os.listdir(tmp_path) == ["report.json"]


def test_renders(spark):
    now = spark.createDataFrame([(*r[:3], not r[3], 2 if not r[3] else None, "src/n.py", *r[6:]) for r in RESULTS] + [("L-009", "exact", "new", True, 1, "p", None, ["p"], [], 1)], REPORT)
    was = spark.createDataFrame(RESULTS, REPORT)
    text = reports.render_diff(was, now, versions=("1", "2"))
    assert text.index("## Regressions") < text.index("## Improvements") < text.index("## Verdict") and "DIFFERENT" in text
    assert "- **L-001** (exact): hit #1 (src/a.py) → miss | where is \\| a" in text and "Only in the current run: L-009" in text
    for line in text.splitlines():
        if line.startswith("| L-"):
            assert len(re.findall(r"(?<!\\)\|", line)) == 6
    run = reports.render_run(was, 3)
    assert "3 tasks, k = 3." in run and "| L-002 | natural | miss | zwei lines |" in run
    arms = [spark.createDataFrame([("a", s, 3), ("b", 1, 3)], "case string, successes int, trials int") for s in (1, 3)]
    gate = reports.render_gate(*arms)
    assert "| a | 1/3 | 3/3 |" in gate and "- cases: 2" in gate
    assert reports.render_status({"ready": False}) == "not indexed" and "skipped: big 2, odd 1" in reports.render_status({"ready": True, "skipped": {"odd": 1, "big": 2}})


TASKS = "id string, class string, query string, expect_paths array<string>, must_not_paths array<string>, expect_symbols array<string>"


def test_violations(spark):
    texts = spark.createDataFrame([("src/alpha.py", "def load_alpha(): pass"), ("src/alpha.py", "tail of it"), ("src/beta.ts", None), ("x/Q\\E.py", "")], "path string, text string")
    tasks = [
        ("L-001", "exact", "find load_alpha", ["src/alpha.py"], [], []),
        ("L-002", "exact", "no such_name", ["src/alpha.py", "src/beta.ts"], ["src/beta.ts"], None),
        ("L-002", "natural", "how is tail read", ["src/alpha.py"], [], ["reader"]),
        ("L-003", "natural", "what does Alpha.py do", ["src/alpha.py"], ["../up.py"], []),
        ("L-004", "odd", "the reader of alphabets", ["/abs//x.py", "C:\\x"], None, ["Reader"]),
        ("L-005", "exact", "数据", ["src/gone.py"], [], []),
    ]
    found = violations(spark.createDataFrame(tasks, TASKS), texts)
    got = sorted((r.check, str(r.id), r.detail) for r in found.collect())
    want = [
        ("exact_identifier", "L-002", "such_name"), ("exact_identifier", "L-005", ""), ("expected_and_forbidden", "L-002", "src/beta.ts"),
        ("natural_identifier", "L-002", "tail"), ("path_format", "L-003", "../up.py: dot segment"), ("path_format", "L-004", "/abs//x.py: absolute"), ("path_format", "L-004", "C:\\x: backslash"),
        ("path_missing", "L-003", "../up.py"), ("path_missing", "L-004", "/abs//x.py"), ("path_missing", "L-004", "C:\\x"), ("path_missing", "L-005", "src/gone.py"),
        ("query_leak", "L-003", "alpha"), ("query_leak", "L-003", "alpha.py"), ("query_leak", "L-004", "Reader"),
        ("ratio", "None", "crossfile: 0"), ("ratio", "None", "exact: 3"), ("repeated_id", "L-002", "2"), ("too_few", "None", "6"), ("unknown_class", "L-004", "odd"),
    ]
    assert got == sorted(want)
    assert {r.check: (r.violations, r.tasks) for r in validate.summary(found).collect()}["path_format"] == (3, 2)
    fine = [(f"L-{i:03d}", c, "find load_alpha" if c == "exact" else "wie geht das", ["src/alpha.py"], [], []) for i, c in enumerate(["exact"] * 12 + ["crossfile"] * 11 + ["natural"] * 20)]
    assert violations(spark.createDataFrame(fine, TASKS), texts).isEmpty()
    assert violations(spark.createDataFrame([], TASKS), texts).filter("check != 'too_few'").isEmpty()


def test_stream_of_task_states(spark, tmp_path):
    r = random.Random(8)
    events = []
    for i in range(12):
        path = r.choice([["running", "ready"], ["running", "failed", "ready"], ["ready", "running", "cancelled"], ["cancelled", "running"], ["running"], ["odd", "running", "running", "ready"]])
        events += [(f"t{i}", o, s, 1_000_000 + 60 * i + o) for o, s in enumerate(path)]
    r.shuffle(events)  # out of order
    events.append(events[0])  # repeated
    schema = "task string, ord long, state string, at long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).select("task", "ord", "state", F.timestamp_seconds("at").alias("ts"))
        query = task_state_stream(stream, 600, "1 hour").writeStream.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out))
        query.outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    try:
        third = len(events) // 3
        for lo in range(0, len(events), third):  # every run restarts from the checkpoint
            run(events[lo : lo + third])
        latest = spark.read.parquet(out).groupBy("task").agg(F.max_by("state", "batch").alias("state"), F.max_by("stale", "batch").alias("stale"))
        want = {x.task: x.state for x in traces.task_states(spark.createDataFrame([e[:3] for e in events], "task string, ord long, state string")).collect()}
        assert {x.task: x.state for x in latest.collect()} == want
        run([("last", 0, "running", 2_000_000)])
        run([("last", 1, "ready", 2_000_001)])  # the watermark has passed the silent tasks by now
        stale = {x.task: x.state for x in spark.read.parquet(out).filter("stale").collect()}
        assert stale and stale == {t: s for t, s in want.items() if traces.TRANSITIONS[s]}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="providerClass"):
        task_state_stream(spark.createDataFrame([], "task string, ord long, state string, ts timestamp"))
