"""Readers of small validated inputs: golden tasks, cases, session logs, run reports.

These are closed-world formats: a field that is unknown, missing or of another type
is an error that names its place.
"""

from __future__ import annotations

import datetime
import json
import pathlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.sources.report_sink import OWN_TAG, TAG

TASK_FIELDS = {"id": str, "class": str, "query": str, "expect_paths": list, "added": str}
TASK_OPTIONAL = {"expect_symbols": list, "must_not_paths": list, "notes": str}
TASKS = "id string, class string, query string, expect_paths array<string>, added string, expect_symbols array<string>, must_not_paths array<string>, notes string"
#: The tag that this package writes; any `<name>/eval-run/v1` is read.
REPORT_SCHEMA = OWN_TAG
REPORT = "id string, class string, query string, hit boolean, rank int, matched_path string, symbol_hit boolean, returned_paths array<string>, must_not_hit array<string>, token_estimate long"
CASE_ASSERTS = {"turn_end": str, "tools_called": list, "tools_not_called": list, "tool_args_contains": dict, "tool_result_contains": list, "output_contains": list, "output_matches": list, "max_steps": int, "max_tokens": int, "no_tool_errors": bool}
CASE_FIELDS = {"name": str, "prompt": str, "assert": dict}
CASE_OPTIONAL = {"tags": list, "answer_paths": list, "notes": str, "accept": list, "reject": list}


class RecordError(ValueError):
    pass


def _check(row: object, required: dict, optional: dict, where: str) -> dict:
    if not isinstance(row, dict):
        raise RecordError(f"{where}: not an object")
    for name in required:
        if name not in row:
            raise RecordError(f"{where}: no field {name!r}")
    for name, value in row.items():
        kind = required.get(name) or optional.get(name)
        if kind is None:
            raise RecordError(f"{where}: unknown field {name!r}")
        if not isinstance(value, kind) or kind is int and isinstance(value, bool):
            raise RecordError(f"{where}: field {name!r} is not of type {kind.__name__}")
        if kind is list and not all(isinstance(x, str) for x in value):
            raise RecordError(f"{where}: field {name!r} holds more than strings")
    return row


def _json(text: str, where: str) -> object:
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise RecordError(f"{where}: {e}") from e


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    rows = []
    for i, line in enumerate(pathlib.Path(path).read_text("utf-8").splitlines(), 1):
        where = f"{path}:{i}"
        if not line.strip():
            raise RecordError(f"{where}: blank line")
        r = _check(_json(line, where), TASK_FIELDS, TASK_OPTIONAL, where)
        if not r["expect_paths"]:
            raise RecordError(f"{where}: expect_paths is empty")
        rows.append((r["id"], r["class"], r["query"], r["expect_paths"], r["added"], r.get("expect_symbols", []), r.get("must_not_paths", []), r.get("notes")))
    return spark.createDataFrame(rows, TASKS)


def load_meta(path: str) -> str:
    version = _check(_json(pathlib.Path(path).read_text("utf-8"), path), {"golden_version": str}, {}, path)["golden_version"]
    if not version.strip():
        raise RecordError(f"{path}: golden_version is empty")
    return version


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """The results of a run report: its schema tag is right and every result has an id; absent fields are null."""
    report = _json(pathlib.Path(path).read_text("utf-8"), path)
    if not isinstance(report, dict):
        raise RecordError(f"{path}: not an object")
    if not isinstance(report.get("schema"), str) or not TAG.fullmatch(report["schema"]):
        raise RecordError(f"{path}: schema is {report.get('schema')!r}, not that of a run report")
    if not isinstance(report.get("results"), list):
        raise RecordError(f"{path}: no list of results")
    names = [f.split()[0] for f in REPORT.split(", ")]
    rows = []
    for i, r in enumerate(report["results"]):
        if not isinstance(r, dict) or not isinstance(r.get("id"), str):
            raise RecordError(f"{path}: result {i} is not an object with an id")
        rows.append(tuple(r.get(n) for n in names))
    try:
        return spark.createDataFrame(rows, REPORT)
    except (TypeError, ValueError) as e:
        raise RecordError(f"{path}: {e}") from e


def load_cases(folder: str) -> list[dict]:
    cases, seen = [], set()
    for path in sorted(pathlib.Path(folder).glob("*.json")):
        case = _check(_json(path.read_text("utf-8"), str(path)), CASE_FIELDS, CASE_OPTIONAL, str(path))
        _check(case["assert"], {}, CASE_ASSERTS, f"{path}: assert")
        if case["name"] in seen:
            raise RecordError(f"{path}: the name {case['name']!r} is taken")
        seen.add(case["name"])
        cases.append(case)
    return cases


def session_events(spark: SparkSession, path: str) -> DataFrame:
    """(session, ord, type, data) of session logs; the first line of a log is its header."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("session"), F.posexplode(F.split("value", "\n")).alias("ord", "line")).filter(F.trim("line") != "")
    event = F.from_json("line", "type string, data string", {"mode": "FAILFAST"})
    return lines.filter("ord > 0").select("session", "ord", event.alias("e")).select("session", "ord", "e.type", "e.data")


def session_headers(spark: SparkSession, path: str) -> DataFrame:
    first = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("session"), F.substring_index("value", "\n", 1).alias("line"))
    return first.select("session", F.from_json("line", "version string, id string, parentSession string").alias("h")).select("session", "h.*")


def root_log(names: list[tuple[str, str | None]]) -> str:
    """The one log that no other session started; names: (path, parent)."""
    logs = [(p, parent) for p, parent in names if re.search(r"session\.v\d+\.jsonl(\.\w+)?$", p)]
    plain = [p for p, parent in logs if p.endswith(".jsonl") and not parent]
    if not plain and logs:
        raise RecordError("session logs are there only in compressed form")
    if len(plain) != 1:
        raise RecordError(f"{len(plain)} root session logs, one is needed")
    return plain[0]


def path_problem(path: str) -> str | None:
    """Why a path is not a clean relative POSIX path."""
    checks = {"absolute": path.startswith("/"), "backslash": "\\" in path, "drive": bool(re.match(r"[A-Za-z]:", path)), "empty segment": "" in path.split("/"), "dot segment": bool({".", ".."} & set(path.split("/")))}
    return next((name for name, bad in checks.items() if bad), None)


def leaks(query: str, path: str) -> list[str]:
    """Forms of the expected path, of four letters at least, that the query gives away."""
    name = path.rsplit("/", 1)[-1]
    forms = dict.fromkeys([path, name, name.rsplit(".", 1)[0]])
    return [f for f in forms if len(f) >= 4 and re.search(rf"(?<![A-Za-z0-9_]){re.escape(f)}(?![A-Za-z0-9_])", query, re.I)]


def validate_tasks(tasks: list, known_paths: set[str], classes: tuple[str, ...] = ("exact", "crossfile", "natural")) -> list[str]:
    """Every problem of a task set."""
    problems, seen = [], set()
    for t in tasks:
        if not re.fullmatch(r"L-\d{3}", t["id"]):
            problems.append(f"{t['id']}: id is not L-nnn")
        if t["id"] in seen:
            problems.append(f"{t['id']}: id is taken")
        seen.add(t["id"])
        if t["class"] not in classes:
            problems.append(f"{t['id']}: unknown class {t['class']}")
        try:
            datetime.date.fromisoformat(t["added"])
        except ValueError:
            problems.append(f"{t['id']}: {t['added']} is not a date")
        both = set(t["expect_paths"]) & set(t["must_not_paths"] or [])
        problems += [f"{t['id']}: {p} is expected and forbidden" for p in sorted(both)]
        for p in t["expect_paths"]:
            if why := path_problem(p):
                problems.append(f"{t['id']}: {p}: {why}")
            elif p not in known_paths:
                problems.append(f"{t['id']}: {p} is not in the corpus")
            if t["class"] == "natural":
                problems += [f"{t['id']}: the query gives {x} away" for x in leaks(t["query"], p)]
    return problems
