"""Markdown of runs, of the difference of two runs, and of gates, for people to read.

Inputs are as long as a golden set; they are collected here and nowhere before.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators import evaluation

#: Sections of a difference, worst first, and the kinds of change in each.
SECTIONS = (("Regressions", ("regression",)), ("Improvements", ("improvement",)), ("Changes of rank", ("rank_regressed", "rank_improved")))


def cell(value: object) -> str:
    """A value inside a table: no line breaks, no bars."""
    if value is None:
        return "-"
    if isinstance(value, float):
        return f"{value:.3f}"
    return str(value).replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def table(columns: Iterable[str], rows: Iterable[Iterable[object]]) -> list[str]:
    columns = list(columns)
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""]


def outcome(hit: bool | None, rank: int | None, path: str | None) -> str:
    return f"hit #{rank} ({path})" if hit else "miss"


def render_run(results: DataFrame, k: int = 5, title: str = "Run") -> str:
    """Success@k and MRR by class, then each result."""
    layers = evaluation.layered_metrics(results, (k,), k).collect()
    rows = results.select("id", "class", "hit", "rank", "matched_path", "query").orderBy("id").collect()
    columns = layers[0].__fields__ if layers else []
    lines = [f"# {title}", "", f"{len(rows)} tasks, k = {k}.", "", *table(columns, layers), "## Results", ""]
    return "\n".join(lines + table(("id", "class", "outcome", "query"), ((r["id"], r["class"], outcome(r["hit"], r["rank"], r["matched_path"]), r["query"]) for r in rows)))


def render_diff(baseline: DataFrame, current: DataFrame, waivers: Iterable[str] = (), max_regressions: int = 0, versions: tuple[str | None, str | None] = (None, None)) -> str:
    """What changed between two runs, and whether the gate lets it pass."""
    diff = evaluation.diff_runs(baseline, current).cache()
    try:
        verdict = evaluation.gate_diff(diff, waivers, max_regressions, versions)
        counts = evaluation.change_counts(diff).first().asDict()
        rates = evaluation.hit_rates(diff).orderBy(F.col("bucket") != "overall", "bucket").collect()
        rows = diff.orderBy("id").collect()
        gone = [r["id"] for r in evaluation.only_in(baseline, current).orderBy("id").collect()]
        new = [r["id"] for r in evaluation.only_in(current, baseline).orderBy("id").collect()]
    finally:
        diff.unpersist()
    same = evaluation.version_match(*versions)
    said = {True: "the same golden version", False: "DIFFERENT golden versions", None: "golden versions not both known"}[same]
    lines = ["# Difference of two runs", "", f"{len(rows)} tasks in both, {said}.", "", *table(("bucket", "tasks", "baseline", "current", "delta"), rates), *table(counts, [counts.values()])]
    lines += [f"Only in the {side} run: {', '.join(ids)}" for side, ids in (("baseline", gone), ("current", new)) if ids]
    side = lambda r, s: outcome(r[f"{s}_hit"], r[f"{s}_rank"], r[f"{s}_path"])
    for title, kinds in SECTIONS:
        own = [r for r in rows if r["change"] in kinds]
        if own:
            lines += [f"## {title}", "", *(f"- **{r['id']}** ({r['class']}): {side(r, 'baseline')} → {side(r, 'current')} | {cell(r['query'])}" for r in own), ""]
    lines += ["## Verdict", "", *(f"- {name}: {cell(value)}" for name, value in verdict.items()), "", "## All tasks", ""]
    return "\n".join(lines + table(("id", "class", "baseline", "current", "change"), ((r["id"], r["class"], side(r, "baseline"), side(r, "current"), r["change"]) for r in rows)))


def render_gate(baseline: DataFrame, current: DataFrame, least_gain: float = 0.10) -> str:
    """Two arms of attempts by case: rates, the gain, cases that got worse."""
    verdict = evaluation.ab_gate(baseline, current, least_gain).first().asDict()
    b = baseline.select("case", F.col("successes").alias("bs"), F.col("trials").alias("bt"))
    rows = b.join(current.select("case", F.col("successes").alias("cs"), F.col("trials").alias("ct")), "case", "full_outer").orderBy("case").collect()
    share = lambda s, t: "-" if t is None else f"{s}/{t}"
    lines = ["# Gate", "", *(f"- {name}: {cell(value)}" for name, value in verdict.items()), ""]
    return "\n".join(lines + table(("case", "baseline", "current"), ((r["case"], share(r["bs"], r["bt"]), share(r["cs"], r["ct"])) for r in rows)))


def render_status(status: dict) -> str:
    """The state of a workspace's index, one line for each fact."""
    if not status.get("ready"):
        return "not indexed"
    return "\n".join(f"{name}: {', '.join(f'{k} {v}' for k, v in sorted(value.items())) or '-' if isinstance(value, dict) else value}" for name, value in status.items())
