import json
from math import comb

import pytest
from pyspark.sql import functions as F

from harrow.operators import evaluation as E
from harrow.operators import traces
from harrow.sources import records

RESULT = "id string, class string, query string, rank int, hit boolean, matched_path string, symbol_hit boolean, returned_paths array<string>, must_not_hit array<string>, token_estimate int"


def result(i, cls, rank, symbol=None, returned=("a", "b", "c"), bad=(), tokens=100):
    return (i, cls, "q", rank, rank is not None and not bad and symbol is not False, "a" if rank else None, symbol, list(returned), list(bad), tokens)


def test_layered_metrics(spark):
    rows = [result("1", "exact", 1), result("2", "exact", 4, tokens=300), result("3", "crossfile", None), result("4", "crossfile", 2, symbol=False), result("5", "crossfile", 1, bad=["c"])]
    got = {(r.bucket, r.k): r for r in E.layered_metrics(spark.createDataFrame(rows, RESULT)).collect()}
    assert got["overall", 5].hits == 2 and got["overall", 1].hits == 2 and got["overall", 5].success == pytest.approx(0.4)
    assert got["exact", 1].hits == 1 and got["exact", 5].hits == 2 and got["exact", 5].high == 1.0
    assert got["overall", 5].mrr == pytest.approx((1 + 0.25) / 5)
    # a forbidden path counts only among the first k
    assert got["crossfile", 1].hits == 1 and got["crossfile", 3].hits == 0 and got["crossfile", 3].low == 0.0
    assert got["natural", 5].total == 0 and got["natural", 5].success is None and got["natural", 5].mrr is None
    assert got["exact", 5].median_tokens == 200


def test_wilson_known_value(spark):
    low, high = E.wilson(F.lit(13), F.lit(43))
    r = spark.range(1).select(low, high).first()
    assert (round(r[0], 3), round(r[1], 3)) == (0.186, 0.451)


def test_diff_and_gate(spark):
    a = spark.createDataFrame([result("1", "exact", 1), result("2", "exact", 2), result("3", "natural", None), result("4", "natural", 3), result("9", "natural", 1)], RESULT)
    b = spark.createDataFrame([result("1", "exact", None), result("2", "exact", 1), result("3", "natural", 5), result("4", "natural", 4), result("8", "natural", 1)], RESULT)
    diff = E.diff_runs(a, b)
    assert {r.id: r.change for r in diff.collect()} == {"1": "regression", "2": "rank_improved", "3": "improvement", "4": "rank_regressed"}
    assert E.change_counts(diff).first().asDict() == {"regression": 1, "improvement": 1, "rank_improved": 1, "rank_regressed": 1, "unchanged": 0}
    assert [r.id for r in E.only_in(a, b).collect()] == ["9"]
    gate = E.gate_diff(diff, waivers=["1", "7"])
    assert gate["passed"] and gate["unused_waivers"] == ["7"] and gate["waived"] == ["1"]
    assert not E.gate_diff(diff)["passed"] and E.gate_diff(diff, max_regressions=1)["passed"]
    assert not E.gate_diff(diff, waivers=["1"], versions=("v1", "v2"))["passed"] and E.version_match("v1", None) is None
    with pytest.raises(ValueError):
        E.gate_diff(diff, max_regressions=-1)


@pytest.mark.parametrize("c,n,k", [(0, 3, 1), (2, 3, 2), (3, 3, 3), (5, 9, 4), (1, 2, 3), (4, 3, 1), (0, 0, 1)])
def test_pass_statistics(spark, c, n, k):
    r = spark.range(1).select(E.pass_at_k(F.lit(c), F.lit(n), k), E.pass_hat_k(F.lit(c), F.lit(n), k)).first()
    if n <= 0 or c > n or k > n:
        assert tuple(r) == (None, None)
    else:
        assert r[0] == pytest.approx(1 - comb(n - c, k) / comb(n, k)) and r[1] == pytest.approx(comb(c, k) / comb(n, k))


def test_ab_gate(spark):
    schema = "case string, trials long, successes long"
    a = spark.createDataFrame([("x", 3, 1), ("y", 3, 3), ("z", 3, 0)], schema)
    b = spark.createDataFrame([("x", 3, 3), ("y", 3, 2), ("w", 3, 0)], schema)
    r = E.ab_gate(a, b).first()
    assert r.cases == 2 and r.regressions == ["y"] and r.met and r.gain == pytest.approx(1 / 6)
    attempts = spark.createDataFrame([("x", 0, 0), ("x", 1, 0), ("x", 0, 2)], "case string, n_failures int, exit_code int")
    got = E.case_results(attempts).first()
    assert got.successes == 1 and got.trials == 3 and got.pass_at_1 == pytest.approx(1 / 3) and got.pass_hat_all == 0.0


def test_trace_fold_and_assertions(spark):
    events = [
        ("tool/call", {"name": "mcp__srv__search", "arguments": '{"q": "pool"}'}),
        ("tool/result", {"id": "1", "text": "found pool.py", "is_error": False}),
        ("step/start", {}),
        ("assistant/message", {"content": [{"type": "text", "text": "first"}], "usage": {"input": 10, "output": 5}}),
        ("tool/call", {"name": "read", "arguments": "{}"}),
        ("tool/result", {"id": "2", "text": "boom", "is_error": True}),
        ("assistant/message", {"content": [{"type": "text", "text": "the answer\nis pool"}], "usage": {"input": 1, "output": True}}),
        ("turn/end", {"reason": {"kind": "done"}}),
    ]
    rows = [("s", i, t, json.dumps(d)) for i, (t, d) in enumerate(events)] + [("cut", 0, "step/start", "{}")]
    folded = traces.fold(spark.createDataFrame(rows, "session string, ord int, type string, data string").repartition(4))
    got = {r.session: r for r in folded.collect()}
    s = got["s"]
    assert [c.name for c in s.calls] == ["search", "read"] and s.final_text == "the answer\nis pool" and s.steps == 1 and s.turn_end == "done" and s.total_tokens == 16 and not s.interrupted
    assert got["cut"].interrupted and got["cut"].calls == [] and got["cut"].final_text == ""
    case = "session string, want_turn_end string, tools_called array<string>, tools_not_called array<string>, tool_args_contains map<string,array<string>>, tool_result_contains array<string>, output_contains array<string>, output_matches array<string>, max_steps int, max_tokens int, no_tool_errors boolean"
    good = ("s", "done", ["search", "read"], ["write"], {"search": ["pool"]}, ["pool.py"], ["answer"], ["^is p"], 1, 16, False)
    bad = ("s", "stop", ["read", "search"], ["read"], {"search": ["x"]}, ["nope"], ["nope"], ["^pool"], 0, 15, True)
    none = ("s", *[None] * 10)
    run = lambda c: folded.join(spark.createDataFrame([c], case), "session").select(traces.failures(folded).alias("f")).first().f
    assert run(good) == [] and run(none) == []
    assert run(bad) == ["turn_end", "tools_called", "tools_not_called", "tool_args_contains", "tool_result_contains", "output_contains", "output_matches", "max_steps", "max_tokens", "no_tool_errors"]


def test_task_states(spark):
    rows = [("a", 1, "running"), ("a", 2, "ready"), ("a", 3, "failed"), ("b", 1, "ready"), ("c", 1, "cancelled"), ("c", 2, "running")]
    got = traces.task_states(spark.createDataFrame(rows, "task string, ord int, state string")).collect()
    assert {r.task: r.state for r in got} == {"a": "ready", "b": "pending", "c": "cancelled"}


def test_records(spark, tmp_path):
    ok = {"id": "L-001", "class": "natural", "query": "where is pool_manager made", "expect_paths": ["src/pool_manager.py"], "added": "2026-02-30"}
    path = tmp_path / "t.jsonl"
    path.write_text(json.dumps(ok) + "\n")
    tasks = records.load_tasks(spark, str(path)).collect()
    problems = records.validate_tasks(tasks, {"src/other.py"})
    assert len(problems) == 3 and any("gives pool_manager away" in p for p in problems)
    for broken in ("\n", "[]\n", json.dumps(ok | {"extra": 1}), json.dumps({k: v for k, v in ok.items() if k != "query"}), json.dumps(ok | {"expect_paths": "x"}), json.dumps(ok | {"expect_paths": []}), "{"):
        path.write_text(broken + "\n" if not broken.endswith("\n") else broken)
        with pytest.raises(records.RecordError):
            records.load_tasks(spark, str(path))
    (tmp_path / "a.json").write_text(json.dumps({"name": "n", "prompt": "p", "assert": {"max_steps": 3}}))
    assert records.load_cases(str(tmp_path))[0]["name"] == "n"
    (tmp_path / "b.json").write_text(json.dumps({"name": "n", "prompt": "p", "assert": {}}))
    with pytest.raises(records.RecordError, match="taken"):
        records.load_cases(str(tmp_path))
    assert records.path_problem("a//b") == "empty segment" and records.path_problem("/a") == "absolute" and records.path_problem("a/b") is None
    assert records.root_log([("x/session.v1.jsonl", None), ("y/session.v1.jsonl", "x")]) == "x/session.v1.jsonl"


def test_session_log_files(spark, tmp_path):
    log = tmp_path / "session.v1.jsonl"
    log.write_text(json.dumps({"version": 1}) + "\n\n" + json.dumps({"type": "turn/end", "data": {"reason": "done"}}) + "\n")
    events = records.session_events(spark, str(log))
    assert traces.fold(events).first().turn_end == "done"
    assert records.session_headers(spark, str(log)).first().version == "1"
