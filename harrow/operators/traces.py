"""Session traces: folding event logs, assertions, task states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.text import tool_name


def fold(events: DataFrame) -> DataFrame:
    """One row for each session of (session, ord, type, data), data being JSON text.

    Event types: tool/call, tool/result, assistant/message, step/start, turn/end.
    """
    get = lambda path: F.get_json_object("data", path)
    blocks = F.from_json(get("$.content"), "array<struct<type:string,text:string>>")
    text = F.coalesce(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), ""), get("$.text"))
    number = lambda path: F.coalesce(F.regexp_extract(get(path), r"^-?\d+$", 0).try_cast("long"), F.lit(0))
    kind = F.coalesce(get("$.reason.kind"), get("$.reason"), get("$.kind"))
    is_ = lambda t: F.col("type") == t
    ordered = lambda cond, *cols: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", *cols)))), lambda x: x.dropFields("ord"))
    return events.withColumns({"_text": text, "_kind": kind, "_in": number("$.usage.input"), "_out": number("$.usage.output")}).groupBy("session").agg(
        ordered(is_("tool/call"), tool_name(get("$.name")).alias("name"), F.coalesce(get("$.arguments"), F.lit("")).alias("arguments")).alias("calls"),
        ordered(is_("tool/result"), get("$.id").alias("id"), F.coalesce(get("$.text"), F.lit("")).alias("text"), (F.coalesce(get("$.is_error"), F.lit("false")) == "true").alias("is_error")).alias("results"),
        F.coalesce(F.max_by("_text", F.when(is_("assistant/message") & (F.coalesce("_text", F.lit("")) != ""), F.col("ord"))), F.lit("")).alias("final_text"),
        F.count(F.when(is_("step/start"), 1)).alias("steps"),
        F.max_by("_kind", F.when(is_("turn/end"), F.col("ord"))).alias("turn_end"),
        F.sum(F.when(is_("assistant/message"), F.col("_in") + F.col("_out")).otherwise(0)).alias("total_tokens"),
        (F.count(F.when(is_("turn/end"), 1)) == 0).alias("interrupted"),
    )


def is_subsequence(actual: Column, expected: Column) -> Column:
    """Does ``expected`` stand inside ``actual`` in order, gaps allowed?"""
    reached = F.aggregate(actual, F.lit(0), lambda at, x: F.when((at < F.size(expected)) & (F.get(expected, at) == x), at + 1).otherwise(at))
    return reached == F.size(expected)


def failures(traces: DataFrame) -> Column:
    """The names of failed assertions of a trace joined with its case.

    Case columns, null or empty where nothing is asked: want_turn_end, tools_called,
    tools_not_called, tool_args_contains (map), tool_result_contains, output_contains,
    output_matches, max_steps, max_tokens, no_tool_errors.
    """
    names = F.transform("calls", lambda c: c["name"])
    list_ = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    final = F.col("final_text")

    def args_missing(tool: Column, needles: Column) -> Column:
        own = F.filter("calls", lambda c: c["name"] == tool)
        return ~F.exists(own, lambda c: F.forall(needles, lambda n: c["arguments"].contains(n)))

    spec = F.coalesce(F.map_entries("tool_args_contains"), F.array().cast("array<struct<key:string,value:array<string>>>"))
    checks = {
        "turn_end": F.col("want_turn_end").isNotNull() & ~F.col("turn_end").eqNullSafe(F.col("want_turn_end")),
        "tools_called": (F.size(list_("tools_called")) > 0) & ~is_subsequence(names, list_("tools_called")),
        "tools_not_called": F.size(F.array_intersect(names, list_("tools_not_called"))) > 0,
        "tool_args_contains": F.exists(spec, lambda e: args_missing(e["key"], e["value"])),
        "tool_result_contains": F.exists(list_("tool_result_contains"), lambda n: ~F.exists("results", lambda r: r["text"].contains(n))),
        "output_contains": F.exists(list_("output_contains"), lambda n: ~final.contains(n)),
        "output_matches": F.exists(list_("output_matches"), lambda p: ~F.regexp_like(final, F.concat(F.lit("(?m)"), p))),
        "max_steps": F.coalesce(F.col("steps") > F.col("max_steps"), F.lit(False)),
        "max_tokens": F.coalesce(F.col("total_tokens") > F.col("max_tokens"), F.lit(False)),
        "no_tool_errors": F.coalesce(F.col("no_tool_errors"), F.lit(False)) & F.exists("results", lambda r: r["is_error"]),
    }
    return F.filter(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks.items()]), lambda x: x.isNotNull())


#: Which task states may follow which.
TRANSITIONS = {"pending": ("running", "cancelled"), "running": ("ready", "failed", "cancelled"), "ready": (), "failed": (), "cancelled": ()}


def task_states(events: DataFrame) -> DataFrame:
    """The state of each task after its last permitted transition (task, ord, state)."""
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for pair in TRANSITIONS.items() for x in pair])
    path = F.transform(F.array_sort(F.collect_list(F.struct("ord", "state"))), lambda e: e["state"])
    step = lambda now, nxt: F.when(F.array_contains(F.element_at(allowed, now), nxt), nxt).otherwise(now)
    return events.groupBy("task").agg(path.alias("path")).select("task", F.aggregate("path", F.lit("pending"), step).alias("state"))


def sessions(events: DataFrame, gap_seconds: int, by: str = "user_id", at: str = "ts") -> DataFrame:
    """Sessions of each key: (key, session, start, end, n); a gap longer than given starts a new one."""
    w = Window.partitionBy(by).orderBy(at)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.when(micros - F.lag(micros).over(w) > gap_seconds * 1_000_000, 1).otherwise(0)
    x = events.select(by, at).withColumn("_new", new).withColumn("session", F.sum("_new").over(w))
    return x.groupBy(by, "session").agg(F.min(at).alias("start_ts"), F.max(at).alias("end_ts"), F.count("*").alias("n"))
