"""Measures of retrieval runs, comparison of runs, gates, attribution of failures."""

from __future__ import annotations

import math
from collections.abc import Iterable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.text import edge_tokens, py_tokens, suffix
from harrow.operators import lexical
from harrow.operators.paths import extensions

#: Hits of the wider search that tells a low rank from a miss.
PROBE_K = 50
CLASSES = ("exact", "crossfile", "natural")
CHANGES = ("regression", "improvement", "rank_improved", "rank_regressed", "unchanged")


def is_hit_at(k: int) -> Column:
    """A result (rank, symbol_hit, must_not_hit, returned_paths) counts at ``k``.

    The rank is one of relevance; forbidden paths are looked for among the first
    ``k`` returned paths.
    """
    forbidden = F.exists(F.slice(F.col("returned_paths"), 1, k), lambda p: F.array_contains(F.col("must_not_hit"), p))
    return F.coalesce(F.col("rank") <= k, F.lit(False)) & F.coalesce(F.col("symbol_hit"), F.lit(True)) & ~F.coalesce(forbidden, F.lit(False))


def z_of(confidence: float) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def wilson(hits: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval; null without trials, exact at 0 and 1."""
    z = z_of(confidence)
    p, z2 = hits / total, z * z
    middle = (p + z2 / (2 * total)) / (1 + z2 / total)
    half = z / (1 + z2 / total) * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total))
    low = F.when(total > 0, F.when(hits == 0, F.lit(0.0)).otherwise(F.greatest(middle - half, F.lit(0.0))))
    high = F.when(total > 0, F.when(hits == total, F.lit(1.0)).otherwise(F.least(middle + half, F.lit(1.0))))
    return low, high


def layered_metrics(results: DataFrame, ks: Iterable[int] = (1, 3, 5, 10), k: int = 5, classes: Iterable[str] = CLASSES, confidence: float = 0.95) -> DataFrame:
    """One row for each bucket ('overall', then each class) and k; empty buckets are null, not 0."""
    spark = results.sparkSession
    ks = sorted({*ks, k})
    x = results
    for i in ks:
        x = x.withColumn(f"hit{i}", F.when(is_hit_at(i), 1).otherwise(0))
    sums = [F.sum(f"hit{i}").alias(f"h{i}") for i in ks]
    mrr = F.avg(F.when(F.col(f"hit{k}") == 1, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr")
    grouped = x.groupingSets([[], ["class"]], "class").agg(F.grouping("class").alias("_all"), F.count("*").alias("total"), *sums, mrr, F.median("token_estimate").alias("median_tokens"))
    grouped = grouped.withColumn("bucket", F.when(F.col("_all") == 1, "overall").otherwise(F.col("class")))
    names = spark.createDataFrame([(b, i) for i, b in enumerate(["overall", *classes])], "bucket string, ord int")
    wide = names.join(grouped.drop("class", "_all"), "bucket", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    long = wide.select("bucket", "ord", "total", "mrr", "median_tokens", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"h{i}").alias("hits")) for i in ks])).alias("m")).select("*", "m.k", "m.hits").drop("m")
    low, high = wilson(F.col("hits"), F.col("total"), confidence)
    rate = F.when(F.col("total") > 0, F.col("hits") / F.col("total"))
    return long.select("bucket", "ord", "k", "total", F.coalesce("hits", F.lit(0)).alias("hits"), rate.alias("success"), low.alias("low"), high.alias("high"), F.when(F.col("total") > 0, F.col("mrr")).alias("mrr"), "median_tokens")


def change() -> Column:
    """How a task's outcome changed; columns baseline_hit, current_hit, baseline_rank, current_rank."""
    was, now = F.col("baseline_hit"), F.col("current_hit")
    return (
        F.when(was & ~now, "regression")
        .when(now & ~was, "improvement")
        .when(was & now & (F.col("current_rank") < F.col("baseline_rank")), "rank_improved")
        .when(was & now & (F.col("current_rank") > F.col("baseline_rank")), "rank_regressed")
        .otherwise("unchanged")
    )


def diff_runs(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Tasks of both runs, side by side; in: id, class, query, hit, rank, matched_path."""
    b = baseline.select("id", "class", "query", F.col("hit").alias("baseline_hit"), F.col("rank").alias("baseline_rank"), F.col("matched_path").alias("baseline_path"))
    c = current.select("id", F.col("hit").alias("current_hit"), F.col("rank").alias("current_rank"), F.col("matched_path").alias("current_path"))
    return b.join(c, "id").withColumn("change", change())


def only_in(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).subtract(b.select(key))


def change_counts(diff: DataFrame) -> DataFrame:
    """One row, a column for each kind of change, zeros kept."""
    return diff.agg(*[F.count(F.when(F.col("change") == c, 1)).alias(c) for c in CHANGES])


def hit_rates(diff: DataFrame) -> DataFrame:
    """Hit rates of both runs over the compared tasks, overall and by class, and their difference."""
    rate = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    x = diff.groupingSets([[], ["class"]], "class").agg(F.grouping("class").alias("g"), F.count("*").alias("total"), rate("baseline_hit").alias("baseline"), rate("current_hit").alias("current"))
    return x.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("class")).alias("bucket"), "total", "baseline", "current", (F.col("current") - F.col("baseline")).alias("delta"))


def version_match(baseline: str | None, current: str | None) -> bool | None:
    """None where either side does not say its version."""
    return None if not baseline or not current else baseline == current


def gate_diff(diff: DataFrame, waivers: Iterable[str] = (), max_regressions: int = 0, versions: tuple[str | None, str | None] = (None, None)) -> dict:
    """Pass or fail by the number of regressions that no waiver covers."""
    if max_regressions < 0:
        raise ValueError("max_regressions must not be negative")
    # a run has as many rows as there are golden tasks
    regressed = [r["id"] for r in diff.filter("change = 'regression'").select("id").orderBy("id").collect()]
    waived = set(waivers)
    active = [i for i in regressed if i not in waived]
    match = version_match(*versions)
    reasons = ["golden versions differ"] * (match is False) + [f"{len(active)} regressions, {max_regressions} allowed"] * (len(active) > max_regressions)
    return {"regressions": len(regressed), "active": active, "waived": [i for i in regressed if i in waived], "unused_waivers": sorted(waived - set(regressed)), "version_match": match, "reasons": reasons, "passed": not reasons}


def collect_evidence(results: DataFrame, tasks: DataFrame, on_disk: DataFrame, files: DataFrame, postings: DataFrame, lengths: DataFrame, k: int = 5, probe_k: int = PROBE_K, extra: tuple[str, ...] = ()) -> DataFrame:
    """What ``attribution_code`` needs of each result that is no hit at ``k``: its columns, by id and class.

    Results are those of a run (id, class, rank, symbol_hit, must_not_hit,
    returned_paths), tasks a golden set (id, query, expect_paths); results without a
    task are passed over.  ``on_disk`` (path) are the files of the workspace, ``files``
    (path), postings and lengths those of the snapshot.
    """
    spark = results.sparkSession
    symbol = F.coalesce(~F.col("symbol_hit"), F.lit(False)).alias("symbol_missing")
    failed = results.filter(~is_hit_at(k)).select("id", "class", symbol, F.col("must_not_hit").alias("must_not_hits")).join(tasks.select("id", "query", "expect_paths"), "id")
    marked = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    state = failed.select("id", F.explode("expect_paths").alias("path")).distinct().join(marked(on_disk, "there"), "path", "left").join(marked(files, "held"), "path", "left")
    state = state.withColumn("state", F.when(F.col("there").isNull(), "missing").when(~suffix(F.col("path")).isin(extensions(extra)), "non_code").when(F.col("held"), "indexed").otherwise("unindexed"))
    listed = lambda n: F.array_sort(F.collect_list(F.when(F.col("state") == n, F.col("path")))).alias(f"{n}_paths")
    by_path = state.groupBy("id").agg(*[listed(n) for n in ("missing", "non_code", "indexed", "unindexed")])
    # a golden set: its failed queries and their tokens
    resolvable = state.filter("state IN ('indexed', 'unindexed')").select("id").distinct()
    asked = {r["id"]: r["query"] for r in failed.join(resolvable, "id").select("id", "query").collect()}
    probe = lexical.search_many(postings, lengths, asked, probe_k).withColumnRenamed("query_id", "id")
    probe = probe.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("path", "start_line", "chunk_id")))
    probe = probe.join(state.select("id", "path"), ["id", "path"], "left_semi").groupBy("id").agg(F.min("at").alias("probe_rank"))
    said = failed.select("id", F.explode(edge_tokens(F.col("query"))).alias("token"))
    phrases = [(r["token"], 0, lexical.Rung((tuple(py_tokens(r["token"])),), False)) for r in said.select("token").distinct().collect()]
    where = lexical.phrase_counts(postings, lexical.phrase_table(spark, phrases)).select(F.col("query_id").alias("token"), "chunk_id")
    where = where.join(lengths.select("chunk_id", "path"), "chunk_id").select("token", "path").distinct()
    seen = said.join(state.filter("state = 'indexed'").select("id", "path"), "id").join(where, ["token", "path"], "left_semi").select("id", "token").distinct().withColumn("seen", F.lit(True))
    met = F.col("seen").isNotNull()
    by_token = said.join(seen, ["id", "token"], "left").groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(c, F.col("token")))).alias(f"tokens_{n}") for n, c in (("present", met), ("missing", ~met))])
    total = files.agg(F.count("*").alias("index_file_count"))
    out = failed.drop("query", "expect_paths").join(by_path, "id", "left").join(probe, "id", "left").join(by_token, "id", "left")
    return out.crossJoin(F.broadcast(total))


def attribute_run(results: DataFrame, tasks: DataFrame, on_disk: DataFrame, files: DataFrame, postings: DataFrame, lengths: DataFrame, k: int = 5, probe_k: int = PROBE_K, extra: tuple[str, ...] = ()) -> DataFrame:
    """The evidence of each failed result, and its ``code``."""
    return collect_evidence(results, tasks, on_disk, files, postings, lengths, k, probe_k, extra).withColumn("code", attribution_code())


def attribution_code() -> Column:
    """Why a task failed, by fixed precedence.

    Columns: must_not_hits, probe_rank, symbol_missing, indexed_paths, index_file_count,
    missing_paths, non_code_paths, tokens_present, tokens_missing.
    """
    n = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    return (
        F.when(n("must_not_hits") > 0, "A4")
        .when(F.col("probe_rank").isNotNull(), "A4")
        .when(F.col("symbol_missing") & (n("indexed_paths") > 0), "A4")
        .when(F.col("index_file_count") == 0, "A6")
        .when((n("indexed_paths") == 0) & (n("missing_paths") + n("non_code_paths") > 0), "A7")
        .when(n("indexed_paths") == 0, "A2")
        .when(n("tokens_present") + n("tokens_missing") == 0, "A1")
        .when(n("tokens_present") == 0, "A5")
        .when(n("tokens_missing") > 0, "A1")
        .otherwise("A3")
    )


def attribution_distribution(codes: DataFrame) -> DataFrame:
    """(bucket, code, n) overall and by class; only codes that occur."""
    x = codes.groupingSets([["code"], ["class", "code"]], "class", "code").agg(F.grouping("class").alias("g"), F.count("*").alias("n"))
    return x.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("class")).alias("bucket"), "code", "n")


def natural_a5_share(codes: DataFrame) -> DataFrame:
    """Share of A5 among failures of the class 'natural'; null when there are none."""
    return codes.filter("class = 'natural'").agg(F.avg(F.when(F.col("code") == "A5", 1.0).otherwise(0.0)).alias("share"))


def _comb_ratio(top: Column, n: Column, k: int) -> Column:
    """C(top, k) / C(n, k) as a product of k ratios, 0 where top < k."""
    ratio = F.lit(1.0)
    for i in range(k):
        ratio = ratio * (top - i) / (n - i)
    return F.when(top < k, 0.0).otherwise(ratio)


def pass_at_k(successes: Column, trials: Column, k: int) -> Column:
    """Chance that one of k attempts drawn without repeats succeeds; null where undefined."""
    valid = (trials > 0) & (successes >= 0) & (successes <= trials) & (k <= trials) & F.lit(k > 0)
    return F.when(valid, 1.0 - _comb_ratio(trials - successes, trials, k))


def pass_hat_k(successes: Column, trials: Column, k: int) -> Column:
    """Chance that all of k attempts drawn without repeats succeed; null where undefined."""
    valid = (trials > 0) & (successes >= 0) & (successes <= trials) & (k <= trials) & F.lit(k > 0)
    return F.when(valid, _comb_ratio(successes, trials, k))


def case_results(attempts: DataFrame) -> DataFrame:
    """(case, trials, successes, pass_at_1, pass_hat_all) of attempts (case, n_failures, exit_code)."""
    passed = F.when((F.col("n_failures") == 0) & (F.col("exit_code") == 0), 1).otherwise(0)
    x = attempts.groupBy("case").agg(F.count("*").alias("trials"), F.sum(passed).alias("successes"))
    every = F.when(F.col("successes") == F.col("trials"), 1.0).otherwise(0.0)  # C(c, n) / C(n, n)
    return x.withColumn("pass_at_1", pass_at_k(F.col("successes"), F.col("trials"), 1)).withColumn("pass_hat_all", every)


def group_rate(cases: DataFrame) -> DataFrame:
    return cases.agg(F.try_divide(F.sum("successes"), F.sum("trials")).alias("rate"))


def ab_gate(baseline: DataFrame, current: DataFrame, least_gain: float = 0.10) -> DataFrame:
    """One row: rates of both arms over common cases, gain, whether it is enough, cases that got worse."""
    b = baseline.select("case", F.col("successes").alias("bs"), F.col("trials").alias("bt"))
    c = current.select("case", F.col("successes").alias("cs"), F.col("trials").alias("ct"))
    both = b.join(c, "case")
    worse = F.col("cs") / F.col("ct") < F.col("bs") / F.col("bt")
    x = both.agg(F.count("*").alias("cases"), F.try_divide(F.sum("bs"), F.sum("bt")).alias("baseline"), F.try_divide(F.sum("cs"), F.sum("ct")).alias("current"), F.sort_array(F.collect_list(F.when(worse, F.col("case")))).alias("regressions"))
    gain = F.col("current") - F.col("baseline")
    return x.withColumn("gain", gain).withColumn("met", F.coalesce(gain >= least_gain - 1e-12, F.lit(False)))


def best_rank(returned: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, rank, matched_path): the first returned path (id, rank, path) that is expected (id, path)."""
    met = returned.join(expected, ["id", "path"], "left_semi")
    return met.groupBy("id").agg(F.min("rank").alias("rank"), F.min_by("path", "rank").alias("matched_path"))


def median_of(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.median(column).alias("median"))


def running_islands(lines: DataFrame, by: list[str], order: str, blank: Column) -> DataFrame:
    """Number maximal runs of lines that are not blank."""
    w = Window.partitionBy(*by).orderBy(order)
    return lines.withColumn("island", F.sum(F.when(blank, 1).otherwise(0)).over(w)).filter(~blank)


assert math.isclose(z_of(0.95), 1.959963984540054)
