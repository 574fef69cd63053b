"""Constraints of a task set as queries: one row (check, id, detail) for each violation.

``tasks`` (id, class, query, expect_paths, must_not_paths, expect_symbols), ``texts``
(path, text) of the corpus, one row or several for a path.  Tasks are few, the corpus is
not: it is joined on the paths that tasks name, so texts of other files are not read
further than that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a golden set is held to.
RATIO = {"exact": 12, "crossfile": 11, "natural": 20}
RATIO_SLACK = 1.0
LEAST_TASKS = 10
IDENTIFIER = r"([A-Za-z_][A-Za-z0-9_]{2,})"
#: Letters that a piece of a path needs before a query can give it away.
LEAK_LETTERS = 4


def path_fault(path: Column) -> Column:
    """Why a path is not relative and clean, or null."""
    parts = F.split(path, "/", -1)
    return (
        F.when(path.startswith("/"), "absolute")
        .when(path.contains("\\"), "backslash")
        .when(path.rlike("^[A-Za-z]:"), "drive")
        .when(F.arrays_overlap(parts, F.array(F.lit("."), F.lit(".."))), "dot segment")
        .when(F.array_contains(parts, ""), "empty segment")
    )


def mentions(query: Column, piece: Column) -> Column:
    """Does the piece stand in the query as a whole token, in either case?"""
    return F.regexp_like(query, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), F.replace(piece, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![A-Za-z0-9_])")))


def _row(rows: DataFrame, check: str, detail: Column | str) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.col("id").alias("id"), (F.col(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def violations(tasks: DataFrame, texts: DataFrame, ratio: dict[str, int] | None = None, slack: float = RATIO_SLACK, least: int = LEAST_TASKS) -> DataFrame:
    """Checks: repeated_id, unknown_class, path_format, path_missing, query_leak, exact_identifier,
    natural_identifier, ratio and too_few (id null), expected_and_forbidden."""
    ratio = RATIO if ratio is None else ratio
    tasks = tasks.select("id", "class", "query", _list("expect_paths").alias("expect_paths"), _list("must_not_paths").alias("must_not_paths"), _list("expect_symbols").alias("expect_symbols"))
    out = []
    repeated = tasks.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    out.append(_row(repeated, "repeated_id", "n"))
    out.append(_row(tasks.filter(~F.coalesce(F.col("class"), F.lit("")).isin(list(ratio))), "unknown_class", "class"))
    out.append(_row(tasks.select("id", F.explode(F.array_intersect("expect_paths", "must_not_paths")).alias("path")), "expected_and_forbidden", "path"))

    expected = tasks.select("id", "class", "query", F.explode("expect_paths").alias("path"))
    declared = expected.select("id", "path").unionByName(tasks.select("id", F.explode("must_not_paths").alias("path")))
    faulty = declared.withColumn("fault", path_fault(F.col("path"))).filter("fault IS NOT NULL")
    out.append(_row(faulty, "path_format", F.concat("path", F.lit(": "), "fault")))
    out.append(_row(declared.join(texts.select("path"), "path", "left_anti"), "path_missing", "path"))

    bare = F.regexp_replace("path", "^/+", "")
    name = F.substring_index(bare, "/", -1)
    stem = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    pieces = expected.select("id", "query", F.explode(F.array_distinct(F.array(bare, name, stem))).alias("piece")).filter(F.length("piece") >= LEAK_LETTERS)
    symbols = tasks.filter("class != 'exact'").select("id", "query", F.explode("expect_symbols").alias("piece"))
    given = pieces.unionByName(symbols).distinct()
    out.append(_row(given.filter(mentions(F.col("query"), F.col("piece"))), "query_leak", "piece"))

    # identifiers of a query that stand anywhere in a text of an expected path
    words = tasks.filter("class IN ('exact', 'natural')").withColumn("words", F.sort_array(F.array_distinct(F.regexp_extract_all("query", F.lit(IDENTIFIER), F.lit(1)))))
    asked = words.select("id", "class", "query", F.explode("expect_paths").alias("path"), "words").distinct()
    met = texts.select("path", "text").join(asked, "path").select("id", "class", "query", F.explode(F.filter("words", lambda w: F.coalesce(F.contains("text", w), F.lit(False)))).alias("word")).distinct()
    exact = words.filter("class = 'exact'")
    out.append(_row(exact.join(met, ["id", "class", "query"], "left_anti"), "exact_identifier", F.concat_ws(" ", "words")))
    out.append(_row(met.filter("class = 'natural'"), "natural_identifier", "word"))

    counts = tasks.agg(F.count("*").alias("total"), *[F.count_if(F.col("class") == c).alias(f"n{i}") for i, c in enumerate(ratio)]).withColumn("id", F.lit(None).cast("string"))
    for i, (c, share) in enumerate(ratio.items()):
        wanted = F.col("total") * share / sum(ratio.values())
        out.append(_row(counts.filter(F.abs(F.col(f"n{i}") - wanted) > slack), "ratio", F.concat(F.lit(f"{c}: "), F.col(f"n{i}"))))
    out.append(_row(counts.filter(F.col("total") < least), "too_few", "total"))
    return reduce(DataFrame.unionByName, out)


def summary(found: DataFrame) -> DataFrame:
    """(check, violations, tasks): how many rows each failed check has, and on how many tasks."""
    return found.groupBy("check").agg(F.count("*").alias("violations"), F.count_distinct("id").alias("tasks"))
