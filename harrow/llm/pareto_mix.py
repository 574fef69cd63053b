"""Mixing sources to target weights by Pareto order sampling.

A document of source s is wanted e_s = target_s / size_s times.  floor(e_s) whole
copies are certain; what is left of the target, in words, is a sample of documents
that come once more.  A sample of words would hit a document as often as it is long,
so its inclusion probability is p = min(1, c_s * size), with c_s such that the
expected words are those wanted.  Documents with p = 1 are certain and set apart.
The others are ranked by  odds(u) / odds(p)  with u uniform and fixed by the
document's id, and the sample takes the lowest ranks of each source up to a fixed
size, counted in words.

A source can hold a third of all documents, so no window ever runs over a source's
documents: c_s follows from the counts of its distinct sizes; ranks are cut into
``BUCKETS`` ranges, the words of each range are summed before the shuffle, and only
the range in which the sample ends is ordered document by document.  What comes out
is one threshold rank for each source.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.plans.scratch import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the rank, r / (1 + r).  Near r = 1, where samples end, one range holds this share of a source at most.
BUCKETS = 4096
#: A plan of at most this many sources is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000
MOST_COPIES = 3


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")


def _rank(u: Column, p: Column) -> Column:
    """r / (1 + r) of the Pareto rank r = odds(u) / odds(p): 0 if p is 1, and 1 if p is 0."""
    return u * (1.0 - p) / (u * (1.0 - p) + (1.0 - u) * p)


def targets(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Targets of each source: shares by weight, none above MOST_COPIES times its size.

    Raising all shares until the excess is placed ends at a level L with target =
    min(cap, L * weight); sources fill up in the order of cap / weight, so L follows
    from running sums in that order.  One row for each source comes in and goes out.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.select("source", "source_size", cycle.cast("double").alias("weight"), (MOST_COPIES * F.col("source_size")).cast("double").alias("cap"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    x = x.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("cap").over(filled), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(filled), F.lit(0.0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    # the first source that its level does not fill sets the level of all after it
    x = x.withColumn("level", F.when(level * F.col("weight") < F.col("cap"), level))
    first = F.min(F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), F.col("source"), F.col("level"))) 
    lowest = x.filter("level is not null").agg(first.alias("f")).select(F.col("f.level").alias("at"))
    return x.crossJoin(F.broadcast(lowest)).select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, u) of each document, and the plan of each source."""
    rows = stage(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), _size(text_col).alias("size"), uniform(F.col(f"`{id_col}`"), seed).alias("u")), "sizes")
    counts = stage(rows.groupBy("source", "size").agg(F.count("*").alias("k")), "counts")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("k")).alias("source_size")), weights)
    goal = goal.withColumn("certain", F.floor(copies)).withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    goal = stage(_left(goal, _rates(counts, goal)), "goals")
    ranked = _match(rows.filter("size > 0"), goal.select("source", "rest", "rate", "longest", "above")).filter("rest > 0 and size <= longest")
    ranked = ranked.withColumn("rank", _rank(F.col("u"), F.least(F.lit(1.0), F.col("rate") * F.col("size")))).withColumn("bucket", F.floor(F.col("rank") * BUCKETS))
    sums = ranked.groupBy("source", "bucket", "rest", "above").agg(F.sum("size").alias("words"))
    before = F.col("above") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    last = stage(sums.withColumn("before", before).filter("before <= rest").groupBy("source").agg(F.max(F.struct("bucket", "before")).alias("x")).select("source", "x.*"), "last")
    edge = _match(ranked, last, "bucket")
    inside = F.sum("size").over(Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = edge.withColumn("upto", F.col("before") + inside)
    # a document is in if that brings the sum nearer to what is wanted
    ends = ends.filter(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("rank", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("upto"))
    start = last.select("source", F.struct((F.col("bucket") / BUCKETS).alias("rank"), F.lit(-(1 << 63)).alias("id")).alias("from"))
    plan = _left(_left(goal, start), ends)
    return rows, stage(plan.withColumn("edge", F.coalesce("upto", "from")).drop("upto", "from"), "plan")


def _rates(counts: DataFrame, goal: DataFrame) -> DataFrame:
    """source, rate, longest, above: c_s, the greatest size that is not certain, and the words of all greater ones.

    With all sizes above s certain, c = (rest - their words) / (sum of squares of the
    others); the greatest s with c * s <= 1 is the one.  One row for each size of a source.
    """
    x = _match(counts.filter("size > 0"), goal.select("source", "rest")).filter("rest > 0")
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    words, squares = F.col("size") * F.col("k"), F.col("size").cast("double") * F.col("size") * F.col("k")
    x = x.withColumn("above", F.sum(words).over(down) - words).withColumn("squares", F.sum(squares).over(Window.partitionBy("source").orderBy("size")))
    x = x.withColumn("rate", (F.col("rest") - F.col("above")) / F.col("squares")).filter("rate > 0 and rate * size <= 1 + 1e-9")
    return x.groupBy("source").agg(F.max_by(F.struct("rate", F.col("size").alias("longest"), "above"), "size").alias("x")).select("source", "x.*")


def _match(a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
    on = a["source"].eqNullSafe(b["source"])
    for c in more:
        on &= a[c] == b[c]
    return a.join(b, on).select(*[a[c] for c in a.columns], *[b[c] for c in b.columns if c not in a.columns])


def _left(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a["source"].eqNullSafe(b["source"]), "left").select(a["*"], *[b[c] for c in b.columns if c != "source"])


def _copies(size: Column, u: Column, doc_id: Column) -> Column:
    rank = _rank(u, F.least(F.lit(1.0), F.col("rate") * size))
    lower = F.struct(rank.alias("rank"), F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("id")) <= F.col("edge")
    once = (F.col("rest") > 0) & ((size > F.col("longest")) | lower)
    return (F.col("certain") + F.when((size > 0) & F.coalesce(once, F.lit(False)), 1).otherwise(0)).cast("long")


def _planned(rows: DataFrame, source: Column, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "_source")
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(plan) if few else plan, source.eqNullSafe(F.col("_source")), "left").drop("_source")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row.

    Size is the number of words (null and empty texts: 0, of which nothing is
    taken).  Sources order by code point, null last, and weigh ``weights`` in turn.
    ``taken`` is copies times size, never above MOST_COPIES times; a source's sum
    misses its target by half a document at most, or by rows that repeat an id,
    which share one fate.  An empty table gives no rows.
    """
    rows, plan = plan_mix(docs, **options)
    return _planned(rows, F.col("source"), plan).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("size"), F.col("u"), F.col("doc_id"))).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """The mixed rows themselves, all columns, each as often as the mix takes it.

    Rows without words have no size to mix by; they come as often as their source's
    certain copies.
    """
    _, plan = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    plan = plan.select("source", "certain", "rest", "rate", "longest", "edge")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    x = docs.select(whole, F.col(f"`{source_col}`").cast("string").alias("_s"), F.col(f"`{id_col}`").alias("_id"), uniform(F.col(f"`{id_col}`"), seed).alias("_u"), _size(text_col).alias("_n"))
    x = _planned(x, F.col("_s"), plan).withColumn("_n", _copies(F.col("_n"), F.col("_u"), F.col("_id"))).filter("_n > 0")
    return x.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
