"""Where do windows of a fixed length recur?  The distributed frame of two operators.

Comparing every window of every document would move the corpus many times over.
Instead each window names an *anchor*, the least-hashed short gram inside it, so
that equal windows name equal anchors at equal places.  Consecutive windows that
name the same anchor form a *run*, and a run's *region* is the text it spans:

1. one scan writes a narrow row per run (anchor, region hash, place);
2. runs whose anchor occurs once are dropped, equal regions collapse to one
   *variant* with a count, and only one representative text of each is fetched;
3. variants are dealt to shards by anchor; a resolver (automata over words or a
   suffix array over bytes) confirms there, on the text itself, what recurs;
4. the confirmed spans go back to every occurrence of the variant.

A group of copies of any size is one variant per region, so it costs what a single
document costs.  An anchor with more variants than ``max_variants`` (a passage
that a large share of all documents quote in different surroundings) is not
brought into one task: its windows are counted by a distributed aggregation.

A document is identified by its id and 128 bits of its text's SHA-256, so rows that
repeat an id, or have none, are told apart by their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm import kernels
from harrow.plans.scratch import drop, stage, tidy
from harrow.plans.ship import ship

Resolver = Callable[[pd.DataFrame], pd.DataFrame]

_RUNS = "doc_id long, th binary, anchor long, region long, first long, geo int"
_BODIES = "anchor long, region long, n long, count int, at int, body binary"
_SPANS = "anchor long, region long, spans array<struct<s:int,e:int>>"
#: Variants of about this many bytes make a shard.
SHARD_BYTES = 12 << 20


def text_key(text: Column) -> Column:
    """128 bits that tell a text from any other; null is empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text).alias("th"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def units_of(unit: str, raw: np.ndarray, offsets: np.ndarray):
    """Hashable units of a piece, the number of units before each document, and byte spans of units."""
    if unit == "word":
        starts, ends, bounds = kernels.word_spans(raw, offsets)
        return kernels.word_hashes(raw, starts, ends), bounds, starts, ends
    return kernels.mix(raw.astype(np.uint64)), offsets, None, None


def _runs(unit: str, length: int, gram: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.binary()), ("anchor", pa.int64()), ("region", pa.int64()), ("first", pa.int64()), ("geo", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in kernels.pieces(batch.column("text")):
                units, bounds, _, _ = units_of(unit, raw, offsets)
                r = kernels.anchor_runs(units, bounds, length, gram)
                if not len(r["first"]):
                    continue
                rows = pa.array(r["doc"] + lo)
                cols = [batch.column("doc_id").take(rows), batch.column("th").take(rows), r["anchor"].view(np.int64), r["region"].view(np.int64), r["first"] - bounds[r["doc"]], (r["count"] << 16 | r["at"]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=schema)

    return scan


def _bodies(unit: str, length: int):
    """Cut the representative text of each variant out of its document."""
    names = ["anchor", "region", "n", "count", "at", "body"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in kernels.pieces(batch.column("text")):
                data = raw.tobytes()
                out: list[list] = [[] for _ in names]
                starts, ends, bounds = kernels.word_spans(raw, offsets) if unit == "word" else (None, None, offsets)
                for k, want in enumerate(batch.column("want").slice(lo, hi - lo).to_pylist()):
                    for w in want:
                        count, at = w["geo"] >> 16, w["geo"] & 0xFFFF
                        s = bounds[k] + w["first"]
                        e = s + count + length - 1
                        body = b" ".join(data[x:y] for x, y in zip(starts[s:e].tolist(), ends[s:e].tolist(), strict=True)) if unit == "word" else data[s:e]
                        for column, value in zip(out, (w["anchor"], w["region"], w["n"], count, at, body), strict=True):
                            column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=names)

    return cut


def _windows(unit: str, length: int):
    """One row for each window of a variant: its place and a digest of place and text."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = row["body"].split(b" ") if unit == "word" else row["body"]
                digests = []
                for i in range(row["count"]):
                    window = b" ".join(parts[i : i + length]) if unit == "word" else parts[i : i + length]
                    digests.append(hashlib.blake2b(window, digest_size=16, salt=str(i - row["at"]).encode()).digest())
                k = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array([row["anchor"]] * k, pa.int64()), pa.array([row["region"]] * k, pa.int64()), pa.array([row["n"]] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(digests, pa.binary())], names=["anchor", "region", "n", "i", "digest"])

    return explode


def _count_windows(bodies: DataFrame, unit: str, length: int) -> DataFrame:
    """Resolve variants by a distributed count of their windows."""
    windows = stage(bodies.mapInArrow(_windows(unit, length), "anchor long, region long, n long, i int, digest binary"), "windows")
    again = windows.groupBy("anchor", "digest").agg(F.sum("n").alias("n")).filter("n >= 2").drop("n")
    spans = F.transform(F.collect_list("i"), lambda i: F.struct(i.alias("s"), (i + length).cast("int").alias("e")))
    return windows.join(again, ["anchor", "digest"], "left_semi").groupBy("anchor", "region").agg(spans.alias("spans"))


def recurring_spans(rows: DataFrame, unit: str, length: int, gram: int, resolve: Resolver, max_variants: int) -> DataFrame:
    """(doc_id, th, spans) of each document of ``keyed`` rows that has a recurring window."""
    if not 0 < gram <= length < 1 << 15:
        raise ValueError("a window has 1 to 32767 units, and at least those of a gram")
    ship(rows.sparkSession)
    runs = stage(rows.mapInArrow(_runs(unit, length, gram), _RUNS), "runs")
    # staged, so that the join reads two plain exchanges and a crowded anchor can be split
    twice = stage(runs.groupBy("anchor").count().filter("count >= 2").select("anchor"), "twice")
    hits = stage(runs.join(twice, "anchor", "left_semi"), "hits")
    drop(runs)
    drop(twice)
    tidy(rows.sparkSession)
    variants = stage(hits.groupBy("anchor", "region").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "first", "geo")).alias("at")), "variants")
    wanted = variants.groupBy("at.doc_id", "at.th").agg(F.collect_list(F.struct("anchor", "region", "n", "at.first", "at.geo")).alias("want"))
    texts = rows.join(wanted, same_row(rows, wanted)).select(rows["text"], wanted["want"], rows["doc_id"], rows["th"])
    # a row that is there twice is one representative, not two
    bodies = stage(texts.mapInArrow(_bodies(unit, length), _BODIES).dropDuplicates(["anchor", "region"]), "bodies")
    crowded = variants.groupBy("anchor").count().filter(F.col("count") > max_variants).select("anchor")
    some = not crowded.isEmpty()
    calm = bodies.join(crowded, "anchor", "left_anti") if some else bodies
    size = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    found = calm.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInPandas(resolve, _SPANS)
    if some:
        found = found.unionByName(_count_windows(bodies.join(crowded, "anchor", "left_semi"), unit, length))
    found = stage(found, "found")
    placed = hits.join(found, ["anchor", "region"]).select("doc_id", "th", "first", F.explode("spans").alias("x"))
    return placed.groupBy("doc_id", "th").agg(F.collect_list(F.struct((F.col("first") + F.col("x.s")).alias("s"), (F.col("first") + F.col("x.e")).alias("e"))).alias("spans"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Every keyed row, with its spans or an empty list."""
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    return rows.join(spans, same_row(rows, spans), "left").select(rows["doc_id"], rows["text"], F.coalesce(spans["spans"], none).alias("spans"))


def span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets into, and the [start, end) rows of, a column of span lists."""
    flat = column.flatten()
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(column)))]).astype(np.int64)
    rows = np.stack([np.asarray(flat.field("s")), np.asarray(flat.field("e"))], axis=1) if len(flat) else np.zeros((0, 2), np.int64)
    return offsets, rows.astype(np.int64)
