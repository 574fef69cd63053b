"""Exact dedup by content-defined chunk recipes.

A text, its white space normalised, is cut where its own bytes say so; equal texts
are cut alike.  Each distinct chunk is brought together with its like once, by
content, which makes its fingerprint a verified identifier (or splits it, should
two contents share one).  Documents are then compared as ordered lists of
identifiers, a few bytes for each kilobyte of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm import kernels
from harrow.llm.recurrence import keyed, text_key
from harrow.plans.scratch import stage

#: A cut is made after 1 of 2**CUT_BITS places, and after MOST bytes at the latest.
CUT_BITS = 11
MOST = 1 << 16
_U = np.uint64


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of white space inside a document becomes one blank."""
    space = kernels.is_space(raw)
    drop = np.zeros(len(raw), bool)
    drop[1:] = space[1:] & space[:-1]
    drop[offsets[:-1][offsets[:-1] < len(raw)]] = False
    keep = ~drop
    out = raw[keep]
    out[space[keep]] = 32
    return out, np.concatenate([[0], np.cumsum(keep)])[offsets]


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks.  A cut depends on the 8 bytes before it, inside one document."""
    edges = [offsets[1:][np.diff(offsets) > 0]]
    if len(raw) >= 8:
        x = raw.astype(_U)
        for shift in (1, 2, 4):
            x = x[:-shift] | x[shift:] << _U(8 * shift)
        at = np.flatnonzero(kernels.mix(x) >> _U(64 - CUT_BITS) == 0) + 8
        own = offsets[np.searchsorted(offsets, at - 1, side="right") - 1]
        edges.append(at[at - own >= 8])
    ends = np.unique(np.concatenate(edges))
    if len(ends) and (sizes := np.diff(ends, prepend=0)).max() > MOST:
        ends = np.unique(np.concatenate([ends, *[np.arange(e - s, e, MOST)[1:] for e, s in zip(ends[sizes > MOST], sizes[sizes > MOST], strict=True)]]))
    return ends


def _chunks(texts: pa.Array, bits: int):
    """For each piece: first row, bytes, offsets, chunk starts, ends and fingerprints, chunks before each document."""
    for lo, hi, raw, offsets in kernels.pieces(texts):
        raw, offsets = normalise(raw, offsets)
        ends = cuts(raw, offsets)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        prints = kernels.Prefix(raw.astype(_U) + _U(1)).spans(starts, ends) >> _U(64 - bits)
        yield lo, hi, raw, offsets, starts, ends, prints.view(np.int64), np.searchsorted(ends, offsets, side="right")


def _recipes(bits: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets, _, _, prints, before in _chunks(batch.column("text"), bits):
                data = raw.tobytes()
                digests = [hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                recipe = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(prints))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("th").slice(lo, hi - lo), pa.array(digests), recipe], names=["doc_id", "th", "text_sha256", "recipe"])

    return scan


def _contents(bits: int, owner: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, offsets, starts, ends, prints, before in _chunks(batch.column("text"), bits):
                data = raw.tobytes()
                content = pa.array([data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                if not owner:
                    yield pa.RecordBatch.from_arrays([pa.array(prints), content], names=["print", "content"])
                    continue
                doc = np.searchsorted(before, np.arange(len(ends)), side="right") - 1
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(np.arange(len(ends)) - before[doc]), pa.array(prints), content], names=["doc_id", "th", "seq", "print", "content"])

    return scan


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", print_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (and th) of each row, dropped ones too.

    Texts are equal when they are after each run of white space became one blank;
    null is empty.  The row with the smallest id stays, null ids last; of rows that
    are there twice, one stays.  ``print_bits`` below 64 makes fingerprints collide.
    """
    rows = keyed(docs, id_col, text_col)
    recipes = stage(rows.mapInArrow(_recipes(print_bits), "doc_id long, th binary, text_sha256 string, recipe array<long>").withColumn("uid", F.monotonically_increasing_id()), "recipes")
    contents = rows.mapInArrow(_contents(print_bits, False), "print long, content binary").distinct()
    torn = stage(contents.groupBy("print").count().filter("count > 1").select("print"), "torn")
    listed = recipes.withColumn("fixes", F.array().cast("array<struct<seq:bigint,nth:int>>"))
    if not torn.isEmpty():
        owned = rows.mapInArrow(_contents(print_bits, True), "doc_id long, th binary, seq long, print long, content binary").join(torn, "print", "left_semi")
        names = owned.select("print", "content").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("print").orderBy("content")))
        fixes = owned.join(names, ["print", "content"]).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("seq", "nth"))).alias("fixed"))
        listed = listed.join(fixes, listed["doc_id"].eqNullSafe(fixes["doc_id"]) & (listed["th"] == fixes["th"]), "left").select(*[listed[c] for c in recipes.columns], F.coalesce(fixes["fixed"], listed["fixes"]).alias("fixes"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid")).alias("first")
    groups = listed.groupBy("recipe", "fixes").agg(first, F.count("*").alias("group_size")).filter("group_size > 1")
    return listed.join(groups, ["recipe", "fixes"], "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("first").isNull() | (F.col("first.uid") == F.col("uid"))).alias("kept"),
        "text_sha256",
        "th",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all columns."""
    kept = dedup_report(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_key"), text_key(F.col(f"`{text_col}`").cast("string")).alias("_hash"))
    same = rows["_key"].eqNullSafe(kept["_id"]) & (rows["_hash"] == kept["_th"])
    found = stage(rows.join(kept, same, "left_semi"), "kept")
    # rows that repeat both id and text came along with the one that stays
    again = found.groupBy("_key", "_hash").count().filter("count > 1")
    if again.isEmpty():
        return found.select("_row.*")
    same = found["_key"].eqNullSafe(again["_key"]) & (found["_hash"] == again["_hash"])
    one = found.join(again, same, "left_semi").groupBy("_key", "_hash").agg(F.first("_row").alias("_row"))
    return found.join(again, same, "left_anti").select("_row.*").unionByName(one.select("_row.*"))
