"""Near-duplicate documents by min-max hashing.

Every permutation of the shingles gives a set two values, its least and its greatest
image, so a signature costs half the hash evaluations of plain MinHash.  Both agree
between two sets with a chance that is their Jaccard similarity, and the two are nearly
independent, so the estimate they give is unbiased and varies less than that of as many
minima.  Values are banded; sets that share a band are candidates:

1. documents with equal sets are one class, whose first document stands for all;
2. a band has a centre, and a document first meets the one centre that it shares most
   bands with.  What the confirmed links connect needs no further comparison, which
   settles groups of copies with one comparison for each document;
3. what a band leaves unconnected is compared pair by pair.  A band with over
   ``CROWD`` possible pairs (texts from one template that do not link) is left to the
   exact prefixes of ``vertical_join``, which miss no link among its members.

Before sets are fetched for a pair of the third step, sketches of one bit for each value
must not differ in more bits than six deviations above what the threshold lets expect.
A link counts when the full sets confirm it.  At the default of 40 bands of three
permutations a pair at a similarity of exactly 0.8 shares no band with a chance of
5 in a million, at 0.85 of 5 in a billion.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm import kernels, vertical_join
from harrow.llm.components import components
from harrow.plans.scratch import drop, stage, tidy
from harrow.plans.ship import ship

BANDS, BAND_PERMUTATIONS = 40, 3
#: Pairs with unconnected members that a band compares by their sketches.
CROWD = 1_000
#: Bits that tell which addresses are wanted: 4 MB.
BITMAP = 1 << 25
_U = np.uint64


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``n`` permutations of 64-bit numbers."""
    seeds = kernels.mix(np.arange(1, 2 * n + 1, dtype=_U) * _U(kernels.BASE))
    return seeds[:n] | _U(1), seeds[n:]


def signatures(sets: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest images of each set under ``n`` permutations; no set is empty."""
    grams = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    low, high = np.empty((len(sets), n), _U), np.empty((len(sets), n), _U)
    for p, (factor, offset) in enumerate(zip(*permutations(n), strict=True)):
        image = grams * factor
        image += offset
        low[:, p] = np.minimum.reduceat(image, starts)
        high[:, p] = np.maximum.reduceat(image, starts)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, bands: int) -> np.ndarray:
    """One number for each band of a signature."""
    out = np.empty((len(low), bands), _U)
    each = low.shape[1] // bands
    for b in range(bands):
        key = np.full(len(low), b, _U)
        for p in range(b * each, (b + 1) * each):
            for values in (low, high):
                key = kernels.mix((key ^ values[:, p]) * _U(kernels.BASE))
        out[:, b] = key
    return out


def sketches(low: np.ndarray, high: np.ndarray) -> list[list[int]]:
    """One bit of each value of a signature, padded to whole 64-bit words."""
    bits = (kernels.mix(np.concatenate([low, high], axis=1).copy()) & _U(1)).astype(np.uint8)
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(">i8").astype(np.int64).tolist()


def most_unlike(values: int, parts: int, whole: int) -> int:
    """Bits of two sketches that may differ if the sets reach the threshold, six deviations allowed for."""
    p = (1 - parts / whole) / 2
    return math.ceil(values * p + 6 * math.sqrt(values * p * (1 - p)))


def digest_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _sign(width: int, bands: int, each: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in kernels.pieces(batch.column("text")):
                sets = vertical_join.gram_sets(raw, offsets, width)
                digests = [digest_of(g) for g in sets]
                fresh: dict[bytes, int] = {}
                some: list[np.ndarray] = []
                for d, g in zip(digests, sets, strict=True):
                    if len(g) and d not in fresh:
                        fresh[d] = len(some)
                        some.append(g)
                low, high = signatures(some, bands * each) if some else (np.zeros((0, bands * each), _U),) * 2
                keys, bits = band_keys(low, high, bands).view(np.int64).tolist(), sketches(low, high)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        batch.column("address").slice(lo, hi - lo),
                        pa.array([len(g) for g in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([keys[fresh[d]] if d in fresh else None for d in digests], pa.list_(pa.int64())),
                        pa.array([bits[fresh[d]] if d in fresh else None for d in digests], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "address", "n", "digest", "bands", "sketch"],
                )

    return scan


def _cut(width: int):
    """The full set of each text whose set is the wanted one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in kernels.pieces(batch.column("text")):
                sets = vertical_join.gram_sets(raw, offsets, width)
                wanted = batch.column("digest").slice(lo, hi - lo).to_pylist()
                own = [i for i, (g, d) in enumerate(zip(sets, wanted, strict=True)) if digest_of(g) == d]
                keys = pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo).take(pa.array(own, pa.int64())), pa.array([len(sets[i]) for i in own], pa.int64()), keys], names=["node", "n", "keys"])

    return scan


def _bitmap(wanted: DataFrame) -> bytes:
    """One bit for each place that an address can fall on, set where one does: ``BITMAP`` bits, whatever the input."""
    place = F.pmod("address", F.lit(BITMAP)) + 1
    rows = wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = bytearray(BITMAP // 8)
    for bucket, bits in rows:
        out[(bucket - 1) * len(bits) : bucket * len(bits)] = bits
    return bytes(out)


def _likely(bitmap: bytes):
    """Rows whose address may be wanted; most others need not be moved."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            place = np.asarray(batch.column("address")) % BITMAP
            yield batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))

    return scan


def _full_sets(rows: DataFrame, classes: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """(node, n, keys) of the classes that have a candidate."""
    wanted = stage(classes.join(marks.select("node").distinct(), "node", "left_semi").select("node", "address", "digest"), "wanted")
    likely = rows.select("address", "text").mapInArrow(_likely(_bitmap(wanted)), "address long, text string")
    sets = stage(likely.join(wanted, "address").mapInArrow(_cut(width), "node long, n long, keys array<long>"), "sets")
    if sets.count() > wanted.count():  # a row that stands for its class is there twice
        twice = sets
        sets = stage(twice.dropDuplicates(["node"]), "sets")
        drop(twice)
    drop(wanted)
    return sets


def confirmed(pairs: DataFrame, sets: DataFrame, parts: int, whole: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose full sets reach the threshold; sizes that cannot are never fetched."""
    near = pairs.filter(F.least("na", "nb") * whole >= F.greatest("na", "nb") * parts)
    x = near.join(sets.select(F.col("node").alias("a"), F.col("keys").alias("ka")), "a").join(sets.select(F.col("node").alias("b"), F.col("keys").alias("kb")), "b")
    return x.filter(F.size(F.array_intersect("ka", "kb")) * (whole + parts) >= (F.col("na") + F.col("nb")) * parts).select("a", "b")


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs of entries x and y, smaller node first."""
    first, last = F.least("x", "y"), F.greatest("x", "y")
    return met.select(first.alias("p"), last.alias("q")).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb")).distinct()


def _connect(marks: DataFrame, sets: DataFrame, sketched: DataFrame, words: int, unlike: int, parts: int, whole: int) -> DataFrame:
    """(node, label) of all nodes in bands; connected nodes have the same label.

    ``sketched`` (node, sketch) has sketches of so many words of 64 bits; pairs whose sketches differ in more than ``unlike``
    bits are not fetched.
    """
    like = stage(marks.groupBy("node").agg(F.sum("k").alias("like")), "like")
    rows = marks.join(like, "node").select("mark", F.struct("node", "n").alias("x"), "like")
    centres = rows.groupBy("mark").agg(F.max_by("x", F.struct("like", "x.node")).alias("y"))
    # a node meets the centre that it shares most bands with, so copies of one text meet one centre
    met = rows.join(centres, "mark").filter("x.node != y.node").groupBy("x", "y").agg(F.count("*").alias("bands"))
    best = met.groupBy("x").agg(F.max_by("y", F.struct("bands", "y.node")).alias("y"))
    links = stage(confirmed(stage(_pairs(best), "pairs"), sets, parts, whole), "links")
    tidy(marks.sparkSession)
    labels = stage(like.select("node").join(components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    open_ = stage(marks.join(labels, "node").select("mark", F.struct("node", "n").alias("x"), "label"), "open")
    own = open_.groupBy("mark", "label").agg(F.count("*").alias("k"))
    main = own.groupBy("mark").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("k"), (F.sum("k") - F.max("k")).alias("others")).filter("others > 0")
    main = stage(main, "main")
    crowded = F.col("others") * F.col("k") > CROWD
    every = open_.join(main.filter(~crowded), "mark").join(sketched.select(F.col("node").alias("own"), "sketch"), F.col("x.node") == F.col("own")).drop("own")
    few = every.filter(F.col("label") != F.col("main")).select("mark", "x", F.col("label").alias("lx"), F.col("sketch").alias("sx"))
    differ = lambda i: F.bit_count(F.get("sx", F.lit(i)).bitwiseXOR(F.get("sketch", F.lit(i))))
    alike = reduce(Column.__add__, map(differ, range(words))) <= unlike
    fits = F.least("x.n", "y.n") * whole >= F.greatest("x.n", "y.n") * parts
    met = few.join(every.select("mark", F.col("x").alias("y"), "label", "main", "sketch"), "mark").filter(fits & alike).filter((F.col("lx") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("x.node") < F.col("y.node"))))
    pairs = _pairs(met)
    if not main.filter(crowded).isEmpty():
        nodes = open_.join(main.filter(crowded), "mark", "left_semi").select(F.col("x.node").alias("node")).distinct()
        _, lists = vertical_join._lists(stage(sets.join(nodes, "node", "left_semi"), "crowd"), parts, whole)
        rows = lists.join(labels, "node").select("mark", F.struct("node", "n", "place", "label").alias("x"))
        pairs = pairs.unionByName(vertical_join.across(rows, parts, whole)).distinct()
    found = confirmed(stage(pairs, "pairs"), sets, parts, whole)
    for side in ("a", "b"):
        found = found.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side)
    joined = components(found.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("label").alias("root"), F.col("node").alias("label"))
    return labels.join(joined, "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, parts: int = 80, whole: int = 100, bands: int = BANDS, each: int = BAND_PERMUTATIONS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    Two documents link when parts/whole of the union of their sets of word
    ``width``-grams (A-Z in lower case) is shared; only links whose full sets confirm
    it count.  Fewer words than ``width`` are one gram; null texts and texts without
    words have no set and link with nothing (component_id is their own id).
    component_id is the smallest id reachable by links, null ids passed over; kept
    says that the row has it, as rows of null ids do when their component has no
    other.  Rows that are there twice have equal sets and are both kept or not.  An empty
    table gives no rows; other columns are not read.  A document is worked on whole:
    a task needs some hundred bytes for each word of its longest one.
    """
    spark = docs.sparkSession
    ship(spark)
    if min(width, parts, bands, each) < 1 or parts > whole:
        raise ValueError("a share between 0 and 1, and at least one word, band and permutation")
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(key.alias("doc_id"), F.xxhash64(key, text).alias("address"), text.alias("text"))
    signed = rows.mapInArrow(_sign(width, bands, each), "doc_id long, address long, n long, digest binary, bands array<long>, sketch array<long>")
    signed = stage(signed.withColumn("uid", F.monotonically_increasing_id()), "signed")
    some = signed.filter("n > 0")
    first = F.min_by(F.struct("address", "n", "bands", "sketch"), "uid")
    classes = some.groupBy("digest").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least"), first.alias("first"))
    classes = stage(classes.select("digest", "node", "least", "first.address", "first.n", "first.bands", "first.sketch"), "classes")
    marks = classes.select("node", F.explode("bands").alias("mark"))
    twice = marks.groupBy("mark").agg(F.count("*").alias("k")).filter("k > 1")
    marks = stage(marks.join(twice, "mark").join(classes.select("node", "n"), "node").select("mark", "node", "n", "k"), "marks")
    tidy(spark)
    sets = _full_sets(rows, classes, marks, width)
    tidy(spark)
    values = 2 * bands * each
    labels = _connect(marks, sets, classes.select("node", "sketch"), -(-values // 64), most_unlike(values, parts, whole), parts, whole)
    named = stage(classes.join(labels, "node", "left").select("digest", "least", F.coalesce("label", "node").alias("label")), "named")
    named = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("digest", "component_id")
    out = some.join(named, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.unionByName(signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
