"""Vector code compression: product codes from Yinyang Lloyd rounds in whole numbers.

Components become integers, vectors are cut into parts, and every part position has a
codebook of its own.  The entries of a codebook are grouped once by nearness.  A part
remembers its entry and, for each group, a lower bound of its distance to the group's
other entries.  After a round the entries have drifted: bounds shrink by the largest
drift in their group, and only groups whose bound does not clear the exact distance to
the own entry are scanned.  Bounds are rounded away from a wrong decision; whatever
they leave open, ties included, is settled by exact integer distances.

A round is one pass over a staged table that carries the bounds, and sums of the parts
that changed their entry: the sums of all entries follow from those of the last round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.plans.scratch import drop, stage, tidy
from harrow.plans.ship import ship

#: Components are held in this range after scaling, so that squared distances are exact in 64 bits.
LARGEST = 1 << 26
#: Entries in a group of a codebook, on average.
GROUP_ENTRIES = 16
#: Up to this size of components and distances, sums of products are exact in doubles.
_EXACT = float(1 << 53)
#: Groups of label sums up to this many rows are broadcast.
BROADCAST_LABELS = 100_000
_SALTS = 64


def _integers(scale: int):
    """Scaled vectors as bytes; rows that cannot take part go."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            full = column.drop_null()
            sizes = np.asarray(full.value_lengths()).astype(np.int64)
            flat = full.flatten()
            values = np.asarray(flat.fill_null(float("nan"))).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(values * scale)
            fits = np.isfinite(values) & (np.abs(scaled) <= LARGEST)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            bad = np.concatenate([[0], np.cumsum(~fits)])
            good = (bad[edges[1:]] == bad[edges[:-1]]) & (sizes > 0)
            ints = np.where(fits, scaled, 0).astype("<i4")
            rows = pa.array(np.flatnonzero(np.asarray(column.is_valid()))[good])
            data = [ints[s:e].tobytes() for s, e, ok in zip(edges[:-1].tolist(), edges[1:].tolist(), good.tolist(), strict=True) if ok]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), batch.column("label").take(rows), pa.array(data, pa.binary())], names=["vec_id", "label", "v"])

    return scan


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries."""
    most = float(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - c[None, :, k]) ** 2
    return out


def groups_of(entries: np.ndarray, rounds: int = 5) -> np.ndarray:
    """The group of each entry, by a few Lloyd rounds over the entries themselves."""
    n = max(1, -(-len(entries) // GROUP_ENTRIES))
    centres = entries[np.linspace(0, len(entries) - 1, n).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = ((entries[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(near):
            centres[g] = entries[near == g].mean(0)
    _, near = np.unique(near, return_inverse=True)
    return near


class Codebooks:
    """Entries (part, entry, component), the group of each, and how far each group last drifted."""

    def __init__(self, entries: np.ndarray, groups: list[np.ndarray] | None = None, drift: list[np.ndarray] | None = None):
        self.entries = entries
        self.groups = groups or [groups_of(e) for e in entries]
        self.drift = drift or [np.zeros(g.max() + 1) for g in self.groups]
        self.members = [[np.flatnonzero(g == k) for k in range(g.max() + 1)] for g in self.groups]
        self.places = np.concatenate([[0], np.cumsum([len(m) for m in self.members])])

    def moved(self, entries: np.ndarray) -> Codebooks:
        step = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(2)) * (1 + 1e-9)
        return Codebooks(entries, self.groups, [np.array([s[m].max() for m in own]) for s, own in zip(step, self.members, strict=True)])


def _down(x: np.ndarray) -> np.ndarray:
    """Single precision, never above x."""
    return np.nextafter((x * (1 - 1e-9)).astype(np.float32), np.float32(-np.inf))


def reassign(x: np.ndarray, books: Codebooks, part: int, own: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of each part, its squared distance, new bounds, and how many distances were computed.

    ``own`` is -1 and ``low`` 0 where nothing is known yet.  low[:, g] bounds the
    distance to the entries of group g other than the own one.
    """
    c, groups, members = books.entries[part], books.groups[part], books.members[part]
    n = len(x)
    known = own >= 0
    start = np.where(known, own, 0)
    best = ((x - c[start]) ** 2).sum(1)
    code, first = start.copy(), best.copy()
    bounds = np.maximum(low.astype(np.float64) - books.drift[part][None, :], 0)
    scanned = np.zeros((n, len(members)), bool)
    nearest = np.full((n, len(members)), -1, np.int64)  # least and second least squared distance in scanned groups
    second = np.full((n, len(members)), -1, np.int64)
    who = np.zeros((n, len(members)), np.int64)
    work = n
    for g, entries in enumerate(members):
        # a bound that clears the distance strictly leaves no tie either
        todo = np.flatnonzero(~(bounds[:, g] > np.sqrt(best.astype(np.float64)) * (1 + 1e-9)) | ~known)
        if not len(todo):
            continue
        d = squared(x[todo], c[entries])
        work += d.size
        at = d.argmin(1)  # entries of a group ascend, so the first least one has the lower index
        rows = np.arange(len(todo))
        least = d[rows, at]
        d[rows, at] = np.iinfo(np.int64).max
        scanned[todo, g], nearest[todo, g], who[todo, g], second[todo, g] = True, least, entries[at], d.min(1)
        better = (least < best[todo]) | ((least == best[todo]) & (entries[at] < code[todo]))
        code[todo[better]], best[todo[better]] = entries[at[better]], least[better]
    # a scanned group is bounded by its least entry that is not the chosen one
    limit = np.where(who == code[:, None], second, nearest)
    fresh = np.where(limit == np.iinfo(np.int64).max, np.inf, np.sqrt(np.maximum(limit, 0).astype(np.float64)))
    bounds = np.where(scanned, fresh, bounds)
    left = np.flatnonzero(known & (code != own))  # the entry left is one of its group's others now
    g = groups[own[left]]
    bounds[left, g] = np.minimum(bounds[left, g], np.sqrt(first[left].astype(np.float64)))
    return code, best, _down(np.minimum(bounds, 1e30)), work


def _assign(books: Codebooks, dims: int):
    parts, wide = len(books.entries), dims // len(books.entries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(n, dims).astype(np.int64)
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), "<i2").reshape(n, parts).astype(np.int64)
            low = np.frombuffer(b"".join(batch.column("low").to_pylist()), "<f4").reshape(n, -1)
            code, error, bounds = np.empty((n, parts), "<i2"), np.zeros(n, np.int64), np.empty((n, books.places[-1]), "<f4")
            for p in range(parts):
                at = slice(books.places[p], books.places[p + 1])
                code[:, p], best, bounds[:, at], _ = reassign(x[:, p * wide : (p + 1) * wide], books, p, old[:, p], low[:, at])
                error += best
            held = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (code, old.astype("<i2"), bounds)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), held[0], held[1], held[2], pa.array(error)], names=["vec_id", "label", "v", "code", "was", "low", "error"])

    return scan


def _moves(parts: int, size: int, dims: int):
    """What the parts that changed add to and take from the sums of entries, one row for each entry of a task."""
    wide = dims // parts

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * size, wide), np.int64), np.zeros(parts * size, np.int64)
        for batch in batches:
            n = batch.num_rows
            code, was = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<i2").reshape(n, parts).astype(np.int64) for k in ("code", "was"))
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(n, dims).astype(np.int64)
            for p in range(parts):
                own = x[:, p * wide : (p + 1) * wide]
                change = np.flatnonzero(code[:, p] != was[:, p])
                gone = change[was[change, p] >= 0]
                np.add.at(total, p * size + code[change, p], own[change])
                np.add.at(count, p * size + code[change, p], 1)
                np.subtract.at(total, p * size + was[gone, p], own[gone])
                np.subtract.at(count, p * size + was[gone, p], 1)
        met = np.flatnonzero(count | total.any(1))
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * wide, pa.int32()), pa.array(total[met].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), sums], names=["entry", "n", "sums"])

    return scan


def _add_moves(state: DataFrame, parts: int, size: int, dims: int, total: np.ndarray, count: np.ndarray) -> None:
    """Add a round's moves; at most ``parts * size`` rows come to the driver."""
    wide = dims // parts
    rows = state.select("v", "code", "was").mapInArrow(_moves(parts, size, dims), "entry long, n long, sums array<long>")
    summed = rows.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(wide)])
    for r in summed.collect():
        count[r["entry"]] += r["n"]
        total[r["entry"]] += np.array(r[2:], np.int64)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Every row with the error of all rows of its label, null labels together."""
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    key = F.struct("label")  # a struct is equal to its like, null inside or not
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums.withColumn("k", key).drop("label")), key == F.col("k")).drop("k")
    salted = sums.withColumn("k", key).drop("label").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return coded.withColumn("s", F.pmod(F.xxhash64("vec_id", "v"), F.lit(_SALTS)).cast("int")).join(salted, (key == F.col("k")) & (F.col("s") == F.col("salt"))).drop("k", "s", "salt")


def digest_of(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row that takes part.

    Vectors that are null or empty, or hold null or non-finite components, take no
    part, nor do those of another dimension than most (the smaller, if even) or with a
    scaled component beyond 2**26.  ``parts`` divides the dimension.  Codebooks start
    as the ``size`` first rows by id, null ids last, equal ids by vector; with fewer
    rows they are smaller.  Rows that are there twice count twice.  An empty table
    gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    if not 1 <= size <= 256 or parts < 1 or rounds < 0:
        raise ValueError("a codebook has 1 to 256 entries")
    kind = dict(vectors.dtypes)[label_col]
    schema = f"vec_id long, label {kind}, v binary"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    packed = stage(rows.mapInArrow(_integers(scale), schema), "integers")
    common = packed.groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = f"vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if common is None:
        return spark.createDataFrame([], out)
    dims = common["n"] // 4
    if dims % parts:
        raise ValueError(f"{parts} parts do not divide {dims} components")
    packed = packed.filter(F.length("v") == common["n"])
    first = packed.orderBy(F.asc_nulls_last("vec_id"), "v").limit(size).collect()
    entries = np.stack([np.frombuffer(r["v"], "<i4") for r in first]).astype(np.int64)
    books = Codebooks(np.ascontiguousarray(entries.reshape(len(first), parts, dims // parts).transpose(1, 0, 2)))
    size = len(first)
    total, count = np.zeros((parts * size, dims // parts), np.int64), np.zeros(parts * size, np.int64)
    none, free = b"\xff\xff" * parts, bytes(4 * int(books.places[-1]))
    state = packed.withColumns({"code": F.lit(none), "was": F.lit(none), "low": F.lit(free), "error": F.lit(0).cast("long")})
    carried = f"{schema}, code binary, was binary, low binary, error long"
    for k in range(rounds + 1):
        before, state = state, stage(state.mapInArrow(_assign(books, dims), carried), "codes")
        if k:
            drop(before)
            tidy(spark)
        if k < rounds:
            _add_moves(state, parts, size, dims, total, count)
            used = count > 0
            moved = books.entries.reshape(parts * size, -1).copy()
            moved[used] = total[used] // count[used, None]
            books = books.moved(moved.reshape(books.entries.shape))
    digits = F.hex(F.concat(*[F.substring("code", 2 * p + 1, 1) for p in range(parts)]))
    return with_label_errors(state).select("vec_id", F.lower(digits).alias("code"), "error", "label_error", F.lit(digest_of(books.entries)).alias("codebooks_sha256"))
