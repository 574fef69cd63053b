"""Best-fit packing by large-item matching.

Only the sizes of items decide how they are packed, and sizes are whole numbers up
to the capacity.  So the corpus is reduced to a histogram of at most ``capacity``
counts, the packing is solved on it with multiplicities, and the solution, a table
whose length depends on the capacity and not on the corpus, deals every item to its
place by its ordinal among the items of its size.

Solving: full pieces fill sequences of their own.  Items above a third of the
capacity can stand at most two in a sequence; from the largest down, each takes
the largest partner that fits.  Smaller items, from the largest down, go to the
tightest gap that holds them; what fits no gap opens new sequences.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.tokens import encoded
from harrow.plans.scratch import stage

END_ID = 0


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(sequences, [(size, copies), ...])]: patterns that use every item once."""
    left = {s: n for s, n in histogram.items() if n}
    done: list[tuple[int, list[tuple[int, int]]]] = []
    open_: dict[int, list[list]] = {}

    def put(n: int, pattern: list[tuple[int, int]]) -> None:
        gap = capacity - sum(s * k for s, k in pattern)
        if gap:
            open_.setdefault(gap, []).append([n, pattern])
        else:
            done.append((n, pattern))

    big = sorted(s for s in left if 3 * s > capacity)
    while big:
        size = big.pop()
        n = left.pop(size)
        while n:
            # the largest partner that fits, of the same size at most
            if 2 * size <= capacity and n > 1:
                put(n // 2, [(size, 2)])
                n %= 2
                continue
            at = bisect.bisect_right(big, capacity - size) - 1
            if at < 0:
                put(n, [(size, 1)])
                break
            mate = big[at]
            k = min(n, left[mate])
            put(k, [(size, 1), (mate, 1)])
            n -= k
            left[mate] -= k
            if not left[mate]:
                del left[mate]
                big.pop(at)
    heap = sorted(open_)
    for size in sorted(left, reverse=True):
        n = left[size]
        later: list[int] = []
        while n and heap:
            gap = heapq.heappop(heap)
            if gap < size:
                later.append(gap)  # too tight for this size, not for smaller ones
                continue
            fits = gap // size
            for group in open_.pop(gap, []):
                bins, pattern = group
                take = min(bins, n // fits) if n >= fits else 0
                rest = bins - take
                if take:
                    n -= take * fits
                    _reopen(open_, heap, done, take, [*pattern, (size, fits)], gap - size * fits)
                if n and rest and n < fits:
                    _reopen(open_, heap, done, 1, [*pattern, (size, n)], gap - size * n)
                    n, rest = 0, rest - 1
                if rest:
                    _reopen(open_, heap, done, rest, pattern, gap)
        for gap in later:
            heapq.heappush(heap, gap)
        if n:
            fits = capacity // size
            for bins, copies in ((n // fits, fits), (1, n % fits)):
                if bins and copies:
                    _reopen(open_, heap, done, bins, [(size, copies)], capacity - size * copies)
    return done + [(n, p) for groups in open_.values() for n, p in groups]


def _reopen(open_: dict, heap: list[int], done: list, n: int, pattern: list, gap: int) -> None:
    if not gap:
        done.append((n, pattern))
        return
    if gap not in open_:
        open_[gap] = []
        heapq.heappush(heap, gap)
    open_[gap].append([n, pattern])


def deals(patterns: list[tuple[int, list[tuple[int, int]]]]) -> tuple[dict[int, np.ndarray], int]:
    """For each size, rows (first ordinal, first sequence, copies, offset); and the number of sequences."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    next_ordinal: dict[int, int] = {}
    base = 0
    for n, pattern in patterns:
        offset = 0
        for size, copies in pattern:
            o = next_ordinal.get(size, 0)
            rows.setdefault(size, []).append((o, base, copies, offset))
            next_ordinal[size] = o + n * copies
            offset += size * copies
        base += n
    return {s: np.array(r, np.int64) for s, r in rows.items()}, base


def _cut(path: str, capacity: int):
    """Pieces of each document, with the ordinal of each size inside its block of rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("block", pa.string()), ("nth", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        block, used = uuid.uuid4().hex, np.zeros(capacity + 1, np.int64)
        for batch, ids in encoded(batches, path):
            rows: list[list] = [[] for _ in schema]
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                data += END_ID.to_bytes(4, "little")
                n = len(data) // 4
                start, piece = 0, 0
                while start < n:
                    size = (n - start - 1) % capacity + 1 if piece == 0 else capacity
                    for column, value in zip(rows, (doc_id, piece, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), block, int(used[size])), strict=True):
                        column.append(value)
                    used[size] += 1
                    start, piece = start + size, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return cut


def _place(table: dict[int, np.ndarray]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, ordinal = np.asarray(batch.column("length")), np.asarray(batch.column("ordinal"))
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                at, rows = size == s, table[int(s)]
                k = np.searchsorted(rows[:, 0], ordinal[at], side="right") - 1
                first, base, copies, start = rows[k].T
                nth = ordinal[at] - first
                sequence[at], offset[at] = base + nth // copies, start + nth % copies * s
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Each text is encoded whole (null: empty) and ends with id 0, so even an empty
    document is one token.  Longer documents are cut into pieces of ``capacity``,
    of which the first may be shorter.  Returns doc_id, piece, start, length,
    ids_crc32, sequence_id, offset for each piece.  Rows that repeat an id are
    packed as rows of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stage(rows.mapInArrow(_cut(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, block string, nth long"), "pieces")
    # a block is what one task attempt wrote, so its ordinals are those of its rows
    counts = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")
    counts = stage(counts.withColumn("before", before), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table, _ = deals(solve(histogram, capacity))
    dealt = pieces.join(counts.drop("n").hint("merge"), ["block", "length"]).withColumn("ordinal", F.col("before") + F.col("nth"))
    return dealt.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
