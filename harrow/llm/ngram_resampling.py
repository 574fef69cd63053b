"""Target-distribution importance resampling on word-id suffix arrays.

The words of a piece of documents become ids, and the suffixes that begin at each word
are sorted as far as the longest feature reaches.  Suffixes that share their first k
words then stand together, a run of the common-prefix array: the run is one distinct
n-gram, whose bytes are hashed once and whose bucket is scattered back to all places
where it occurs.  Bucket counts are summed over pieces, the gain of a bucket compares
its share of the target with its share of the raw documents, and a document's weight is
the sum of the gains at its places.  Gumbel noise from a hash of the id makes the
highest sums of weight and noise a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm import kernels
from harrow.plans.scratch import stage
from harrow.plans.ship import ship

#: Text of one suffix array, in bytes; a document is never split.
PIECE_TEXT = 4 << 20
#: Random bits of the noise: the first 8 hex digits of a digest.
NOISE_RANGE = 1 << 32


def _word_bytes() -> np.ndarray:
    """Which bytes belong to words: digits, letters and all that is not ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


_WORD = _word_bytes()


def word_ids(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids of the words (A-Z in lower case), the words by id, and the number of words before each document."""
    lower = raw | ((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5
    inside = _WORD[raw]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(lower[inside])])
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(starts, offsets)


def suffix_array(ids: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` words, and the words each shares with the one before.

    A suffix ends with its document.  Shared words are counted up to ``depth``.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    rank, known = ids + 1, 1
    while known < depth:  # prefix doubling: order of the first words, then of twice as many
        step = min(known, depth - known)
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:]
        after[left <= step] = 0
        _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
        rank, known = rank + 1, known + step
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    alike = np.ones(n - 1, bool)
    for k in range(depth):
        alike &= (left[a] > k) & (left[b] > k)
        alike[alike] = ids[a[alike] + k] == ids[b[alike] + k]
        shared[1:] += alike
    return order, shared


def bucket_places(raw: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features document by document, features before each document, words of each."""
    ids, words, bounds = word_ids(raw, offsets)
    n = len(ids)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    order, shared = suffix_array(ids, bounds, longest)
    at = np.full((n, longest), -1, np.int64)
    for k in range(1, longest + 1):
        real = left[order] >= k
        fresh = shared < k
        if n:
            fresh[0] = True
        run = np.cumsum(fresh) - 1  # runs of suffixes that share k words
        heads = order[fresh]
        hashed = np.zeros(len(heads), np.int64)
        for i in np.flatnonzero(real[fresh]).tolist():
            gram = words[ids[heads[i]]] if k == 1 else b" ".join(words[w] for w in ids[heads[i] : heads[i] + k].tolist())
            hashed[i] = zlib.crc32(gram) % buckets
        at[order[real], k - 1] = hashed[run[real]]
    sizes = np.diff(bounds)
    features = sum(np.maximum(sizes - k, 0) for k in range(longest))
    return at[at >= 0], np.concatenate([[0], np.cumsum(features)]), sizes


def _merged(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    yield from kernels.pieces(texts, PIECE_TEXT)


def _featurise(longest: int, buckets: int):
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in _merged(batch.column("text")):
                found, before, sizes = bucket_places(raw, offsets, longest, buckets)
                data = found.astype(kind).tobytes()
                width = np.dtype(kind).itemsize
                held = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((before * width).astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes), pa.array(np.diff(before)), held.cast(pa.binary())],
                    names=["doc_id", "n_words", "n_features", "buckets"],
                )

    return scan


def _tally(buckets: int):
    """Bucket counts of a task, one row for each bucket that it met."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(data, kind), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return tally


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; at most ``buckets`` rows come to the driver."""
    counts = np.zeros(buckets, np.int64)
    for bucket, n in features.select("buckets").mapInArrow(_tally(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of target share over raw share of each bucket, one added to every count."""
    buckets = len(raw)
    over, under = int(raw.sum()) + buckets, int(target.sum()) + buckets
    return np.array([math.floor(1000 * math.log((t + 1) * over / ((s + 1) * under))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray):
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[np.frombuffer(data, kind)].sum()) for data in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def _ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Places in the order of score among eligible rows; those beyond the share are null.

    Rows are sorted by ranges, so no task has more than a range; a range's first place
    follows from the sizes of those before it, one number for each range.
    """
    keys = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("uid")]
    dealt = scored.withColumn("eligible", F.col("n_words") >= least_words).repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"), F.count_if("eligible").alias("of")).orderBy("part").collect()
    drawn = percent * sum(r["of"] for r in sizes) // 100
    before, at = {}, 0
    for r in sizes:
        before[r["part"]] = at
        at += r["n"]
    if not before:
        return dealt.withColumn("rank", F.lit(None).cast("long"))
    first = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) + first
    return dealt.withColumn("place", place.cast("long")).withColumn("rank", F.when(F.col("eligible") & (F.col("place") <= drawn), F.col("place")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score, rank (and n_words) of each row.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case;
    features are all runs of 1 to ``longest`` words of one document.  ``percent`` of
    the rows with ``least_words`` words at least are drawn; the others' rank is null.
    Null and empty texts have no features and weigh 0.  A null id hashes as an empty
    one and comes last among equal scores; rows that are there twice are two
    candidates.  An empty target gives every bucket a count of 0; an empty table gives
    no rows.  Other columns are not read.  Memory of a task grows with its longest
    document, and with ``buckets``.
    """
    ship(docs.sparkSession)
    if not 1 <= buckets <= 1 << 24 or longest < 1:
        raise ValueError("features have at least one word and 1 to 2**24 buckets")
    schema = "doc_id long, n_words long, n_features long, buckets binary"
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    aims = target.select(F.lit(0).cast("long").alias("doc_id"), F.col(f"`{target_text}`").cast("string").alias("text"))
    features = stage(rows.mapInArrow(_featurise(longest, buckets), schema), "features")
    gain = gains(bucket_counts(features, buckets), bucket_counts(aims.mapInArrow(_featurise(longest, buckets), schema), buckets))
    weighed = features.mapInArrow(_weigh(gain), "doc_id long, n_words long, n_features long, weight long")
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(NOISE_RANGE)))))
    scored = stage(weighed.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("uid", F.monotonically_increasing_id()), "scored")
    return _ranked(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
