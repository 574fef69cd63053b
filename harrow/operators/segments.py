"""An index of immutable segments: small updates, merges by size, searches that stop early.

A segment is written once: files/, chunks/ and blocks/, folders of Parquet.  An update
writes one segment of what is new or changed, and tombstones for what it replaces;
segments of about the same size are merged, which drops their dead rows.  A manifest,
written last, names the segments and tombstones that make up the index.

Chunks of a segment are sorted by tier and length and cut into ranges of
``RANGE_CHUNKS``.  A block has all postings of one term in one range, and a header with
the largest frequency and the least length there, which bound what BM25 can make of it
whatever the corpus statistics are.  A search reads headers first, scores the most
promising ranges, and then only those whose bound reaches the k-th score found.
"""

from __future__ import annotations

import math
import time
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions.text import ASCII, LATIN, bigrams, tokens
from harrow.operators import index, lexical
from harrow.operators.lexical import K1, LEAST_IDF, SYMBOL_BOOST, B
from harrow.operators.chunking import chunks
from harrow.operators.paths import IgnoreRules, in_scope, skip_counts, skip_reason, test_tier
from harrow.plans.scratch import stage
from harrow.plans.ship import ship

RANGE_CHUNKS = 64
#: Segments of one size class that are merged into one of the next; a class is this many times the one before.
MERGED = 4
#: Chunks of the smallest size class.
CLASS_CHUNKS = 1_000
#: Bytes of text whose blocks are put in order together; what a task holds at a time.
RUN_BYTES = 16 << 20
#: The form of what is stored; an index of another form is built anew.
LAYOUT = 3
#: Ranges of each query that are scored before any bound is compared.
LEAD_RANGES = 4
#: Sums of bounds and of scores add up in different orders; bounds are larger by this part.
SLACK = 1e-9
#: Queries of one plan.
QUERIES_AT_ONCE = 1_024
#: Up to so many headers, and bounds of ranges, are held by the driver as a local table.
ONE_TASK_HEADERS = 100_000
#: The plans over an index of up to so many blocks are one task each.
ONE_TASK_BLOCKS = 1_000_000
#: Ranges up to this many are named in the filter of a scan.
SCAN_RANGES = 1_000
#: Hashes of paths that every task may hold, 16 bytes each, so that texts of other paths are not moved.
HASHED_PATHS = 2_000_000

CHUNKS = "chunk_id long, path string, seq int, start_line int, end_line int, symbol_kind string, symbol_name string, text string, lang string, low_confidence boolean, content_hash string"
#: The blocks of one term in one run of a task are a row; ``range`` is the first one's, ``n`` and ``tokens`` are sums.
#: ``heads`` has ``_HEAD`` words of 4 bytes for each block: range (2), n, tokens, max_tf, min_dl, and twice the tier plus
#: one if a symbol has the term.  ``packed`` has the blocks in the same order, each with ids (8 bytes each), lengths,
#: frequencies and places (4 bytes each), little-endian.
_GROUPS = "term string, range long, blocks int, n int, tokens int, heads binary, packed binary"
_HEAD = 7
_BLOCKS = "range long, n int, tokens int, max_tf int, min_dl int, tier int, named boolean"
_PACKED = ["n", "tokens", "packed"]
_PLACE_BITS = 28


@dataclass(frozen=True)
class Segment:
    """What the manifest knows of a segment; ``dead`` chunks and their tokens still stand in it."""

    name: str
    ordinal: int
    chunks: int
    tokens: int
    headers: int
    files: int
    dead: int = 0
    dead_tokens: int = 0
    dead_files: int = 0

    def size_class(self) -> int:
        return max(0, math.ceil(math.log(max(1, self.chunks - self.dead) / CLASS_CHUNKS, MERGED)))


def _latin_fold() -> tuple[np.ndarray, np.ndarray]:
    """What becomes of a character up to U+017F: its first and second byte; 0 is no byte, and twice 0 no part of a word."""
    first, second = np.zeros(0x180, np.uint8), np.zeros(0x180, np.uint8)
    fold = str.maketrans(LATIN, ASCII)
    for code in range(0x180):
        out = chr(code).translate(fold).lower()
        if unicodedata.category(out)[0] in "LN":
            raw = out.encode()
            first[code], second[code] = raw[0], raw[1] if len(raw) > 1 else 0
    return first, second


#: Texts without a character beyond this are cut into words by tasks in one sweep over their bytes.
_BEYOND = "[^\\x00-\\u017f]"
_FIRST, _SECOND = _latin_fold()
#: What becomes of a byte that is a character; others are looked up by two.
_OF_BYTE = np.append(_FIRST[:128], np.zeros(128, np.uint8))


def _latin_words(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """Row and word of every token of texts up to U+017F, as ``functions.text.tokens`` cuts them."""
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.int32), pa.array([], pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    source = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    edges = offsets.astype(np.int64) - offsets[0]
    raw = _OF_BYTE[source]
    word = raw != 0
    lead = np.flatnonzero((source >= 0xC2) & (source <= 0xC5))
    code = ((source[lead] & 0x1F).astype(np.int32) << 6) | (source[lead + 1] & 0x3F)
    raw[lead], raw[lead + 1] = _FIRST[code], _SECOND[code]
    word[lead] = word[lead + 1] = _FIRST[code] != 0
    fresh = np.zeros(len(raw) + 1, bool)  # where a text begins, the one before has ended
    fresh[edges] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | fresh[1:-1]
    starts = np.flatnonzero(starts)
    if not len(starts):
        return starts, pa.array([], pa.string())
    keep = raw != 0
    sizes = np.add.reduceat(keep.view(np.uint8), starts, dtype=np.int32)
    bounds = np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32))
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw[keep]))
    return np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.searchsorted(starts, edges))), words


def _occurrences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Row, place and term of every token; those of a row by column and place."""
    at, places, words = [], [], []
    for c, name in enumerate(lexical.COLUMNS):
        plain, cut = batch.column(f"a_{name}"), batch.column(f"t_{name}")
        own = np.flatnonzero(np.asarray(plain.is_valid())).astype(np.int32)
        rows, found = _latin_words(plain.drop_null())
        others = np.asarray(cut.value_lengths().fill_null(0)).astype(np.int64)
        for which, tokens in ((own[rows], found), (np.repeat(np.arange(batch.num_rows, dtype=np.int32), others), cut.flatten())):
            first = np.flatnonzero(np.diff(which, prepend=-1))
            run = np.repeat(first.astype(np.int32), np.diff(np.append(first, len(which))))
            at.append(which)
            places.append(np.arange(c << _PLACE_BITS, (c << _PLACE_BITS) + len(which), dtype=np.int32) - run)
            words.append(tokens)
    return np.concatenate(at), np.concatenate(places), pa.concat_arrays(words).dictionary_encode()


def _order(numbers: np.ndarray, end: int) -> np.ndarray:
    """Stable order of numbers below ``end``; each is sorted with its place where both fit in a word, which is faster."""
    bits = len(numbers).bit_length()
    if end << bits >= 1 << 63:
        return np.argsort(numbers, kind="stable")
    return np.sort(numbers << bits | np.arange(len(numbers))) & ((1 << bits) - 1)


def _packing(n: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where packed blocks begin, and where ids, lengths, frequencies and places stand, in words of 4 bytes."""
    offsets = np.append(0, np.cumsum(4 * n.astype(np.int64) + tokens))
    inner = lambda sizes: np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    base, count, each = np.repeat(offsets[:-1], n), np.repeat(n, n), inner(n)
    return offsets, base + 2 * each, base + 2 * count + each, base + 3 * count + each, np.repeat(offsets[:-1] + 4 * n, tokens) + inner(tokens)


def _words(raw: pa.Array) -> np.ndarray:
    """Words of 4 bytes that binary values hold, one value after the other."""
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else [0]
    return np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<i4") if ends[-1] > ends[0] else np.zeros(0, "<i4")


def _binary(words: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary values of words of 4 bytes, cut at ``edges``."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(words))])


def _opener(keys: list[str], packed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(keys.., what heads say, packed if asked) of every block of rows of blocks."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, *[c.split()[0] for c in _BLOCKS.split(", ")], *(["packed"] if packed else [])]
        for batch in batches:
            head = _words(batch.column("heads")).reshape(-1, _HEAD)
            row = pa.array(np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("blocks"))))
            out = [batch.column(k).take(row) for k in keys]
            out.append(pa.array(np.ascontiguousarray(head[:, :2]).view("<i8").ravel()))
            out += [pa.array(np.ascontiguousarray(head[:, c])) for c in (2, 3, 4, 5)]
            out += [pa.array(head[:, 6] >> 1), pa.array((head[:, 6] & 1) == 1)]
            if packed:
                words = _words(batch.column("packed"))
                out.append(_binary(words, np.append(0, np.cumsum(4 * head[:, 2].astype(np.int64) + head[:, 3]))))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return opened


def _opened(groups: DataFrame, keys: list[str], packed: bool) -> DataFrame:
    """The blocks of rows of blocks, one row each."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in groups.select(*keys).schema]
    columns = [*keys, "blocks", "heads", *(["packed"] if packed else [])]
    return groups.select(*columns).mapInArrow(_opener(keys, packed), ", ".join([*kinds, _BLOCKS, *(["packed binary"] if packed else [])]))


def _unpacker(keys: list[str], places: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(keys.., chunk_id, dl, tf) of every posting of blocks, or (keys.., chunk_id, dl, place) of every token."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tokens = np.asarray(batch.column("n")), np.asarray(batch.column("tokens"))
            words = _words(batch.column("packed"))
            _, at_id, at_dl, at_tf, at_place = _packing(n, tokens)
            row = np.repeat(np.arange(batch.num_rows), n)
            id_, dl, last = np.stack([words[at_id], words[at_id + 1]], 1).astype("<i4").view("<i8").ravel(), words[at_dl], words[at_tf]
            if places:
                row, id_, dl, last = np.repeat(row, last), np.repeat(id_, last), np.repeat(dl, last), words[at_place]
            out = [batch.column(k).take(pa.array(row)) for k in keys]
            yield pa.RecordBatch.from_arrays([*out, pa.array(id_), pa.array(dl), pa.array(last)], names=[*keys, "chunk_id", "dl", "place" if places else "tf"])

    return unpack


def _unpacked(blocks: DataFrame, keys: list[str], places: bool = False) -> DataFrame:
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keys).schema]
    return blocks.select(*keys, *_PACKED).mapInArrow(_unpacker(keys, places), ", ".join([*kinds, "chunk_id long, dl int", "place int" if places else "tf int"]))


def _postings(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Blocks of the chunks of one batch, one for each term and range, in that order; a row has all of a term."""
    at, places, coded = _occurrences(batch)
    if not len(at):
        return None
    by_name = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(by_name), np.int64)
    rank[np.asarray(by_name)] = np.arange(len(by_name))
    ranges, row_range = np.unique(np.asarray(batch.column("range")), return_inverse=True)
    block = rank[np.asarray(coded.indices)] * len(ranges) + row_range[at]
    order = _order(block * batch.num_rows + at, len(rank) * len(ranges) * batch.num_rows)  # columns and places ascend already
    block, at, places = block[order], at[order], places[order]
    new_block = np.diff(block, prepend=-1) != 0
    posting = np.flatnonzero(new_block | (np.diff(at, prepend=-1) != 0))
    tf = np.diff(np.append(posting, len(at))).astype(np.int32)
    doc = at[posting]
    starts = np.searchsorted(posting, np.flatnonzero(new_block))
    edges = np.append(starts, len(posting))
    tokens = np.diff(np.append(posting[starts], len(at))).astype(np.int32)
    dl, tier = np.bincount(at, minlength=batch.num_rows).astype(np.int32), np.asarray(batch.column("tier")).astype(np.int32)
    ids = np.asarray(batch.column("chunk_id"))
    symbols = np.flatnonzero((places >> _PLACE_BITS) == lexical.COLUMNS.index("symbol"))
    which = block[posting[starts]]
    named = np.zeros(len(which), np.int32)
    named[np.searchsorted(posting[starts], symbols, "right") - 1] = 1
    n = np.diff(edges)
    words, heads = np.empty((4 * n + tokens).sum(), "<i4"), np.empty((len(n), _HEAD), "<i4")
    offsets, at_id, at_dl, at_tf, at_place = _packing(n, tokens)
    id_words = ids[doc].astype("<i8").view("<i4")
    words[at_id], words[at_id + 1] = id_words[::2], id_words[1::2]
    words[at_dl], words[at_tf], words[at_place] = dl[doc], tf, places
    heads[:, :2] = ranges[which % len(ranges)].astype("<i8").view("<i4").reshape(-1, 2)
    heads[:, 2], heads[:, 3] = n, tokens
    heads[:, 4], heads[:, 5] = np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl[doc], starts)
    heads[:, 6] = 2 * np.minimum.reduceat(tier[doc], starts) + named
    term = which // len(ranges)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    cuts = np.append(first, len(term))
    columns = [
        coded.dictionary.take(by_name.take(pa.array(term[first]))),
        pa.array(ranges[which[first] % len(ranges)]),
        pa.array(np.diff(cuts).astype(np.int32)),
        pa.array(np.add.reduceat(n, first).astype(np.int32)),
        pa.array(np.add.reduceat(tokens, first).astype(np.int32)),
        _binary(heads, _HEAD * cuts),
        _binary(words, offsets[cuts]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _GROUPS.split(", ")])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``RUN_BYTES``."""
    held, size = [], 0
    for whole in batches:
        step = max(1, whole.num_rows * RUN_BYTES // max(1, 4 * whole.nbytes))
        for lo in range(0, whole.num_rows, step):
            held.append(whole.slice(lo, step))
            size += held[-1].nbytes
            if size >= RUN_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and (rest := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield rest.to_batches()[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches):
        made = _postings(run)
        if made is not None:
            for lo in range(0, made.num_rows, OUT_ROWS):
                yield made.slice(lo, OUT_ROWS)


def _losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks that go, a row with the number of tokens; of each segment, in how many of them a term is."""
    for run in _runs(batches):
        at, _, coded = _occurrences(run)
        segment = np.asarray(run.column("segment")).astype(np.int64)
        none = pa.nulls(run.num_rows)
        sizes = pa.array(np.bincount(at, minlength=run.num_rows).astype(np.int32))
        kinds = pa.schema([("segment", pa.int32()), ("path", pa.string()), ("chunk_id", pa.int64()), ("tokens", pa.int32()), ("term", pa.string()), ("n", pa.int64())])
        yield pa.RecordBatch.from_arrays([run.column("segment").cast(pa.int32()), run.column("path"), run.column("chunk_id"), sizes, none.cast(pa.string()), none.cast(pa.int64())], schema=kinds)
        once = np.unique(np.asarray(coded.indices).astype(np.int64) * run.num_rows + at)
        term, row = once // run.num_rows, once % run.num_rows
        pairs, n = np.unique(segment[row] * max(1, len(coded.dictionary)) + term, return_counts=True)
        terms = coded.dictionary.take(pa.array(pairs % max(1, len(coded.dictionary))))
        none = pa.nulls(len(pairs))
        yield pa.RecordBatch.from_arrays([pa.array((pairs // max(1, len(coded.dictionary))).astype(np.int32)), none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.int32()), terms, pa.array(n.astype(np.int64))], schema=kinds)


_LOSSES = "segment int, path string, chunk_id long, tokens int, term string, n long"
#: Blocks that a task hands over at a time.
OUT_ROWS = 20_000


def _to_cut(chunks: DataFrame, *more: str | Column) -> DataFrame:
    """Columns for ``_occurrences``: Latin texts as they are, the tokens of others."""
    texts = {"text": (F.coalesce("text", F.lit("")), bigrams), "symbol": (F.coalesce("symbol_name", F.lit("")), None), "path": (F.coalesce("path", F.lit("")), None)}
    out = []
    for name in lexical.COLUMNS:
        text, prepare = texts[name]
        plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(_BEYOND)
        out += [F.when(plain, text).alias(f"a_{name}"), F.when(~plain, tokens(prepare(text) if prepare else text)).alias(f"t_{name}")]
    return chunks.select("chunk_id", *more, *out)


def write_segment(spark: SparkSession, store: str, ordinal: int, files: DataFrame, found: DataFrame) -> Segment:
    """Write files and chunks as a segment; chunks that have an id keep it."""
    ship(spark)
    name = f"segment-{ordinal:06d}-{uuid.uuid4().hex[:8]}"
    at = f"{store}/{name}"
    files.write.parquet(f"{at}/files")
    # tier and length are one column of their own, or each comparison of a sort would make them anew from path and text
    lead = F.shiftleft(test_tier(F.col("path")).cast("long"), 32) + F.length("text")
    row = F.monotonically_increasing_id()
    sort = ["lead", "path", "seq"]
    dealt = found.withColumn("lead", lead).repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("range", row)
    made = F.lit(ordinal).cast("long") * (1 << 48) + F.shiftright("range", 33) * (1 << 30) + F.col("range").bitwiseAND(F.lit((1 << 33) - 1))
    own = F.coalesce(F.col("chunk_id"), made) if "chunk_id" in found.columns else made
    dealt = dealt.withColumn("chunk_id", own).withColumn("range", F.shiftright("range", RANGE_CHUNKS.bit_length() - 1))
    dealt.withColumn("content_hash", F.sha2("text", 256)).select(*[c.split()[0] for c in CHUNKS.split(", ")], "range").write.parquet(f"{at}/chunks")
    stored = spark.read.schema(f"{CHUNKS}, range long").parquet(f"{at}/chunks")
    # a task writes the blocks of its own chunks, in the order of terms, so a search reads few pages of each file
    cut = _to_cut(stored, "range", test_tier(F.col("path")).cast("int").alias("tier"))
    # values of these hardly repeat, so a dictionary of them would be built in vain
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("heads", "packed")}
    cut.mapInArrow(_blocks, _GROUPS).write.options(compression="zstd", **plain, **{"parquet.compression.codec.zstd.level": "1"}).parquet(f"{at}/blocks")
    facts = spark.read.schema(_GROUPS).parquet(f"{at}/blocks").agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.sum("tokens")).first()
    return Segment(name, ordinal, stored.count(), facts[1] or 0, facts[0], spark.read.schema(_FILES).parquet(f"{at}/files").count())


def _bounds(heads: list, asked: list[tuple[str, bool, set[int]]], idf: dict[int, float], mean: float) -> dict[str, list[tuple]]:
    """(query_id, segment, range, tier, best) of each query's ranges, the most promising first."""
    blocks: dict[tuple[int, int], dict[int, tuple]] = {}
    for r in heads:
        if r["phrase"] in idf:
            most = idf[r["phrase"]] * r["max_tf"] * (K1 + 1) / (r["max_tf"] + K1 * (1 - B + B * r["min_dl"] / mean))
            own = blocks.setdefault((r["segment"], r["range"]), {})
            have = own.get(r["phrase"], (0.0, r["tier"], False))
            own[r["phrase"]] = max(have[0], most), min(have[1], r["tier"]), have[2] or r["named"]
    out = {}
    for query_id, every, phrases in asked:
        rows = []
        for (segment, range_), own in blocks.items():
            met = [own[p] for p in phrases if p in own]
            if met and (not every or len(met) == len(phrases)):
                best = -(sum(m for m, _, _ in met) * (1 + SLACK) + (SYMBOL_BOOST if any(x for _, _, x in met) else 0.0))
                rows.append((query_id, segment, range_, min(t for _, t, _ in met), best))
        out[query_id] = sorted(rows, key=lambda x: (x[3], x[4], x[1], x[2]))
    return out


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema, without the Python workers that an empty list of rows is given to."""
    return spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("x")).select("x.*")


def _of_paths(rows: DataFrame, paths: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` paths.  Where hashes of all of them are few, rows of other paths are left out before any join moves texts."""
    if n <= HASHED_PATHS:
        hashes = F.broadcast(paths.select(F.xxhash64("path").alias("path_hash")))
        rows = rows.join(hashes, F.xxhash64(rows["path"]) == hashes["path_hash"], "left_semi")
    return rows.join(paths, "path", "left_semi")


_TOMBSTONES = "segment int, path string, chunk_id long, tokens int"
_LOST = "segment int, term string, n long"
_FILES = "path string, size long, mtime_ns long, content_hash string, indexed_at long"


def build(spark: SparkSession, files: DataFrame, store: str, rules: IgnoreRules | None = None, max_files: int = 20_000, max_bytes: int = 1 << 20, extra: tuple[str, ...] = (), force: bool = False) -> dict:
    """Make the index in ``store`` hold what of files (path, size, mtime_ns, content_hash, text) may be indexed.

    Only new and changed files are chunked and written.  More than ``max_files`` files
    are an error, never a cut; the index that was there stays as it is.
    """
    judged = files.withColumn("reason", skip_reason(F.col("path"), F.col("size"), rules, max_bytes, extra))
    skipped = {r["reason"]: r["n"] for r in skip_counts(judged).filter("reason IS NOT NULL").collect()}
    good = judged.filter("reason IS NULL").drop("reason")
    total = good.count()
    if total > max_files:
        raise ValueError(f"{total} files, {max_files} allowed")
    redacted = {"redacted": 0}

    def made(fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        cut = stage(chunks(fresh.select("path", "text")), "chunks")
        kept, secrets = index.split_secrets(cut)
        redacted["redacted"] = secrets.count()
        return fresh.join(index.redacted_whole(kept, secrets), "path", "left_anti"), kept

    return SegmentIndex(spark, store).update(good, made, force, lambda: {"schema": index.SCHEMA_VERSION, "skipped": skipped, **redacted})


class SegmentIndex:
    """The index in a folder: ``update`` it with the files of now, ``search`` it."""

    def __init__(self, spark: SparkSession, store: str):
        ship(spark)
        self.spark, self.store = spark, store

    # -- what is there

    def manifest(self) -> dict | None:
        facts = index.read_marker(self.spark, self.store)
        return facts if facts and "segments" in facts and facts.get("layout") == LAYOUT else None

    def segments(self, facts: dict | None = None) -> list[Segment]:
        facts = facts or self.manifest()
        return [Segment(**s) for s in facts["segments"]] if facts else []

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.store}/{name}")

    def _of(self, part: str, schema: str, segments: list[Segment]) -> DataFrame:
        each = [self._read(f"{s.name}/{part}", schema).withColumn("segment", F.lit(s.ordinal)) for s in segments]
        return reduce(DataFrame.unionByName, each) if each else _none(self.spark, f"{schema}, segment int")

    def _dead(self, part: str, schema: str, facts: dict) -> DataFrame:
        each = [self._read(f"{t}/{part}", schema) for t in facts["tombstones"]]
        return reduce(DataFrame.unionByName, each) if each else _none(self.spark, schema)

    def _live(self, part: str, schema: str, facts: dict, segments: list[Segment], on: list[str]) -> DataFrame:
        rows = self._of(part, schema, segments)
        if not facts["tombstones"]:
            return rows
        return rows.join(self._dead("rows", _TOMBSTONES, facts).select("segment", *on).distinct(), ["segment", *on], "left_anti")

    def files(self, facts: dict | None = None) -> DataFrame:
        """path, size, mtime_ns, content_hash, indexed_at of the files that are indexed."""
        facts = facts or self.manifest()
        return self._live("files", _FILES, facts, self.segments(facts), ["path"]).drop("segment")

    def chunks(self) -> DataFrame:
        """All chunks that are alive."""
        facts = self.manifest()
        return self._live("chunks", CHUNKS, facts, self.segments(facts), ["path"]).drop("segment")

    def lengths(self) -> DataFrame:
        return lexical.lengths(index.searchable(self.chunks()))

    def postings(self) -> DataFrame:
        """(term, chunk_id, col, pos) of every token that is alive, from the blocks."""
        facts = self.manifest()
        x = _unpacked(_opened(self._of("blocks", _GROUPS, self.segments(facts)), ["segment", "term"], True), ["segment", "term"], True)
        if facts["tombstones"]:
            x = x.join(self._gone(facts), ["segment", "chunk_id"], "left_anti")
        names = F.array(*map(F.lit, lexical.COLUMNS))
        return x.select("term", "chunk_id", F.get(names, F.shiftright("place", _PLACE_BITS)).alias("col"), F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("pos"))

    def term_df(self) -> DataFrame:
        """(term, df) over live chunks; df comes from the sums of rows of blocks less what tombstones took."""
        facts = self.manifest()
        heads = self._of("blocks", _GROUPS, self.segments(facts)).groupBy("term").agg(F.sum("n").alias("n"))
        lost = self._dead("lost", _LOST, facts).groupBy("term").agg(F.sum("n").alias("lost"))
        return heads.join(lost, "term", "left").select("term", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("df")).filter("df > 0")

    def stats(self, facts: dict | None = None) -> tuple[int, float]:
        """Live chunks, and their mean length; the manifest knows both."""
        own = self.segments(facts)
        n, tokens = sum(s.chunks - s.dead for s in own), sum(s.tokens - s.dead_tokens for s in own)
        return n, tokens / n if n else 0.0

    def _gone(self, facts: dict) -> DataFrame:
        return self._dead("rows", _TOMBSTONES, facts).filter("chunk_id IS NOT NULL").select("segment", "chunk_id")

    # -- change

    def update(self, files: DataFrame, found: DataFrame | Callable[[DataFrame], tuple[DataFrame, DataFrame]], anew: bool = False, extra: Callable[[], dict] = dict) -> dict:
        """Make the index hold exactly ``files``.

        ``files`` (path, size, mtime_ns, content_hash, ..) is all that is to be indexed.
        ``found`` has the chunks (path, seq, .., text) of all paths, or makes of the new
        and changed files those that are listed, and their chunks; it is not asked for
        the others.  ``anew`` takes nothing over.  Returns the manifest.
        """
        began = time.time()
        facts = (None if anew else self.manifest()) or {"segments": [], "tombstones": [], "next": 1}
        if facts["segments"]:
            status = stage(index.changes(self.files(facts).select("path", "content_hash"), files), "changes")
            counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
        else:  # all files are new, and none of them need be hashed or moved to tell
            counts = {"new": files.count()}
        done = {"new": 0, "changed": 0, "deleted": 0, "unchanged": 0} | counts
        segments, tombstones = self.segments(facts), list(facts["tombstones"])
        if done["changed"] or done["deleted"]:
            segments, name = self._bury(facts, segments, status.filter("status IN ('changed', 'deleted')").select("path"), done["changed"] + done["deleted"])
            tombstones.append(name)
        ordinal = facts["next"]
        if done["new"] or done["changed"]:
            n, known = done["new"] + done["changed"], done["unchanged"]
            fresh = status.filter("status IN ('new', 'changed')").select("path") if known else None
            listed = _of_paths(files, fresh, n) if known else files
            if callable(found):
                listed, own = found(listed)
            else:
                own = _of_paths(found, fresh, n) if known else found
            listed = listed.select("path", "size", "mtime_ns", "content_hash", F.lit(int(began)).cast("long").alias("indexed_at"))
            segments.append(write_segment(self.spark, self.store, ordinal, listed, own))
            ordinal += 1
        facts = {"layout": LAYOUT, "segments": [asdict(s) for s in segments], "tombstones": tombstones, "next": ordinal}
        facts = self._merge(facts)
        facts |= {"files": sum(s["files"] - s["dead_files"] for s in facts["segments"]), "chunks": sum(s["chunks"] - s["dead"] for s in facts["segments"]), "changes": done, "updated_at": int(began), "ms": round(1000 * (time.time() - began))}
        facts |= extra()
        index.write_marker(self.spark, self.store, facts)
        return facts

    def _bury(self, facts: dict, segments: list[Segment], paths: DataFrame, n: int) -> tuple[list[Segment], str]:
        """Tombstones of the live rows of the ``n`` ``paths``: files, chunks, and what each term loses."""
        name = f"tombstones-{uuid.uuid4().hex[:12]}"
        gone = stage(_of_paths(self._live("chunks", CHUNKS, facts, segments, ["path"]), paths, n), "gone")
        ship(self.spark)
        lost = stage(_to_cut(gone, "segment", "path").mapInArrow(_losses, _LOSSES), "losses")
        own = self._live("files", _FILES, facts, segments, ["path"]).join(paths, "path", "left_semi").select("segment", "path", F.lit(None).cast("long").alias("chunk_id"), F.lit(0).alias("tokens"))
        rows = own.unionByName(lost.filter("term IS NULL").select("segment", "path", "chunk_id", "tokens"))
        rows.coalesce(8).write.parquet(f"{self.store}/{name}/rows")
        lost.filter("term IS NOT NULL").groupBy("segment", "term").agg(F.sum("n").alias("n")).write.parquet(f"{self.store}/{name}/lost")
        sums = self._read(f"{name}/rows", _TOMBSTONES).groupBy("segment").agg(F.count("chunk_id"), F.sum("tokens"), F.count_if(F.col("chunk_id").isNull())).collect()
        lost = {r[0]: r[1:] for r in sums}  # one row for each segment
        sum_ = lambda s, n, t, f: replace(s, dead=s.dead + n, dead_tokens=s.dead_tokens + t, dead_files=s.dead_files + f)
        return [sum_(s, *lost[s.ordinal]) if s.ordinal in lost else s for s in segments], name

    def _merge(self, facts: dict) -> dict:
        """Merge the segments of any size class that has ``MERGED`` of them, and mostly dead ones."""
        while True:
            segments = self.segments(facts)
            classes: dict[int, list[Segment]] = {}
            for s in segments:
                classes.setdefault(s.size_class(), []).append(s)
            todo = next((c for c in classes.values() if len(c) >= MERGED), None) or [s for s in segments if 2 * s.dead > s.chunks]
            if not todo:
                return facts
            facts = self._merged(facts, segments, todo)

    def _merged(self, facts: dict, segments: list[Segment], todo: list[Segment]) -> dict:
        files = self._live("files", _FILES, facts, todo, ["path"]).drop("segment")
        found = self._live("chunks", CHUNKS, facts, todo, ["path"]).drop("segment", "content_hash")
        gone = [s.ordinal for s in todo]
        left = [s for s in segments if s.ordinal not in gone]
        if any(s.chunks > s.dead for s in todo) or not files.isEmpty():
            left.append(write_segment(self.spark, self.store, facts["next"], files, found))
        tombstones = []
        if facts["tombstones"]:
            name = f"tombstones-{uuid.uuid4().hex[:12]}"
            rows = self._dead("rows", _TOMBSTONES, facts).filter(~F.col("segment").isin(gone))
            if not rows.isEmpty():
                rows.coalesce(8).write.parquet(f"{self.store}/{name}/rows")
                self._dead("lost", _LOST, facts).filter(~F.col("segment").isin(gone)).coalesce(8).write.parquet(f"{self.store}/{name}/lost")
                tombstones = [name]
        return {"layout": LAYOUT, "segments": [asdict(s) for s in left], "tombstones": tombstones, "next": facts["next"] + 1}

    def vacuum(self) -> int:
        """Delete the folders that the manifest does not name; how many there were."""
        facts = self.manifest()
        keep = {s["name"] for s in facts["segments"]} | set(facts["tombstones"])
        fs, p = index._path(self.spark, self.store)
        old = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith(("segment-", "tombstones-")) and f.getPath().getName() not in keep]
        for path in old:
            fs.delete(path, True)
        return len(old)

    # -- search

    def search(self, queries: dict[str, str], k: int = 10, scope: str | None = None, boost: bool = True, only_rung: int | None = None) -> tuple[DataFrame, dict]:
        """What ``lexical.search`` finds, and how many postings there were and were scored.

        Ties of tier and score go by (path, start_line), which is the order of ids in
        an index built at once.  Rungs are tried in turn, each by the queries that no
        rung before answered.  At most ``k`` rows of each query come to the driver.
        """
        if k < 1:
            raise ValueError("k must be at least 1")
        facts = self.manifest()
        out, work = [], {"postings": 0, "scored": 0}
        names = list(queries)
        for lo in range(0, len(names), QUERIES_AT_ONCE):
            waiting = {q: lexical.rungs(queries[q]) for q in names[lo : lo + QUERIES_AT_ONCE]}
            for rung_no in range(3):
                asked = [(q, rung_no, r[rung_no]) for q, r in waiting.items() if rung_no < len(r) and only_rung in (None, rung_no)]
                if not asked:
                    continue
                rows = self._rung(facts, asked, {q: lexical.identifiers(queries[q]) for q, _, _ in asked} if boost else {}, k, scope, work)
                out += rows
                found = {r[0] for r in rows}
                waiting = {q: r for q, r in waiting.items() if q not in found}
        schema = "query_id string, rung int, rank int, chunk_id long, path string, start_line int, bm25 double, score double"
        return self.spark.createDataFrame(out, schema), work

    def _entries(self, facts: dict, terms: list[str], columns: list[str]) -> DataFrame:
        """Blocks of the terms; each file has them in order, so a short list of terms opens few of its pages."""
        groups = self._of("blocks", _GROUPS, self.segments(facts)).filter(F.col("term").isin(terms))
        return _opened(groups, ["segment", "term"], "packed" in columns).select(*columns, "segment")

    def _rung(self, facts: dict, asked: list[tuple], symbols: dict[str, list[str]], k: int, scope: str | None, work: dict) -> list[tuple]:
        """Rows of the best ``k`` chunks of each query by one rung."""
        segments = self.segments(facts)
        n, mean = self.stats(facts)
        terms = sorted({t for _, _, r in asked for p in r.phrases for t in p})
        if not segments or not n or not terms:
            return []
        spark = self.spark
        numbers: dict[tuple[str, ...], int] = {}
        for _, _, r in asked:
            for p in r.phrases:
                numbers.setdefault(p, len(numbers))
        single = {p[0]: i for p, i in numbers.items() if len(p) == 1}
        long = {p: i for p, i in numbers.items() if len(p) > 1}
        ranges = sum(-(-s.chunks // RANGE_CHUNKS) for s in segments)
        # headers that few come to the driver, which then bounds ranges without a job
        small = max(len(terms), len(asked)) * ranges <= ONE_TASK_HEADERS
        narrow = (lambda df: df.coalesce(1)) if small and sum(s.headers for s in segments) <= ONE_TASK_BLOCKS else (lambda df: df)
        side = F.broadcast  # tables as long as the queries, which the driver holds
        alive = (lambda df: df.join(self._gone(facts), ["segment", "chunk_id"], "left_anti")) if facts["tombstones"] else (lambda df: df)

        def near(blocks: DataFrame, keep: DataFrame, few: list[int] | None) -> DataFrame:
            """Rows of the ranges to keep; a short list of them reaches the scan."""
            return narrow(blocks.join(keep, ["segment", "range"], "left_semi") if few is None else blocks.filter(F.col("range").isin(few)))

        def postings_of(blocks: DataFrame) -> DataFrame:
            return alive(_unpacked(blocks, ["phrase", "segment", "range"]))

        heads, parts = [], []
        known = [(p, i) for p, i in single.items()]
        if single:
            names = side(spark.createDataFrame(known, "term string, phrase int"))
            head = narrow(self._entries(facts, list(single), ["term", "range", "n", "max_tf", "min_dl", "tier", "named"])).join(names, "term")
            heads.append(head.select("phrase", "segment", "range", "n", "max_tf", "min_dl", "tier", "named"))
            parts.append(lambda keep, few: postings_of(near(self._entries(facts, list(single), ["term", "range", *_PACKED]), keep, few).join(names, "term")))
        if long:
            counted = stage(self._phrases(facts, long, alive), "phrases")
            tier = F.lit(0)  # the least there is bounds any
            heads.append(counted.groupBy("phrase", "segment", "range").agg(F.count("*").cast("int").alias("n"), F.max("tf").cast("int").alias("max_tf"), F.min("dl").alias("min_dl")).select("phrase", "segment", "range", "n", "max_tf", "min_dl", tier.alias("tier"), F.lit(True).alias("named")))
            parts.append(lambda keep, few: near(counted, keep, few))
        heads = narrow(reduce(DataFrame.unionByName, heads))
        lost = {}
        if facts["tombstones"] and single:
            gone = self._dead("lost", _LOST, facts).filter(F.col("term").isin(list(single))).groupBy("term").agg(F.sum("n").alias("n"))
            lost = {single[r["term"]]: r["n"] for r in gone.collect()}  # one row for each term asked
        rows = heads.collect() if small else []
        counts: dict[int, int] = {}
        for phrase, n_ in ((r["phrase"], r["n"]) for r in (rows if small else heads.groupBy("phrase").agg(F.sum("n").alias("n")).collect())):
            counts[phrase] = counts.get(phrase, 0) + n_
        df = {p: f - lost.get(p, 0) for p, f in counts.items() if f > lost.get(p, 0)}
        work["postings"] += sum(df[p] for _, _, r in asked for p in {numbers[x] for x in r.phrases} if p in df)
        if not df:
            return []
        idf = {p: raw if (raw := math.log((n - f + 0.5) / (f + 0.5))) > 0 else LEAST_IDF for p, f in df.items()}
        weights = spark.createDataFrame([(q, r.every, len(r.phrases), numbers[p], idf[numbers[p]]) for q, _, r in asked for p in r.phrases if numbers[p] in idf], "query_id string, every boolean, wanted int, phrase int, idf double")
        gain = lambda tf, dl: F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))
        place = "query_id string, segment int, range long"
        if small:
            bounds = _bounds(rows, [(q, r.every, {numbers[p] for p in r.phrases}) for q, _, r in asked], idf, mean)
            lead = [x for own in bounds.values() for x in own[:LEAD_RANGES]]
        else:
            per = heads.join(F.broadcast(weights), "phrase").groupBy("query_id", "every", "wanted", "segment", "range", "phrase").agg(F.max(gain(F.col("max_tf"), F.col("min_dl"))).alias("most"), F.min("tier").alias("tier"), F.max("named").alias("named"))
            found = per.groupBy("query_id", "every", "wanted", "segment", "range").agg(F.sum("most").alias("most"), F.count("*").alias("met"), F.min("tier").alias("tier"), F.max("named").alias("named")).filter("NOT every OR met = wanted")
            best = -(F.col("most") * (1 + SLACK) + F.when(F.col("named"), SYMBOL_BOOST).otherwise(0.0))
            bounds = stage(found.select("query_id", "segment", "range", "tier", best.alias("best")), "bounds")
            first_ones = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "best", "segment", "range"))
            lead = [tuple(r) for r in bounds.withColumn("place", first_ones).filter(F.col("place") <= LEAD_RANGES).select("query_id", "segment", "range", "tier", "best").collect()]

        def rank(ranges: DataFrame, few: list[int] | None) -> list:
            """The best ``k`` of each query in its ranges; ``few`` names the ranges if they are few."""
            keep = ranges.select("segment", "range").distinct()
            x = narrow(reduce(DataFrame.unionByName, [p(keep, few).select("phrase", "segment", "range", "chunk_id", "dl", "tf") for p in parts]))
            x = x.join(side(weights), "phrase").join(ranges, ["query_id", "segment", "range"], "left_semi")
            hits = x.groupBy("query_id", "every", "wanted", "segment", "chunk_id").agg(F.sum(gain(F.col("tf"), F.col("dl"))).alias("s"), F.count("*").alias("met")).filter("NOT every OR met = wanted")
            own = self._of("chunks", f"{CHUNKS}, range long", segments).select("segment", "range", "chunk_id", "path", "seq", "start_line", "symbol_name")
            own = near(own, keep, few)
            if few is not None:
                own = side(own)  # the chunks of SCAN_RANGES ranges at most
            hits = hits.join(own, ["segment", "chunk_id"]).filter(in_scope(F.col("path"), scope))
            score = -F.col("s")
            if symbols and any(symbols.values()):
                asks = spark.createDataFrame([(q, s, 1) for q, each in symbols.items() for s in each], "query_id string, symbol_name string, asks int")
                hits = hits.join(side(asks), ["query_id", "symbol_name"], "left")
                score = score - F.when(F.col("asks") == 1, SYMBOL_BOOST).otherwise(0.0)
            hits = hits.select("query_id", "met", test_tier(F.col("path")).alias("tier"), score.alias("score"), "path", "seq", "start_line", "chunk_id", (-F.col("s")).alias("bm25"))
            order = Window.partitionBy("query_id").orderBy("tier", "score", "path", "seq")
            scored = F.sum("met").over(Window.partitionBy("query_id"))
            return hits.withColumn("scored", scored).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).collect()

        def ranked(places: list[tuple]) -> list:
            few = sorted({r for _, _, r in places})
            return rank(side(spark.createDataFrame(places, place)), few if len(few) <= SCAN_RANGES else None) if places else []

        first = ranked([x[:3] for x in lead])
        held: dict[str, list] = {}
        for r in first:
            held.setdefault(r["query_id"], []).append(r)
        limits = {q: max((r["tier"], r["score"]) for r in rows) for q, rows in held.items() if len(rows) == k}
        if small:
            more = ranked([x[:3] for q, own in bounds.items() for x in own[LEAD_RANGES:] if q not in limits or x[3:] <= limits[q]])
        else:
            known = F.broadcast(spark.createDataFrame([(q, *v) for q, v in limits.items()], "query_id string, t int, s double"))
            done = F.broadcast(spark.createDataFrame([x[:3] for x in lead], place))
            rest = bounds.join(done, ["query_id", "segment", "range"], "left_anti").join(known, "query_id", "left")
            more = rank(rest.filter("t IS NULL OR tier < t OR (tier = t AND best <= s)").select("query_id", "segment", "range"), None)
        work["scored"] += sum({r["query_id"]: r["scored"] for r in rows_}.get(q, 0) for rows_ in (first, more) for q in {r["query_id"] for r in rows_})
        rung_no = asked[0][1]
        for r in more:
            held.setdefault(r["query_id"], []).append(r)
        out = []
        for q, rows in held.items():
            rows.sort(key=lambda r: (r["tier"], r["score"], r["path"], r["seq"]))
            out += [(q, rung_no, i + 1, r["chunk_id"], r["path"], r["start_line"], r["bm25"], r["score"]) for i, r in enumerate(rows[:k])]
        return out

    def _phrases(self, facts: dict, long: dict[tuple[str, ...], int], alive) -> DataFrame:
        """(phrase, segment, range, chunk_id, dl, tf) of phrases of several terms, from their places."""
        rows = [(i, o, t, len(p)) for p, i in long.items() for o, t in enumerate(p)]
        asked = F.broadcast(self.spark.createDataFrame(rows, "phrase int, offset int, term string, size int"))
        terms = sorted({r[2] for r in rows})
        x = self._entries(facts, terms, ["term", "range", *_PACKED]).join(asked, "term")
        x = _unpacked(x, ["phrase", "size", "offset", "segment", "range"], True).withColumn("start", F.col("place") - F.col("offset"))
        # a place that an offset takes below its column's first is in no phrase
        whole = x.groupBy("phrase", "size", "segment", "range", "chunk_id", "dl", "start").agg(F.count("*").alias("met")).filter("met = size")
        return alive(whole.groupBy("phrase", "segment", "range", "chunk_id", "dl").agg(F.count("*").cast("int").alias("tf")))
