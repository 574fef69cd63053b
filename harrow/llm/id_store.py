"""Token-id files with a minimal perfect hash index.

A shard file holds, in this order and all little-endian:

    8 bytes   b"HARROWID"
    u32       bytes of one id (2, or 4 where an id does not fit in 2)
    u32       levels of the hash
    u64       documents
    u64       ids
    u64 each  slots of each level
    bits      one bit for each slot of all levels, packed, padded to 8 bytes
    u64 each  fingerprint of the key in each place
    u64 each  first id of the document in each place
    u64 each  number of ids of the document in each place
    i64 each  keys in file order: document id (0 where null)
    u64 each  keys in file order: 2 * (rows of that id before it) + (1 if null)
    payload   ids of all documents, ascending by document id

The hash is minimal and perfect: level by level, keys that are alone in their slot
set its bit and the others go on to the next level; a key's place is the number of
bits set before its own.  A lookup is a handful of bit tests, one fingerprint
comparison and one read of the payload.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.kernels import mix
from harrow.llm.tokens import encoded
from harrow.plans.scratch import fresh_path, stage

MAGIC = b"HARROWID"
END_ID = 0
#: A shard is closed when its payload reaches this many bytes.
SHARD_BYTES = 32 << 20
_SLOTS_PER_KEY = 2
_U = np.uint64


def key_hashes(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return mix(ids.view(_U) ^ mix(marks + _U(0x51ED270B)))


def _slot(hashes: np.ndarray, level: int, slots: int) -> np.ndarray:
    return (mix(hashes ^ _U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % _U(slots)).astype(np.int64)


def build_hash(hashes: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Slots of each level, and the bits of all levels.  Hashes must differ."""
    sizes, bits, rest = [], [], hashes
    while len(rest):
        slots = _SLOTS_PER_KEY * len(rest)
        at = _slot(rest, len(sizes), slots)
        alone = np.bincount(at, minlength=slots) == 1
        sizes.append(slots)
        bits.append(alone)
        rest = rest[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def find(hashes: np.ndarray, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Place of each key, or -1 where no level has it."""
    place = np.full(len(hashes), -1, np.int64)
    todo, base = np.arange(len(hashes)), 0
    for level, slots in enumerate(sizes):
        at = base + _slot(hashes[todo], level, slots)
        hit = bits[at]
        place[todo[hit]] = ranks[at[hit]]
        todo, base = todo[~hit], base + slots
    return place


def pack_shard(ids: np.ndarray, marks: np.ndarray, docs: list[np.ndarray]) -> bytes:
    lengths = np.array([len(d) for d in docs], "<u8")
    starts = np.cumsum(lengths, dtype="<u8") - lengths
    hashes = key_hashes(ids, marks)
    sizes, bits = build_hash(hashes)
    place = find(hashes, sizes, bits, np.cumsum(bits) - bits)
    columns = np.zeros((3, len(ids)), "<u8")
    columns[:, place] = mix(hashes + _U(1)), starts, lengths
    payload = np.concatenate(docs) if docs else np.zeros(0, "<u4")
    width = 2 if not len(payload) or payload.max() < 1 << 16 else 4
    packed = np.packbits(bits, bitorder="little").tobytes()
    head = MAGIC + struct.pack("<IIQQ", width, len(sizes), len(ids), len(payload)) + np.array(sizes, "<u8").tobytes()
    return b"".join([head, packed, bytes(-len(packed) % 8), columns.tobytes(), ids.astype("<i8").tobytes(), marks.astype("<u8").tobytes(), payload.astype(f"<u{width}").tobytes()])


class Shard:
    """A shard file that is open for keyed reads; only the payload of a read is fetched."""

    def __init__(self, handle):
        self.handle = handle
        magic, self.width, levels, n, self.total = struct.unpack("<8sIIQQ", handle.read(32))
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        self.sizes = np.frombuffer(handle.read(8 * levels), "<u8").astype(int).tolist()
        slots = sum(self.sizes)
        packed = np.frombuffer(handle.read(-(-slots // 64) * 8), np.uint8)
        self.bits = np.unpackbits(packed, bitorder="little")[:slots].astype(bool)
        self.ranks = np.cumsum(self.bits) - self.bits
        self.prints, self.starts, self.lengths, ids, self.marks = np.frombuffer(handle.read(40 * n), "<u8").reshape(5, n)
        self.ids = ids.view("<i8")
        self.payload_at = handle.tell()

    def places(self, ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
        hashes = key_hashes(ids, marks)
        place = find(hashes, self.sizes, self.bits, self.ranks)
        known = place >= 0
        known[known] = self.prints[place[known]] == mix(hashes[known] + _U(1))
        return np.where(known, place, -1)

    def read(self, start: int, length: int) -> np.ndarray:
        self.handle.seek(self.payload_at + int(start) * self.width)
        return np.frombuffer(self.handle.read(int(length) * self.width), f"<u{self.width}").astype("<u4")

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """Ids of a document, or None if the shard does not have it."""
        key = np.array([doc_id or 0], np.int64), np.array([2 * nth + (doc_id is None)], _U)
        place = int(self.places(*key)[0])
        return None if place < 0 else self.read(self.starts[place], self.lengths[place])


def open_file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _write(tokenizer: str, folder: str, shard_bytes: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = open_file_system(folder)
        part, seq, last, nth = TaskContext.get().partitionId(), 0, object(), 0
        ids, marks, docs, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            # an attempt that is lost leaves a file that no manifest names
            path = f"{root}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
            with where.open_output_stream(path) as out:
                out.write(pack_shard(np.array(ids, np.int64), np.array(marks, _U), docs))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, seq, path, len(docs), sum(map(len, docs))), schema, strict=True)], schema=schema)

        for batch, encodings in encoded(batches, tokenizer):
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encodings, strict=True):
                nth = nth + 1 if doc_id == last else 0
                last = doc_id
                ids.append(doc_id or 0)
                marks.append(2 * nth + (doc_id is None))
                docs.append(np.frombuffer(data + END_ID.to_bytes(4, "little"), "<u4"))
                size += len(docs[-1]) * 2
                if size >= shard_bytes:
                    yield close()
                    ids, marks, docs, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield close()

    return write


@dataclass
class IdStore:
    """Written shards: (path, ids of all documents before it), in order of document id."""

    uri: str
    shards: list[tuple[str, int]]

    def open(self, k: int) -> Shard:
        return Shard(open_file_system(self.uri)[0].open_input_file(self.shards[k][0]))


def write_ids(docs: DataFrame, tokenizer: str, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> IdStore:
    """Write the ids of all documents below ``uri``, a folder that all executors share.

    Each text is encoded whole (null: empty) and ends with id 0.  Documents ascend
    by id, null first; rows that repeat an id follow each other, by text.
    """
    spark = docs.sparkSession
    uri = uri or fresh_path(spark, "ids")
    where, root = open_file_system(uri)
    where.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.hash("text"))
    manifest = stage(rows.mapInArrow(_write(tokenizer, uri, shard_bytes), "part int, seq int, path string, n_docs long, n_tokens long"), "manifest")
    # a row for each shard of 32 MB, as Spark itself keeps one for each task
    shards, before = [], 0
    for r in manifest.orderBy("part", "seq").collect():
        shards.append((r["path"], before))
        before += r["n_tokens"]
    return IdStore(uri, shards)


def _read(uri: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = open_file_system(uri)
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_file(row["path"]) as handle:
                    shard = Shard(handle)
                    place = shard.places(shard.ids, shard.marks)
                    if (place < 0).any():
                        raise ValueError(f"the index of {row['path']} misses keys of its own")
                    starts, lengths = shard.starts[place].astype(np.int64), shard.lengths[place].astype(np.int64)
                    sums = [zlib.crc32(shard.read(s, n).tobytes()) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                    ids = pa.array(shard.ids, mask=(shard.marks & _U(1)).astype(bool))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts + row["before"]), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_ids(spark: SparkSession, store: IdStore) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, by keyed reads of the files."""
    shards = spark.createDataFrame(store.shards, "path string, before long").repartition(max(1, len(store.shards)))
    return shards.mapInArrow(_read(store.uri), "doc_id long, start long, n_tokens long, ids_crc32 long")
