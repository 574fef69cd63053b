"""Substring dedup by the interval tree of an enhanced suffix array (bytes).

Inside a shard, the suffixes that start at an anchor are sorted and their common
prefixes computed.  A stack scan over those visits every lcp-interval, the
internal nodes of the suffix tree.  An interval whose members are all preceded by
the same byte only repeats what a longer repeat says; the left-extension test
finds, for each member, how far it also agrees to the left with another member,
so that every maximal repeat is reported at all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from harrow.llm import kernels
from harrow.llm.recurrence import keyed, recurring_spans, span_arrays, with_spans

#: Bytes of the gram that windows choose as their anchor.
ANCHOR_BYTES = 24
MAX_VARIANTS = 50_000


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval, children before parents.

    ``lcp[i]`` is shared by the suffixes i-1 and i; lcp[0] is not read.
    """
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        here, left = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack and stack[-1][0] > here:
            depth, left = stack.pop()
            yield depth, left, i - 1
        if here and (not stack or stack[-1][0] < here):
            stack.append((here, left))


def maximal_repeats(heads: list[bytes], tails: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Repeats of at least ``least`` bytes around a common place of several strings.

    ``heads`` end and ``tails`` begin there.  Yields (bytes to the right, members,
    bytes to the left of each member) for each interval with such a member.
    """
    order = sorted(range(len(tails)), key=tails.__getitem__)
    lcp = [0] + [common_prefix(tails[i], tails[j]) for i, j in zip(order, order[1:], strict=False)]
    back = [h[::-1] for h in heads]
    by_left = sorted(range(len(back)), key=back.__getitem__)
    rank = np.empty(len(back), np.int64)
    rank[by_left] = np.arange(len(back))
    shared = np.array([0] + [common_prefix(back[i], back[j]) for i, j in zip(by_left, by_left[1:], strict=False)], np.int64)
    table = [shared]
    while 2 << len(table) - 1 <= len(shared):
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    levels = len(table)
    members = np.array(order, np.int64)
    most = max(map(len, back), default=0)
    for depth, first, last in lcp_intervals(lcp):
        if depth + most < least:
            continue
        own = members[first : last + 1]
        ranks = np.sort(rank[own])
        lo, hi = ranks[:-1] + 1, ranks[1:] + 1  # the least of shared[lo:hi] is what neighbours share
        level = np.minimum(np.log2(hi - lo).astype(np.int64), levels - 1)
        near = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            near[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << int(k))])
        left = np.maximum(np.append(near, 0), np.insert(near, 0, 0))
        if (left + depth).max() >= least:
            yield depth, np.asarray(by_left)[ranks], left


def _resolver(length: int):
    def resolve(shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        for anchor, group in shard.groupby("anchor", sort=False):
            bodies, at, n, regions = group["body"].tolist(), group["at"].tolist(), group["n"].tolist(), group["region"].tolist()
            # a region that stands in several places is there twice: what it repeats is itself
            own = [i for i, k in enumerate(n) for _ in range(min(k, 2))]
            spans: list[list[tuple[int, int]]] = [[] for _ in bodies]
            if len(own) > 1:
                for depth, members, left in maximal_repeats([bodies[i][: at[i]] for i in own], [bodies[i][at[i] :] for i in own], length):
                    for m, k in zip(members.tolist(), left.tolist(), strict=True):
                        if k + depth >= length:
                            i = own[m]
                            spans[i].append((at[i] - k, at[i] + depth))
            out += [(anchor, region, [{"s": s, "e": e} for s, e in kernels.merge_spans(np.array(x, np.int64)).tolist()]) for region, x in zip(regions, spans, strict=True) if x]
        return pd.DataFrame(out, columns=["anchor", "region", "spans"])

    return resolve


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, spans = span_arrays(batch.column("spans"))
        for lo, hi, raw, offsets in kernels.pieces(batch.column("text")):
            data = raw.tobytes()
            removed, runs, kept = [], [], []
            for k in range(hi - lo):
                text = data[offsets[k] : offsets[k + 1]]
                gone = kernels.merge_spans(spans[places[lo + k] : places[lo + k + 1]])
                edges = [0, *gone.ravel().tolist(), len(text)]
                kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(len(text) - len(kept[-1]))
                runs.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, max_variants: int = MAX_VARIANTS) -> DataFrame:
    """Remove every byte covered by a string of ``size`` bytes that also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that
    remain, perhaps not valid UTF-8).  Null texts are empty.  Matches stay inside a
    document but count within one too.  Rows that are there twice repeat each other.
    """
    rows = keyed(docs, id_col, text_col)
    spans = recurring_spans(rows, "byte", size, min(ANCHOR_BYTES, size), _resolver(size), max_variants)
    return with_spans(rows, spans).mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
