"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams, that of their hashes, is cut into fragments.  A document
sends each fragment the grams it has there, and every fragment is counted apart:

1. a fragment tells which of its grams stand in one text only.  Two sets that reach the
   threshold share a gram among the few first ones of each, by any order of grams that
   both follow; with private grams first, a document whose first ones are all private
   links with nothing.  That settles most documents, and the private grams of the others
   need never be looked at again: they are in no overlap;
2. the grams left are ordered by how many documents have them, and each document enters
   the list of each of its first grams, with its size and the gram's place.  Sizes and
   places decide which pairs of a list can reach the threshold at all;
3. the overlap of a candidate pair is counted fragment by fragment and summed per pair;
   a pair goes as soon as what is left cannot make up for what is missing.

Documents with equal sets are one class from the start.  At first the members of a list
only meet its centre; what that links needs no further comparison, and every other pair
of a list that could connect two components is compared after that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm import kernels
from harrow.llm.components import components
from harrow.plans.scratch import drop, stage, tidy
from harrow.plans.ship import ship

#: Bytes of text in a piece of documents, which sends its grams together; documents in one at most.
PIECE_TEXT, PIECE_DOCS = 8 << 20, 1 << 16
#: Bytes of text for each fragment in which grams are told apart.
FRAGMENT_TEXT = 8 << 20
#: Fragments in which the overlaps of pairs are counted, one after the other.
COUNTED = 4
#: Grams of a bundle of nodes, and of a deal whose frequencies are counted together, at least; deals at least.  Both hold so
#: many times the root of all grams, so that the rows from each bundle to each deal grow as the grams do, not as their square.
DEAL_GRAMS, DEALS, ROOT_GRAMS = 1 << 15, 16, 32
#: Of more nodes than this, grams in a fiftieth of a sample of about so many nodes come last in the order without being
#: counted; so many of them at most.
HOT_NODES, HOT_SAMPLE, HOT_GRAMS = 100_000, 1_000, 10_000
#: Entries of a list that one task compares others with.
LIST_ROWS = 4096
#: Bytes of a gram's hash that travel; the fragment adds the rest of its name.
GRAM_BYTES = 6
_U = np.uint64

_SENT = "piece long, fragment int, keys binary, who binary, known binary, docs binary"
_SAID = "piece long, fragment int, keys binary, who binary, docs binary"
_SETS = "doc_id long, th long, n long, digest binary, keys array<long>"
_SENT_BUNDLE = "deal int, bundle long, keys binary, counts binary, own binary"
_RANKED = "node long, n long, private long, first int, grams array<long>"
#: Stands for the frequency of grams that are not counted.
_MOST = np.iinfo(np.int32).max
_DOCS = np.dtype([("id", "<i8"), ("null", "?"), ("th", "<i8"), ("n", "<i8"), ("who", "<i4"), ("digest", "V16")])


def fragment_edges(grams: np.ndarray, fragments: int) -> np.ndarray:
    """Where sorted hashes pass from one of ``fragments`` equal ranges to the next."""
    cut = np.array([(i << 64) // fragments for i in range(1, fragments)], _U)
    return np.concatenate([[0], np.searchsorted(grams, cut), [len(grams)]])


def gram_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct word n-grams of each document (A-Z in lower case)."""
    raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
    starts, ends, bounds = kernels.word_spans(raw, offsets)
    prefix = kernels.Prefix(kernels.word_hashes(raw, starts, ends))
    grams, out = prefix.rolling(width), []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s >= width:
            own = np.sort(grams[s : e - width + 1])
            fresh = np.ones(len(own), bool)
            fresh[1:] = own[1:] != own[:-1]
            out.append(own[fresh])
        else:
            out.append(prefix.spans(np.array([s]), np.array([e])) if e > s else grams[:0])
    return out


def first_grams(n, parts: int, whole: int):
    """How many first grams of a set of size n must hold one that a near enough set has too."""
    return n + (-parts * n) // whole + 1


def _packed(grams: np.ndarray) -> bytes:
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES].tobytes()


def _unpacked(data: bytes, fragment: int) -> np.ndarray:
    """Names of grams: fragment and hash."""
    short = np.frombuffer(data, np.uint8).reshape(-1, GRAM_BYTES)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :GRAM_BYTES] = short
    return wide.view("<u8").ravel() + _U((fragment << 8 * GRAM_BYTES) % (1 << 64))


def _send(piece: int, held: list[tuple], fragments: int) -> pa.RecordBatch:
    """What a piece tells each fragment, and what it keeps for itself (fragment -1).

    A gram that several texts of the piece have is known to be shared and goes to its
    fragment once, so that no gram sends a fragment more than one entry for each piece.
    """
    docs = np.zeros(len(held), _DOCS)
    texts: dict[bytes, int] = {}
    sets = []
    for row, (doc_id, th, grams) in zip(docs, held, strict=True):
        digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
        if digest not in texts and len(grams):
            texts[digest] = len(sets)
            sets.append(grams)
        row["id"], row["null"], row["th"], row["n"], row["who"], row["digest"] = doc_id or 0, doc_id is None, th, len(grams), texts.get(digest, -1), np.void(digest)
    grams = np.concatenate(sets) if sets else np.zeros(0, _U)
    who = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(g) for g in sets])
    order = np.argsort(grams, kind="stable")
    grams, who = grams[order], who[order]
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(grams)))
    again = np.repeat(counts > 1, counts)
    edges = fragment_edges(grams, fragments)
    rows, local, local_who = [], [], []
    ends = np.zeros(fragments, "<i4")
    for f in np.flatnonzero(np.diff(edges)).tolist():
        at = slice(edges[f], edges[f + 1])
        g, w, many = grams[at], who[at], again[at]
        by = np.argsort(w[~many], kind="stable")
        rows.append((piece, f, _packed(g[~many][by]), w[~many][by].tobytes(), _packed(g[many & first[at]]), None))
        local.append(_packed(g[many]))
        local_who.append(w[many].tobytes())
        ends[f] = many.sum()
    header = np.array([len(rows), fragments], "<i4").tobytes() + ends.tobytes()
    rows.append((piece, -1, b"".join(local), b"".join(local_who), None, header + docs.tobytes()))
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["piece", "fragment", "keys", "who", "known", "docs"])


def _scan(width: int, fragments: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for lo, hi, raw, offsets in kernels.pieces(batch.column("text")):
                if held and (size + len(raw) > PIECE_TEXT or len(held) + hi - lo > PIECE_DOCS):
                    yield _send(piece, held, fragments)
                    piece, held, size = piece + 1, [], 0
                ids, ths = batch.column("doc_id").slice(lo, hi - lo).to_pylist(), batch.column("th").slice(lo, hi - lo).to_pylist()
                held += zip(ids, ths, gram_sets(raw, offsets, width), strict=True)
                size += len(raw)
        if held:
            yield _send(piece, held, fragments)

    return scan


def _tell(table: pa.Table) -> pa.Table:
    """For one fragment: each piece's grams that other texts have too.  Rows of fragment -1 pass."""
    rows = table.to_pylist()
    asked = [r for r in rows if r["docs"] is None]
    out = [(r["piece"], -1, r["keys"], r["who"], r["docs"]) for r in rows if r["docs"] is not None]
    if asked:
        short = np.frombuffer(b"".join(r["keys"] for r in asked), np.uint8).reshape(-1, GRAM_BYTES)
        keys = _unpacked(short.tobytes(), 0)
        known = _unpacked(b"".join(r["known"] for r in asked), 0)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        hit = np.zeros(len(keys), bool)
        hit[order[1:]] = same
        hit[order[:-1]] |= same
        hit |= np.isin(keys, np.unique(known))
        at = 0
        for r in asked:
            m = len(r["keys"]) // GRAM_BYTES
            own = hit[at : at + m]
            out.append((r["piece"], r["fragment"], short[at : at + m][own].tobytes(), np.frombuffer(r["who"], np.uint16)[own].tobytes(), None))
            at += m
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["piece", "fragment", "keys", "who", "docs"])


def _gather(parts: int, whole: int):
    """One row for each document of a piece; with its shared grams, if it can link and is the first of its class here."""

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        (own,) = (r for r in rows if r["docs"] is not None)
        sent, fragments = np.frombuffer(own["docs"], "<i4", 2).tolist()
        if sent != len(rows) - 1:
            raise RuntimeError("a piece of documents was cut differently when it was read again")
        known = np.frombuffer(own["docs"], "<i4", fragments, 8)
        docs = np.frombuffer(own["docs"], _DOCS, offset=8 + 4 * fragments)
        names = np.repeat(np.arange(fragments, dtype=_U), known) << _U(8 * GRAM_BYTES)
        keys = np.concatenate([_unpacked(own["keys"], 0) + names, *(_unpacked(r["keys"], r["fragment"]) for r in rows if r is not own)])
        who = np.concatenate([np.frombuffer(r["who"], np.uint16) for r in [own, *(r for r in rows if r is not own)]])
        order = np.argsort(who, kind="stable")
        keys = keys[order].astype("<u8").view(np.int64)
        ends = np.searchsorted(who[order], np.arange(int(docs["who"].max()) + 2))
        lists, seen = [], set()
        for w, n in zip(docs["who"].tolist(), docs["n"].tolist(), strict=True):
            shared = int(ends[w + 1] - ends[w]) if w >= 0 else 0
            can = shared and n - shared < first_grams(n, parts, whole) and w not in seen
            seen.add(w)
            lists.append(keys[ends[w] : ends[w + 1]] if can else None)
        return pa.Table.from_arrays(
            [
                pa.array(docs["id"], mask=docs["null"]),
                pa.array(docs["th"]),
                pa.array(docs["n"]),
                pa.array([d.tobytes() for d in docs["digest"]], pa.binary()),
                pa.array(lists, pa.list_(pa.int64())),
            ],
            names=["doc_id", "th", "n", "digest", "keys"],
        )

    return gather


def _hot(live: DataFrame, nodes: int) -> np.ndarray:
    """Grams that stand in a large share of a sample of many nodes; they are shared for certain."""
    if nodes <= HOT_NODES:
        return np.zeros(0, np.int64)
    some = live.filter(F.pmod(F.xxhash64("node"), F.lit(nodes // HOT_SAMPLE + 1)) == 0)
    often = some.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") >= max(2, HOT_SAMPLE // 50))
    return np.array([r["key"] for r in often.orderBy(F.desc("k"), "key").limit(HOT_GRAMS).collect()], np.int64)


def _send_bundle(bundle: int, held: list[pa.RecordBatch], deals: int, hot: np.ndarray) -> pa.RecordBatch:
    """The distinct grams of some nodes and how many of these have each, a row for each deal; hot ones stay with the nodes (deal -1)."""
    node, n = (np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("node", "n"))
    size = np.concatenate([np.asarray(b.column("keys").value_lengths()) for b in held]).astype("<i8")
    keys, at, counts = np.unique(np.concatenate([np.asarray(b.column("keys").flatten()) for b in held]), return_inverse=True, return_counts=True)
    dealt = (kernels.mix(keys.view(_U)) % _U(deals)).astype(np.int64)
    dealt[np.isin(keys, hot)] = -1
    order = np.argsort(dealt, kind="stable")
    place = np.empty(len(order), "<i4")
    place[order] = np.arange(len(order))
    keys, counts, dealt = keys[order], np.where(dealt < 0, _MOST, counts)[order].astype("<i4"), dealt[order]
    some = np.unique(np.append(dealt, -1))
    edges = np.append(np.searchsorted(dealt, some), len(keys))
    own = np.array([len(some), len(keys), len(node)], "<i8").tobytes() + np.concatenate([node, n, size]).astype("<i8").tobytes() + place[at].tobytes()
    rows = [(d, bundle, keys[lo:hi].tobytes(), counts[lo:hi].tobytes(), own if d < 0 else None) for d, lo, hi in zip(some.tolist(), edges[:-1], edges[1:], strict=True)]
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["deal", "bundle", "keys", "counts", "own"])


def _bundles(deals: int, grams: int, hot: np.ndarray):
    """What nodes (node, n, keys) send, in bundles of about so many grams."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(np.asarray(batch.column("keys").value_lengths()))])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + grams - size, side="right")) - 1)
                held.append(batch.slice(lo, hi - lo))
                size, lo = size + int(ends[hi] - ends[lo]), hi
                if size >= grams:
                    yield _send_bundle(bundle, held, deals, hot)
                    bundle, held, size = bundle + 1, [], 0
        if held:
            yield _send_bundle(bundle, held, deals, hot)

    return scan


def _frequencies(table: pa.Table) -> pa.Table:
    """For one deal: the number of nodes of all bundles that have each gram a bundle sent.  What bundles keep for themselves passes."""
    table = table.select(["deal", "bundle", "keys", "counts", "own"])
    if table.column("deal")[0].as_py() < 0:
        return table
    sent = table.column("keys").to_pylist()
    _, which = np.unique(np.frombuffer(b"".join(sent), "<i8"), return_inverse=True)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i4")
    df = np.minimum(np.bincount(which, counts), _MOST).astype("<i4")[which].tobytes()
    edges = np.cumsum([0, *(len(x) // 2 for x in sent)])  # 4 bytes for each 8
    return table.set_column(3, "counts", pa.array([df[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)], pa.binary()))


def _rank(parts: int, whole: int):
    """For one bundle: the nodes that can link, with their grams that another node has too, rarest first."""

    def rank(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["deal"])
        own = rows[0]["own"]
        sent, names, nodes = np.frombuffer(own, "<i8", 3).tolist()
        keys, df = np.frombuffer(b"".join(r["keys"] for r in rows), "<i8"), np.frombuffer(b"".join(r["counts"] for r in rows), "<i4")
        if (sent, names) != (len(rows), len(keys)):
            raise RuntimeError("a bundle of nodes was cut differently when it was read again")
        node, n, size = np.frombuffer(own, "<i8", 3 * nodes, 24).reshape(3, nodes)
        at = np.frombuffer(own, "<i4", offset=24 * (nodes + 1))
        row = np.repeat(np.arange(nodes), size)
        shared = df[at] > 1
        row, at = row[shared], at[shared]
        private = n - np.bincount(row, minlength=nodes)
        first = first_grams(n, parts, whole) - private
        can = first > 0
        row, at = row[can[row]], at[can[row]]
        by = np.lexsort((keys, df))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        order = np.argsort(row * len(by) + place[at])
        ends = np.concatenate([[0], np.cumsum((n - private)[can])]).astype(np.int32)
        grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[at[order]]))
        return pa.Table.from_arrays([pa.array(node[can]), pa.array(n[can]), pa.array(private[can]), pa.array(first[can].astype(np.int32)), grams], names=["node", "n", "private", "first", "grams"])

    return rank


def _lists(live: DataFrame, parts: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """(node, n, grams) of nodes that can link, and (mark, node, n, place): their first grams, rarest first.

    ``live`` is read more than once and has its rows in the same order each time.
    """
    nodes, total = live.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    each = max(DEAL_GRAMS, ROOT_GRAMS * math.isqrt(total))
    deals = max(DEALS, -(-total // each))
    sent = live.select("node", "n", "keys").mapInArrow(_bundles(deals, each, _hot(live, nodes)), _SENT_BUNDLE)
    # what a bundle keeps for itself goes to any task
    counted = sent.groupBy(F.when(F.col("deal") < 0, -F.col("bundle") - 1).otherwise(F.col("deal").cast("long")).alias("task")).applyInArrow(_frequencies, _SENT_BUNDLE)
    ranked = stage(counted.groupBy("bundle").applyInArrow(_rank(parts, whole), _RANKED), "ranked")
    marks = ranked.select("node", "n", "private", F.posexplode(F.slice("grams", F.lit(1), F.col("first"))).alias("i", "mark")).select("mark", "node", "n", (F.col("private") + F.col("i")).alias("place"))
    twice = marks.groupBy("mark").agg(F.count("*").alias("k")).filter("k > 1")
    return ranked, stage(marks.join(twice, "mark").select("mark", "node", "n", "place", "k"), "marks")


def _reach(a: str, b: str, parts: int, whole: int) -> Column:
    """Can a pair that has a gram at these places of these sizes reach the threshold?

    It needs an overlap of need = ceil(t / (1 + t) * (n + m)); the first gram it shares
    then stands before the last need - 1 grams of both.
    """
    need = F.ceil((F.col(f"{a}.n") + F.col(f"{b}.n")) * parts / (whole + parts))
    return (F.col(f"{a}.n") - F.col(f"{a}.place") >= need) & (F.col(f"{b}.n") - F.col(f"{b}.place") >= need)


def _linked(pairs: DataFrame, ranked: DataFrame, parts: int, whole: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: overlaps by fragment, summed per pair.

    ``k`` is the overlap so far; ``la`` and ``lb`` grams are not counted yet.
    """
    sizes = ranked.select("node", "n", F.size("grams").alias("left"))
    one = sizes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"))
    other = sizes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"))
    pairs = pairs.select("a", "b").join(one, "a").join(other, "b").withColumn("k", F.lit(0))
    for f in range(COUNTED):
        here = lambda gram: F.shiftright(gram, 8 * GRAM_BYTES - 2).bitwiseAND(F.lit(COUNTED - 1)) == f  # noqa: B023, E731
        part = ranked.select("node", F.filter("grams", here).alias("part"))
        x = pairs.join(part.select(F.col("node").alias("a"), F.col("part").alias("pa")), "a").join(part.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b")
        x = x.select("a", "b", "na", "nb", (F.col("k") + F.size(F.array_intersect("pa", "pb"))).alias("k"), (F.col("la") - F.size("pa")).alias("la"), (F.col("lb") - F.size("pb")).alias("lb"))
        pairs = x.filter((F.col("k") + F.least("la", "lb")) * (whole + parts) >= (F.col("na") + F.col("nb")) * parts)
    return pairs.select("a", "b")


def across(rows: DataFrame, parts: int, whole: int) -> DataFrame:
    """Pairs (a, b, na, nb) of entries (mark, x) of one list, of different labels, that can reach the threshold.

    An entry of size n whose gram has r of its grams from there on can meet sizes up to
    r * (1 + t) / t - n.  So lists are cut into classes of size, the smaller of a pair looks
    up the classes that it can meet, and entries that can meet nothing of their own size
    or more are only looked up.  In a list, those of the most frequent label need not meet
    each other.  Long lists are dealt to several tasks.
    """
    own = rows.groupBy("mark", "x.label").agg(F.count("*").alias("k"))
    main = own.groupBy("mark").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("k", "label")).alias("main"), F.ceil(F.sum("k") / LIST_ROWS).cast("int").alias("deals")).filter("labels > 1").drop("labels")
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(max(whole / parts, 1.05)))).cast("int")
    most = (F.floor((F.col("x.n") - F.col("x.place")) * (whole + parts) / parts) - F.col("x.n")).alias("most")
    every = stage(rows.join(main, "mark").select("mark", "x", "deals", (F.col("x.label") == F.col("main")).alias("is_main"), most), "several")
    asking = every.filter(F.col("most") >= F.col("x.n"))
    asking = asking.withColumn("class", F.explode(F.sequence(size_class(F.col("x.n")), size_class(F.col("most"))))).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    asked = every.select("mark", F.col("x").alias("y"), F.col("most").alias("ymost"), F.col("is_main").alias("y_main"), size_class(F.col("x.n")).alias("class"), F.pmod(F.xxhash64("x.node"), F.col("deals")).cast("int").alias("deal"))
    first = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    fits = first & (F.col("x.label") != F.col("y.label")) & (F.col("y.n") <= F.col("most")) & (F.col("x.n") <= F.col("ymost"))
    key = ["mark", "class", "deal"]
    met = asking.filter("NOT is_main").join(asked, key).filter(fits).select("x", "y").unionByName(asking.filter("is_main").join(asked.filter("NOT y_main"), key).filter(fits).select("x", "y"))
    p, q = F.least("x", "y"), F.greatest("x", "y")
    return met.select(p["node"].alias("a"), q["node"].alias("b"), p["n"].alias("na"), q["n"].alias("nb")).distinct()


def _connect(marks: DataFrame, ranked: DataFrame, parts: int, whole: int) -> DataFrame:
    """(node, label) of the nodes in lists.

    A label is the name of a node that its members are connected to.  First the members
    of each list meet its centre, then those meet that are not connected by that.
    """
    reach = _reach("x", "y", parts, whole)
    # a node in large lists is like what its group has in common, the text that others are copies of
    like = stage(marks.groupBy("node").agg(F.sum("k").alias("like")), "like")
    rows = marks.join(like, "node").select("mark", F.struct("node", "n", "place").alias("x"), "like")
    centres = rows.groupBy("mark").agg(F.max_by("x", F.struct("like", "x.node")).alias("y"))
    met = rows.join(centres, "mark").filter("x.node != y.node").filter(reach)
    pairs = stage(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
    links = stage(_linked(pairs, ranked, parts, whole), "links")
    labels = stage(like.select("node").join(components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    rows = stage(marks.join(labels, "node").select("mark", F.struct("node", "n", "place", "label").alias("x")), "open")
    pairs = stage(across(rows, parts, whole), "pairs")
    found = _linked(pairs, ranked, parts, whole)
    for side in ("a", "b"):
        found = found.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side)
    joined = components(found.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("label").alias("root"), F.col("node").alias("label"))
    return labels.join(joined, "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("text"))


def _labelled(rows: DataFrame, width: int, parts: int, whole: int) -> DataFrame:
    """doc_id, th, n_shingles, component_id, label of each keyed row; label is null without words."""
    spark = rows.sparkSession
    ship(spark)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(1, -(-size // FRAGMENT_TEXT))
    sent = rows.mapInArrow(_scan(width, fragments), _SENT)
    # what passes through goes to any task
    said = sent.groupBy(F.when(F.col("fragment") < 0, -F.col("piece") - 1).otherwise(F.col("fragment").cast("long")).alias("task")).applyInArrow(_tell, _SAID)
    sets = said.groupBy("piece").applyInArrow(_gather(parts, whole), _SETS).withColumn("uid", F.monotonically_increasing_id())
    wide = stage(sets, "sets")
    tidy(spark)
    sets = stage(wide.drop("keys"), "sets")
    some = sets.filter("n > 0")
    classes = stage(some.groupBy("digest").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least"), F.first("n").alias("n")), "classes")
    live = wide.filter("keys is not null").groupBy("digest").agg(F.first("keys").alias("keys"))
    live = stage(live.join(classes.select("digest", "node", "n"), "digest").select("node", "n", "keys"), "live")
    drop(wide)
    tidy(spark)
    ranked, marks = _lists(live, parts, whole)
    drop(live)
    tidy(spark)
    labels = _connect(marks, ranked, parts, whole)
    named = stage(classes.join(labels, "node", "left").select("digest", "least", F.coalesce("label", "node").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("digest", "label", "component_id")
    empty = sets.filter("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    return some.join(named, "digest").select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", "label").unionByName(empty)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, parts: int = 90, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row.

    Two documents link when parts/whole of the union of their sets of word
    ``width``-grams is shared.  Fewer words than ``width`` are one gram; null texts
    and texts without words have no set and link with nothing (component_id is their
    own id).  component_id is the smallest id reachable by links; null ids are
    passed over.  Rows that are there twice have equal sets.  An empty table gives no
    rows; other columns are not read.  A document is worked on whole: a task needs some
    hundred bytes of memory for each word of its longest one.
    """
    return _labelled(_keyed(docs, id_col, text_col), width, parts, whole).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, parts: int = 90, whole: int = 100) -> DataFrame:
    """All columns of the rows that stay: one of each component, with the smallest id.

    A component of null ids keeps one of them.  Of rows that share the id and are linked, or
    are there twice, one stays.  Rows without words link with nothing, so all of them stay.
    """
    found = stage(_labelled(_keyed(docs, id_col, text_col), width, parts, whole).select("doc_id", "th", "label"), "labelled")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("first")
    kept = found.filter("label is not null").groupBy("label").agg(first).select("first.doc_id", "first.th").distinct()
    rows = found.filter("label is not null").groupBy("doc_id", "th").agg(F.count("*").alias("rows"))
    # two components can keep rows that look alike here only if those are the same row
    kept = kept.join(rows, kept["doc_id"].eqNullSafe(rows["doc_id"]) & (kept["th"] == rows["th"])).select(kept["doc_id"], kept["th"], "rows")
    bare = found.filter("label is null").select("doc_id", "th").distinct().withColumn("rows", F.lit(1).cast("long"))
    kept = kept.unionByName(bare)
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))
    x = x.join(kept, x["doc_id"].eqNullSafe(kept["doc_id"]) & (x["th"] == kept["th"])).select("row", x["doc_id"], x["th"], "rows")
    single, twice = x.filter("rows = 1").select("row.*"), x.filter("rows > 1")
    once = twice.groupBy("doc_id", "th").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(once)
