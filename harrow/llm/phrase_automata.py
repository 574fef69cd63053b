"""Substring dedup by repeated-phrase automata (words).

Recurring passages are confirmed word by word inside their shard, compiled into
Aho-Corasick automata over word ids, and the regions of all documents that can
hold them are streamed through the automata to locate every occurrence.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from harrow.llm import kernels
from harrow.llm.recurrence import keyed, recurring_spans, span_arrays, with_spans

#: Phrases of one automaton; a shard compiles as many automata as it needs.
AUTOMATON_PHRASES = 2_000
#: Words of the gram that windows choose as their anchor.
ANCHOR_WORDS = 6
MAX_VARIANTS = 50_000


def recurring_phrases(regions: list[tuple[int, ...]], counts: list[int], length: int) -> set[tuple[int, ...]]:
    """Maximal runs of windows that occur at least twice among all regions."""
    seen: Counter = Counter()
    for words, n in zip(regions, counts, strict=True):
        for i in range(len(words) - length + 1):
            seen[words[i : i + length]] += n
    phrases = set()
    for words in regions:
        start = None
        for i in range(len(words) - length + 2):
            again = i <= len(words) - length and seen[words[i : i + length]] > 1
            if again and start is None:
                start = i
            elif not again and start is not None:
                phrases.add(words[start : i + length - 1])
                start = None
    return phrases


def locate(phrases: list[tuple[int, ...]], regions: list[tuple[int, ...]]) -> list[list[tuple[int, int]]]:
    """[start, end) of every occurrence of any phrase in each region."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases:
        automaton.add_word(phrase, len(phrase))
    automaton.make_automaton()
    return [[(end - size + 1, end + 1) for end, size in automaton.iter(words)] for words in regions]


def _resolver(length: int, per_automaton: int):
    def resolve(shard: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, list[dict]]] = []
        regions: list[tuple[int, ...]] = []
        keys: list[tuple[int, int]] = []
        phrases: set[tuple[int, ...]] = set()

        def stream() -> None:
            todo = list(phrases)
            spans: list[list[tuple[int, int]]] = [[] for _ in regions]
            for k in range(0, len(todo), per_automaton):
                for have, more in zip(spans, locate(todo[k : k + per_automaton], regions), strict=True):
                    have.extend(more)
            out.extend((*key, [{"s": s, "e": e} for s, e in kernels.merge_spans(np.array(found, np.int64)).tolist()]) for key, found in zip(keys, spans, strict=True) if found)
            regions.clear(), keys.clear(), phrases.clear()

        ids: dict[bytes, int] = {}
        for anchor, group in shard.groupby("anchor", sort=False):
            words = [tuple(ids.setdefault(w, len(ids)) for w in body.split(b" ")) for body in group["body"]]
            phrases |= recurring_phrases(words, group["n"].tolist(), length)
            regions += words
            keys += [(anchor, region) for region in group["region"].tolist()]
            if len(phrases) >= per_automaton:
                stream()
        stream()
        return pd.DataFrame(out, columns=["anchor", "region", "spans"])

    return resolve


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, spans = span_arrays(batch.column("spans"))
        for lo, hi, raw, offsets in kernels.pieces(batch.column("text")):
            data = raw.tobytes()
            starts, ends, bounds = kernels.word_spans(raw, offsets)
            n = np.diff(bounds)
            removed, kept = np.zeros(hi - lo, np.int64), []
            for k in range(hi - lo):
                text, own = data[offsets[k] : offsets[k + 1]], spans[places[lo + k] : places[lo + k + 1]]
                words = text.split()
                if len(own):
                    gone = kernels.merge_spans(own)
                    removed[k] = (gone[:, 1] - gone[:, 0]).sum()
                    at, parts = 0, []
                    for s, e in gone.tolist():
                        parts += words[at:s]
                        at = e
                    words = parts + words[at:]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept])],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )




def drop_repeated_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 35, max_variants: int = MAX_VARIANTS) -> DataFrame:
    """Remove every word covered by a window of ``words`` words that also starts elsewhere.

    Returns doc_id, n_words, n_removed, kept_sha256, kept_text for each row.  Null
    and empty texts have no words (0, 0, digest of nothing).  All copies of a
    passage go, the first included; a passage repeated inside one document counts.
    Rows that are there twice repeat each other.  Other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    spans = recurring_spans(rows, "word", words, min(ANCHOR_WORDS, words), _resolver(words, AUTOMATON_PHRASES), max_variants)
    return with_spans(rows, spans).mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
