"""Toxicity by a weighted lexicon.

Texts are folded first: compatibility forms, look-alike letters of other scripts,
digits and signs that stand for letters, and invisible characters, so that one
spelling stands for all disguises.  The lexicon holds beginnings of words with the
log of how much more often toxic documents have them, and exception phrases, longer
matches that take a weight back.  One Aho-Corasick pass sums the weights; the sum,
set against the length of the text, goes through a logistic curve.

Lexicon, exceptions and curve are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.training import TRAIN_ROWS, held_out, labelled
from harrow.plans.scratch import stage

# Look-alikes of Latin letters, and digits and signs read as letters.
_LOOKALIKES = "аaвbеeкkмmнhоoрpсcтtуyхxіiјjѕsԁdԛqԝwһhӏlαaβbεeηnιiκkνvοoρpτtυuχxγyıiɡg"
_DIGITS = "0o1i3e4a5s7t8b9g@a$s"
_INVISIBLE = "­​‌‍⁠﻿"

#: Lexicon entries are beginnings of words, of so many letters, or whole words.
STEM_LETTERS = (4, 5, 6, 7, 8)
SHORT_LETTERS = 2
#: An entry is in so many toxic documents, so many times as often as in clean ones, and this far from chance.
LEAST_DOCS, LEAST_RATIO, LEAST_G = 5, 4.0, 40.0
EXCEPTION_DOCS = 5


class _Fold(dict):
    """Code point to folded text, worked out when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        value = c if c.isalnum() else " "
        self[code] = value
        return value


@functools.cache
def _table() -> _Fold:
    table = _Fold()
    for pairs in (_LOOKALIKES, _DIGITS):
        table.update({ord(a): b for a, b in zip(pairs[::2], pairs[1::2], strict=True)})
    table.update(dict.fromkeys(map(ord, _INVISIBLE), ""))
    table.update(dict.fromkeys(range(0x300, 0x370), ""))
    return table


def fold(text: str) -> list[str]:
    """Words of a text in their plain spelling."""
    text = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
    return text.translate(_table()).split()


def shape(text: str) -> str:
    """What a reader takes folded text for: letters without their marks, one letter for 1, i and l."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.replace("l", "i")


def stems(words: Iterable[str]) -> set[str]:
    """Beginnings of words and whole words; a short word only whole, which its blank says."""
    found = set()
    for w in set(words):
        found.update(w[:k] for k in STEM_LETTERS if len(w) >= k)
        if len(w) >= STEM_LETTERS[0]:
            found.add(w)
        elif len(w) >= SHORT_LETTERS:
            found.add(f"{w} ")
    return found


@dataclass(frozen=True)
class Lexicon:
    """Entries (beginning of a word, weight), exceptions (phrase, weight taken back), curve."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[tuple[str, float], ...] = ()
    curve: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        weights: dict[str, float] = {}
        for stem, weight in self.entries:
            key = shape(" " + stem)
            weights[key] = max(weight, weights.get(key, weight))
        for phrase, weight in self.exceptions:
            # beside an entry of the same letters, which is a whole short word
            key = shape(f" {phrase} ")
            weights[key] = weights.get(key, 0.0) - weight
        a = ahocorasick.Automaton()
        for key, weight in weights.items():
            a.add_word(key, weight)
        a.make_automaton()
        return a


def weigh(words: list[str], automaton: ahocorasick.Automaton) -> float:
    if not words or not len(automaton):
        return 0.0
    return max(0.0, sum(w for _, w in automaton.iter(shape(f" {' '.join(words)} "))))


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the curve sees: the weight, the weight for each hundred words, the length."""
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / (words + 5)), np.log1p(words)], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(turns):
        p = sigmoid(x @ beta)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _counter(y: int, known: frozenset[str] | None):
    """Partial document counts of stems: of all, or of those already known."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = stems(fold(text or ""))
                seen.update(found if known is None else found & known)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([y] * len(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["stem", "y", "n"])

    return count


def _phrases(lexicon: Lexicon):
    """Partial document counts of matched words, alone and with the next, by label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = dict(lexicon.entries)
        lengths = sorted({len(s) for s in entries}, reverse=True)
        seen: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                words, found = fold(text or ""), set()
                for w, after in zip(words, [*words[1:], ""], strict=False):
                    stem = next((w[:k] for k in lengths if w[:k] in entries), None)
                    if stem:
                        found.add((w, stem))
                        if after:
                            found.add((f"{w} {after}", stem))
                seen.update((*f, y) for f in found)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array([k[2] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["phrase", "stem", "y", "n"])

    return count


def _weights(lexicon: Lexicon):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            weights, lengths = [], []
            for text in batch.column("text"):
                words = fold(text.as_py() or "")
                weights.append(weigh(words, automaton))
                lengths.append(len(words))
            x = features(np.array(weights, float), np.array(lengths, float))
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(weights, pa.float64()), pa.array(lengths, pa.int64()), pa.array(sigmoid(x @ np.array(lexicon.curve)), pa.float64())], names=[*rest, "weight", "n_words", "score"])

    return scan


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[tuple[str, float]]:
    """Entries from (stem, toxic documents, clean documents), far from chance first.

    Of a stem and its continuations only the most telling stays.  There is no limit to
    their number but that of the sample: each is in LEAST_DOCS of its toxic documents.
    """
    scored = []
    for stem, t, c in counts:
        ratio = (t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1))
        if t < LEAST_DOCS or ratio < LEAST_RATIO:
            continue
        expect = (t + c) / (toxic + clean)
        g = 2 * sum(o * math.log(o / e) for o, e in ((t, toxic * expect), (c, clean * expect), (toxic - t, toxic * (1 - expect)), (clean - c, clean * (1 - expect))) if o > 0 and e > 0)
        if g >= LEAST_G:
            scored.append((g, len(stem), stem, math.log(ratio)))
    chosen: dict[str, float] = {}
    inside: set[str] = set()
    for _, _, stem, weight in sorted(scored, reverse=True):
        if stem in inside or any(stem[:k] in chosen for k in range(1, len(stem))):
            continue
        chosen[stem] = weight
        inside.update(stem[:k] for k in range(1, len(stem) + 1))
    return sorted(chosen.items())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Lexicon:
    """Lexicon, exceptions and curve from at most ``rows`` labelled documents.

    Without labels of both kinds the lexicon is empty and every score is low.
    """
    train = stage(labelled(docs, labels, "toxic", id_col, text_col, rows), "toxic-train")
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon(())
    # what comes to the driver is bounded by the sample
    schema = "stem string, y int, n long"
    hot = train.filter("y = 1").mapInArrow(_counter(1, None), schema).groupBy("stem").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    seen = {r["stem"]: r["n"] for r in hot.collect()}
    cold = train.filter("y = 0").mapInArrow(_counter(0, frozenset(seen)), schema).groupBy("stem").agg(F.sum("n").alias("n"))
    other = {r["stem"]: r["n"] for r in cold.collect()}
    lexicon = Lexicon(tuple(choose([(s, n, other.get(s, 0)) for s, n in seen.items()], toxic, clean)))
    both = train.mapInArrow(_phrases(lexicon), "phrase string, stem string, y int, n long").groupBy("phrase", "stem").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    fair = both.filter(F.col("c") >= EXCEPTION_DOCS).filter((F.col("t") + 0.5) / (toxic + 1) <= (F.col("c") + 0.5) / (clean + 1))
    entries = dict(lexicon.entries)
    words = {r["phrase"]: entries[r["stem"]] for r in fair.collect()}
    # a phrase whose first word is taken back already is not taken back twice
    exceptions = {p: w for p, w in words.items() if " " not in p or p.split(" ")[0] not in words}
    lexicon = Lexicon(lexicon.entries, tuple(sorted(exceptions.items())))
    measured = train.mapInArrow(_weights(lexicon), "doc_id long, y int, weight double, n_words long, score double").select("weight", "n_words", "y").toPandas()
    curve = fit_curve(features(measured["weight"].to_numpy(float), measured["n_words"].to_numpy(float)), measured["y"].to_numpy(float))
    return Lexicon(lexicon.entries, lexicon.exceptions, tuple(curve.tolist()))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, weight, n_words of each row; null texts are empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_weights(lexicon), "doc_id long, held_out boolean, weight double, n_words long, score double")
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "weight", "n_words")


def _clean(lexicon: Lexicon, text_col: str):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, curve = lexicon.automaton(), np.array(lexicon.curve)
        for batch in batches:
            words = [fold(t.as_py() or "") for t in batch.column(text_col)]
            x = features(np.array([weigh(w, automaton) for w in words], float), np.array([len(w) for w in words], float))
            yield batch.filter(pa.array(sigmoid(x @ curve) < 0.5))

    return keep


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """All columns of the rows that score below 0.5."""
    return docs.mapInArrow(_clean(lexicon, text_col), docs.schema)
