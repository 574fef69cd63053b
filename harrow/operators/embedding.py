"""Driving an embedder: batches that follow its speed, bounded retries, complete answers.

An embedder is any function from a list of texts to as many vectors.  A failure that may
pass is tried again; ``Refused`` (credentials, a redirect, a text that it will not take)
is not.  What comes back is checked before it counts: as many vectors as texts, of one
length, all finite.
"""

from __future__ import annotations

import concurrent.futures
import math
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]

#: Attempts after the first.
RETRIES = 2
FIRST_BATCH, LEAST_BATCH, MOST_BATCH = 32, 1, 512
#: A batch that took longer is halved, one that took less is doubled; seconds.
SLOW_S, FAST_S = 2.0, 0.2


class Refused(RuntimeError):
    """The embedder will answer the same again."""


class Incomplete(RuntimeError):
    """The answer is not one usable vector for each text."""


def next_batch(size: int, seconds: float) -> int:
    if seconds > SLOW_S:
        size //= 2
    elif seconds < FAST_S:
        size *= 2
    return min(MOST_BATCH, max(LEAST_BATCH, size))


def checked(vectors: Sequence[Sequence[float]], texts: int, dim: int | None = None) -> list[list[float]]:
    out = [[float(x) for x in v] for v in vectors]
    if len(out) != texts:
        raise Incomplete(f"{len(out)} vectors for {texts} texts")
    dim = dim or (len(out[0]) if out else 0)
    for v in out:
        if len(v) != dim or not dim:
            raise Incomplete(f"a vector of {len(v)} components, not {dim}")
        if not all(map(math.isfinite, v)):
            raise Incomplete("a component is not finite")
    return out


def attempt(embedder: Embedder, texts: list[str], dim: int | None = None, retries: int = RETRIES, pause: Callable[[int], None] = lambda _: None) -> list[list[float]]:
    """The vectors of one batch, tried ``1 + retries`` times at most."""
    for left in range(retries, -1, -1):
        try:
            return checked(embedder(texts), len(texts), dim)
        except Refused:
            raise
        except Exception as e:
            if not left:
                raise RuntimeError(f"embedding failed after {retries + 1} attempts: {type(e).__name__}: {e}") from e
            pause(retries - left)


def in_batches(embedder: Embedder, texts: list[str], first: int = FIRST_BATCH, clock: Callable[[], float] = time.monotonic, done: Callable[[int], None] = lambda _: None) -> Iterator[tuple[int, list[list[float]]]]:
    """(place of the first text, vectors) of one batch after the other, in order."""
    at, size, dim = 0, first, None
    while at < len(texts):
        began = clock()
        vectors = attempt(embedder, texts[at : at + size], dim)
        dim = len(vectors[0])
        yield at, vectors
        done(len(vectors))
        at += len(vectors)
        size = next_batch(size, clock() - began)


def embedded(texts: DataFrame, embedder: Embedder, count: Accumulator | None = None) -> DataFrame:
    """(sha, embedding) of texts (sha, text); ``count`` follows the number of vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shas = frame["sha"].tolist()
            for at, vectors in in_batches(embedder, frame["text"].tolist(), done=count.add if count is not None else lambda _: None):
                yield pd.DataFrame({"sha": shas[at : at + len(vectors)], "embedding": vectors})

    return texts.mapInPandas(run, "sha string, embedding array<float>")


def one_length(vectors: DataFrame, column: str = "embedding") -> int | None:
    """The length of all vectors; tasks agree on it only here."""
    row = vectors.agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if row["a"] != row["b"]:
        raise Incomplete(f"vectors of {row['a']} and of {row['b']} components")
    return row["a"]


class Deadline:
    """Query vectors within a time: one attempt, and no attempt while the last one still runs.

    ``warm_up`` asks in the background, so that a model that loads slowly is there for
    the first query; a query that comes too early gets ``TimeoutError``.
    """

    def __init__(self, embedder: Embedder, seconds: float):
        self.embedder, self.seconds = embedder, seconds
        self.pool = concurrent.futures.ThreadPoolExecutor(1, thread_name_prefix="query-vector")
        self.running: concurrent.futures.Future | None = None

    def warm_up(self) -> None:
        if self.running is None or self.running.done():
            self.running = self.pool.submit(self.embedder, ["warm-up"])

    def vector(self, text: str) -> list[float]:
        began = time.monotonic()
        if self.running is not None and not self.running.done():
            concurrent.futures.wait([self.running], timeout=self.seconds)
            if not self.running.done():
                raise TimeoutError(f"the embedder is still busy after {self.seconds} s")
        self.running = self.pool.submit(attempt, self.embedder, [text], None, 0)
        try:
            return self.running.result(max(0.0, self.seconds - (time.monotonic() - began)))[0]
        except concurrent.futures.TimeoutError:
            raise TimeoutError(f"no query vector within {self.seconds} s") from None
