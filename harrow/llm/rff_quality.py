"""A quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics;
each partition sums its share of the normal equations, the sums are added, and one
small system gives ridge scores.  Isotonic regression on rows that the fit did not
see turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import kernels
from harrow.llm.training import TRAIN_ROWS, held_out, labelled
from harrow.plans.scratch import stage

FEATURES = 256
WIDTH = 4.0
RIDGE = 1.0
BINS = 400
SEED = 7


def _classes() -> np.ndarray:
    """Byte classes as columns: upper, lower, digit, blank, line end, bar, full stop or comma, other sign, not ASCII."""
    table, code = np.zeros((256, 9)), np.arange(256)
    c = np.array([chr(i) for i in code])
    sets = [np.char.isupper(c), np.char.islower(c), np.char.isdigit(c), (code == 32) | (code == 9), (code >= 10) & (code <= 13), c == "|", (c == ".") | (c == ",")]
    for k, mask in enumerate(sets):
        table[mask & (code < 128), k] = 1
    table[(code < 128) & (table.sum(axis=1) == 0), 7] = 1
    table[code >= 128, 8] = 1
    return table


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each document of a piece, one row each; all finite, also for empty texts."""
    data, classes = raw.tobytes(), _classes()
    starts, ends, bounds = kernels.word_spans(raw, offsets)
    lengths = ends - starts
    rows = []
    for k in range(len(offsets) - 1):
        s, e = int(offsets[k]), int(offsets[k + 1])
        n = max(1, e - s)
        shares = np.bincount(raw[s:e], minlength=256) @ classes / n
        words = data[s:e].split()
        own = lengths[bounds[k] : bounds[k + 1]]
        m = max(1, len(words))
        lines = [x for x in data[s:e].split(b"\n") if x.strip()]
        distinct = len(set(words))
        rows.append([
            np.log1p(e - s), np.log1p(len(words)), np.log1p(len(lines)), *shares,
            own.mean() if len(own) else 0.0, own.std() if len(own) else 0.0, (own <= 3).mean() if len(own) else 0.0,
            distinct / m, np.log1p(distinct), len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))),
            sum(map(bytes.isupper, words)) / m,
        ])
    return np.array(rows, float).reshape(len(rows), -1)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def fourier(z: np.ndarray) -> np.ndarray:
    """An intercept, and cosines whose products average to exp(-|a-b|^2 / (2 WIDTH^2))."""
    random = np.random.default_rng(SEED)
    w = random.standard_normal((z.shape[1], FEATURES)) / WIDTH
    b = random.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -8, 8) @ w + b)])


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins; knots of a rising curve."""
    blocks: list[list[float]] = []
    for at, g, k in zip(x, good, n, strict=True):
        blocks.append([at * k, g, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, offsets in kernels.pieces(batch.column("text")):
            x = statistics(raw, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(len(batch), -1)


def _normal(mean: np.ndarray, scale: np.ndarray):
    """A partition's sums of the normal equations, as one row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            phi = fourier((_matrix(batch) - mean) / scale)
            gram += phi.T @ phi
            target += phi.T @ np.asarray(batch.column("y")).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary())], names=["gram", "target"])

    return add


def _histogram(model: Model):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch))
            at = np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw), batch.column("y")], names=["bin", "raw", "y"])

    return count


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``rows`` labelled documents; None where no label is given.

    Three quarters, by hash of the id, give the ridge scores; the rest calibrates.
    """
    sample = labelled(docs, labels, "quality", id_col, text_col, rows).mapInArrow(_measure, "doc_id long, y int, x array<double>")
    sample = stage(sample, "quality-train")
    aside = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(4)) == 0
    spread = sample.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    if not spread:
        return None
    mean, scale = np.array([r["m"] for r in spread]), np.array([r["s"] or 1.0 for r in spread])
    sums = sample.filter(~aside).repartition(8, "doc_id").mapInArrow(_normal(mean, scale), "gram binary, target binary").collect()
    gram = sum((np.frombuffer(r["gram"]).reshape(FEATURES + 1, -1) for r in sums), np.zeros((FEATURES + 1, FEATURES + 1)))
    target = sum((np.frombuffer(r["target"]) for r in sums), np.zeros(FEATURES + 1))
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[0, 0] = 1e-6
    beta = np.linalg.solve(gram + penalty, target)
    model = Model(mean, scale, beta, (np.zeros(1), np.zeros(1)))
    bins = sample.filter(aside).mapInArrow(_histogram(model), "bin int, raw double, y int").groupBy("bin").agg(F.avg("raw").alias("x"), F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        knots = isotonic(*(np.array([float(r[c]) for r in bins]) for c in ("x", "good", "n")))
    else:
        knots = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return Model(mean, scale, beta, knots)


def _score(model: Model | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in kernels.pieces(batch.column("text")):
                found = model.score(statistics(raw, offsets)) if model else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(found)], names=["doc_id", "held_out", "score"])

    return scan


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= ``least``) of each row; null texts are empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
