"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

A text is described by statistics of its bytes, words, lines and repeats.  Random
Fourier features of the standardised statistics approximate a Gaussian kernel; every
partition sums its part of the normal equations and only the sums (a fixed number of
values) meet to be solved.  Raw scores are then calibrated by isotonic regression on a
fold of the labelled rows that the ridge fit doesn't use.

Defined results: a null text is an empty text and gets a score like others; labels that are
null or have no document don't count; without labels of both classes every score is the
labels' mean (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from . import textcodes as tc
from .staging import stage

CALIBRATION_FOLD = 1
BINS = 1000
_BYTE_SETS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"|", b"#*$%&<>", b"\n", bytes(range(128, 256)), b" "]


def _table(members: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


_TABLES = [_table(m) for m in _BYTE_SETS]
_NEWLINE = _table(b"\n")


def _per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.append(0, np.cumsum(mask))
    return (c[offs[1:]] - c[offs[:-1]]).astype(float)


def _repeat_share(values: np.ndarray, own: np.ndarray, texts: int) -> np.ndarray:
    """Share of a text's values that repeat an earlier one."""
    order = np.lexsort((values, own))
    again = np.zeros(len(values), bool)
    again[1:] = (values[order][1:] == values[order][:-1]) & (own[order][1:] == own[order][:-1])
    return np.bincount(own[order], again, texts) / np.maximum(1, np.bincount(own, minlength=texts))


def statistics(part: pa.RecordBatch) -> np.ndarray:
    """One row of statistics for each text."""
    buf, offs = tc.text_buffers(part.column("text"))
    texts, size = part.num_rows, np.maximum(1, np.diff(offs)).astype(float)
    a, e, first = tc.word_bounds(buf, offs)
    own, count = tc.owners(first, len(a)), np.diff(first).astype(float)
    words = tc.span_hashes(buf, a, e)
    grams = np.flatnonzero(tc.inside(first, len(a), 3))
    la, le, lfirst = tc.word_bounds(buf, offs, _NEWLINE)
    lown = tc.owners(lfirst, len(la))
    length = (e - a).astype(float)
    some = np.maximum(1, count)
    mean = np.bincount(own, length, texts) / some
    columns = [
        np.log1p(count),
        np.log1p(np.diff(offs)),
        mean,
        np.sqrt(np.maximum(0, np.bincount(own, length**2, texts) / some - mean**2)),
        *(np.sqrt(_per_text(t[buf], offs) / size) for t in _TABLES),
        _repeat_share(words, own, texts),
        _repeat_share(tc.gram_hashes(words, 3)[grams], own[grams], texts) if len(words) >= 3 else np.zeros(texts),
        _repeat_share(tc.span_hashes(buf, la, le), lown, texts),
        np.bincount(own[1:], (words[1:] == words[:-1]) & (own[1:] == own[:-1]), texts) / some if len(words) > 1 else np.zeros(texts),
        np.log1p(count / np.maximum(1, np.diff(lfirst))),
    ]
    return np.stack(columns, axis=1)


@tc.tidy
def _describe(batches):
    for batch in batches:
        for part in tc.slices(batch, "text"):
            x = statistics(part)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("id"), flat], names=["id", "x"])


@dataclass
class FourierRidge:
    """Standardisation, random projection, ridge weights and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None
    constant: float = 0.5

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.projection + self.phase)
        return np.concatenate([f, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def isotonic(x: np.ndarray, total: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x; knots and non-decreasing levels, smoothed by half a count."""
    blocks: list[list[float]] = []  # weight, positives, sum of weighted x
    for xi, n, p in zip(x, total, positive, strict=True):
        blocks.append([n, p, n * xi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n1, p1, s1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n1, blocks[-1][1] + p1, blocks[-1][2] + s1]
    return np.array([b[2] / b[0] for b in blocks]), np.maximum.accumulate([(b[1] + 0.5) / (b[0] + 1) for b in blocks])


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and statistics of every text, staged."""
    return stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_describe, "id long, x array<double>"), "statistics")


def train(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", features: int = 128, width: float = 4.0, ridge: float = 1e-3, seed: int = 11) -> FourierRidge:
    """Fit on all labelled rows outside the held-out fold; ``width`` is the kernel's standard deviation."""
    rows = stage(described.join(labelled.learnable(labels, id_col, label_col), "id").withColumn("calibrate", labelled.fold(F.col("id")) == CALIBRATION_FOLD), "labelled")
    dims = int(rows.agg(F.coalesce(F.max(F.size("x")), F.lit(1))).first()[0])
    moments = rows.select("y", F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    rng = np.random.default_rng(seed)
    mean = np.array([r.m for r in moments]) if moments else np.zeros(dims)
    scale = np.array([max(r.s, 1e-6) for r in moments]) if moments else np.ones(dims)
    model = FourierRidge(mean, scale, rng.normal(0, 1 / width, (dims, features)), rng.uniform(0, 2 * np.pi, features))
    classes = {(r.calibrate, r.y): r["count"] for r in rows.groupBy("calibrate", "y").count().collect()}
    count = sum(classes.values())
    if count:
        model.constant = sum(n for (_, y), n in classes.items() if y) / count
    if not all(classes.get((False, y)) for y in (0, 1)):
        return model

    @tc.tidy
    def normal(batches):
        a, b = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            if batch.num_rows:
                f = model.features(matrix(batch.column("x")))
                a += f.T @ f
                b += f.T @ batch.column("y").to_numpy()
        i, j = np.triu_indices(features + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, np.arange(features + 1)).astype(np.int32)), pa.array(np.append(j, np.full(features + 1, -1)).astype(np.int32)), pa.array(np.append(a[i, j], b))], names=["i", "j", "v"])

    sums = rows.where(~F.col("calibrate")).select("x", "y").mapInArrow(normal, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    a, b = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
    for r in sums:
        if r.j < 0:
            b[r.i] = r.v
        else:
            a[r.i, r.j] = a[r.j, r.i] = r.v
    model.weights = np.linalg.solve(a + ridge * np.eye(features + 1) * max(1.0, a[-1, -1] / 1000), b)

    @tc.tidy
    def binned(batches):
        for batch in batches:
            raw = model.raw(matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(np.int32)), pa.array(raw), batch.column("y")], names=["bin", "raw", "y"])

    fold = rows.where("calibrate") if all(classes.get((True, y)) for y in (0, 1)) else rows
    bins = fold.select("x", "y").mapInArrow(binned, "bin int, raw double, y int").groupBy("bin").agg(F.avg("raw").alias("raw"), F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("bin").collect()
    model.knots, model.levels = isotonic(np.array([r.raw for r in bins]), np.array([r.n for r in bins]), np.array([r.p for r in bins]))
    return model


def score(described: DataFrame, model: FourierRidge) -> DataFrame:
    """id and score of every described row."""

    @tc.tidy
    def run(batches):
        for batch in batches:
            s = model.scores(matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s)], names=["id", "score"])

    return described.mapInArrow(run, "id long, score double")
