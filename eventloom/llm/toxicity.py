"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its words (runs of letters, digits and bytes beyond ASCII, A-Z lowered)
and the words' first 4, 5 and 6 bytes, hashed into a fixed space of ``2 ** BITS`` terms; a
term is present or not, so long texts score like short ones.  The model is a factorization machine: a bias, a
weight for each term and for each pair of terms the product of two learned vectors, so
that pairs which only mean something together (an insult and whom it is aimed at) count.

It is fitted on a bounded sample of the labelled rows (``per_class`` for each class, by a
hash of the id, weighted back to their numbers).  Every term of the space whose association with
the label is significant in that sample (``min_texts`` texts; G of ``min_g``, 5 % over 2 ** BITS tests) has a weight and a vector,
however many they are; the others' are zero.  Scoring reads every whole text.

Defined results: a null or empty text has no terms and gets the bias' score; labels that are
null or have no document don't count; without labels of both classes every score is the
share of toxic labels (0 without any); an empty table gives an empty result; the score
column takes the place of an input column with its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from . import textcodes as tc
from .staging import stage

PREFIXES = (4, 5, 6)
#: Terms are hashed to this many bits, which bounds the model.
BITS = 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the factors' products)."""

    terms: np.ndarray  # sorted hashed terms with a weight
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, own: np.ndarray, slots: np.ndarray, texts: int) -> np.ndarray:
        """``slots`` of ``texts`` texts, each (text, slot) once, grouped by ``own``."""
        linear = np.bincount(own, self.weights[slots], texts)
        pairs = np.zeros(texts)
        for k in range(self.factors.shape[1]):
            v = self.factors[slots, k]
            pairs += np.bincount(own, v, texts) ** 2 - np.bincount(own, v * v, texts)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -40, 40)))


def text_terms(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Texts and hashed terms of all words, repeats included."""
    buf, offs = tc.text_buffers(part.column("text"))
    buf = _LOWER[buf]
    a, e, first = tc.word_bounds(buf, offs, _GAP)
    own = tc.owners(first, len(a))
    owners, terms = [own], [tc.span_hashes(buf, a, e)]
    for n in PREFIXES:
        long = np.flatnonzero(e - a > n)
        owners.append(own[long])
        terms.append(tc.mix(tc.span_hashes(buf, a[long], a[long] + n) ^ np.uint64(n)))
    return np.concatenate(owners), (np.concatenate(terms) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(own: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, own))
    own, values = own[order], values[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (values[1:] != values[:-1])
    return own[new], values[new]


@tc.tidy
def _training_terms(batches):
    for batch in batches:
        for part in tc.slices(batch, "text"):
            own, terms = _distinct(*text_terms(part))
            at = np.searchsorted(own, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), part.column("weight"), pa.ListArray.from_arrays(pa.array(at), pa.array(terms))], names=["id", "y", "weight", "terms"])


def loss_and_gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, list[np.ndarray]]:
    """Mean weighted logistic loss with the penalty of weights and factors, and its gradients; ``x`` is 0 or 1."""
    b, w, v = params
    xv = x @ v
    z = np.clip(b[0] + x @ w + 0.5 * (xv**2 - x @ (v**2)).sum(axis=1), -40, 40)
    loss = (weight * (np.log1p(np.exp(z)) - y * z)).mean() + ridge / 2 * ((w**2).sum() + (v**2).sum())
    g = (1 / (1 + np.exp(-z)) - y) * weight / len(y)
    xg = x.T @ g
    return loss, [np.array([g.sum()]), xg + ridge * w, x.T @ (g[:, None] * xv) - v * xg[:, None] + ridge * v]


def fit_machine(slots: list[np.ndarray], y: np.ndarray, weight: np.ndarray, size: int, factors: int = 8, epochs: int = 30, rate: float = 0.05, ridge: float = 1e-4, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted logistic loss by Adam over mini-batches; deterministic for a given order of rows."""
    rng = np.random.default_rng(seed)
    share = float((weight * y).sum() / weight.sum())
    params = [np.array([np.log(share / (1 - share))]), np.zeros(size), rng.normal(0, 0.01, (size, factors))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = weight / weight.mean()
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256, len(y) * size >> 25)):
            x = np.zeros((len(rows), size), np.float32)
            for i, r in enumerate(rows):
                x[i, slots[r]] = 1
            _, grads = loss_and_gradients(params, x, y[rows], weight[rows], ridge)
            step += 1
            for p, d, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000, min_texts: int = 3, min_g: float = 30.0) -> FactorizationMachine:
    """Fit on at most ``2 * per_class`` labelled documents."""
    rows = labelled.learnable(labels, id_col, label_col)
    sample = stage(labelled.class_sample(rows, per_class), "sample")
    share = sample.agg(F.sum(F.col("y") * F.col("weight")) / F.sum("weight"), F.min("y"), F.max("y")).first()
    none = FactorizationMachine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, 1)))
    if share[1] == share[2]:
        none.bias = 40.0 * (2 * (share[0] or 0.0) - 1)
        return none
    # the sample has 2 * per_class rows at most, so it may be broadcast: texts aren't shuffled
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    known = stage(chosen.select("id", "y", "weight", "text").mapInArrow(_training_terms, "id long, y int, weight double, terms array<long>"), "terms")
    all_t, all_c = known.agg(F.sum(F.col("y") * F.col("weight")), F.sum((1 - F.col("y")) * F.col("weight"))).first()
    if not all_t or not all_c:
        none.bias = -40.0 if not all_t else 40.0
        return none
    counts = known.select("y", "weight", F.explode("terms").alias("term")).groupBy("term").agg(F.sum(F.col("y") * F.col("weight")).alias("t"), F.sum((1 - F.col("y")) * F.col("weight")).alias("c"), F.count("*").alias("n"))
    part = lambda seen, of: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) * (all_t + all_c) / ((F.col("t") + F.col("c")) * of))).otherwise(F.lit(0.0))
    best = counts.where(F.col("n") >= min_texts).withColumn("g", 2 * (part("t", all_t) + part("c", all_c))).where(F.col("g") >= min_g)
    terms = np.array(sorted(r.term for r in best.select("term").collect()), np.int64)  # 2 ** BITS at most
    bias = float(np.log(all_t / all_c))
    if not len(terms):
        none.bias = bias
        return none

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        slots = []
        for t in pdf["terms"]:
            t = np.asarray(t, np.int64)
            at = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
            slots.append(at[terms[at] == t])
        b, w, v = fit_machine(slots, pdf["y"].to_numpy(float), pdf["weight"].to_numpy(float), len(terms))
        return pd.DataFrame({"slot": np.arange(-1, len(terms)), "w": np.append(b, w), "v": [[], *v.tolist()]})

    # only the model's terms of the bounded sample reach the one fitting task
    mine = known.select("id", "y", "weight", F.explode_outer("terms").alias("term")).join(F.broadcast(best.sparkSession.createDataFrame([(int(t),) for t in terms], "term long").withColumn("in", F.lit(1))), "term", "left")
    mine = mine.groupBy("id", "y", "weight").agg(F.collect_list(F.when(F.col("in") == 1, F.col("term"))).alias("terms"))
    fitted = mine.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "slot int, w double, v array<double>").orderBy("slot").collect()
    return FactorizationMachine(terms, fitted[0].w, np.array([r.w for r in fitted[1:]]), np.array([r.v for r in fitted[1:]]))


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", keep_columns: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """``keep_columns`` (default: all) and ``score_col`` of every row; the text is read whole."""
    columns = [c for c in keep_columns or docs.columns if c != score_col]
    rows = docs.select(F.struct(*columns).alias("_row"), F.col(text_col).cast("string").alias("text"))

    @tc.tidy
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "text"):
                own, terms = text_terms(part)
                if len(model.terms):
                    at = np.minimum(np.searchsorted(model.terms, terms), len(model.terms) - 1)
                    known = model.terms[at] == terms
                    own, slots = _distinct(own[known], at[known])
                else:
                    own, slots = own[:0], own[:0]
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(model.scores(own, slots, part.num_rows))], names=["_row", score_col])

    return rows.mapInArrow(run, rows.select("_row").schema.add(score_col, "double")).select("_row.*", score_col)
