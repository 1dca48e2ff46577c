"""Quality classifier: Naive Bayes support vectors.

N-gram indicators are scaled by the log ratio of their frequencies in the two classes, and a linear
hinge-loss model is fitted to them by dual coordinate descent. A logistic curve, fitted on a fifth of
the sample that the model has not seen, turns margins into scores.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, columns_as, released
from .tokens import FEATURES, Table, ngram_features, scored, token_code, training_rows

#: Labelled rows that the model is fitted on, at most; scoring covers every row.
TRAIN_ROWS = 12_000


@dataclass(frozen=True)
class Model:
    """``score = 1 / (1 + exp(-(slope * margin + level)))``, margin = (sum of weight) / norm + bias."""

    weight: np.ndarray  # of each feature, with its log ratio in it
    square: np.ndarray  # of each feature's log ratio
    bias: float
    slope: float
    level: float

    def score(self, features: np.ndarray) -> float:
        norm = float(self.square[features].sum()) ** 0.5
        margin = (float(self.weight[features].sum()) / norm if norm > 0 else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.level, -500, 500))))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of (smoothed share of class 1 with the feature / of class 0); 0 for what was never seen."""
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    counts = [np.bincount(np.concatenate([*(r for r, v in zip(rows, y, strict=True) if v == c), np.zeros(0, np.int32)]).astype(np.int64), minlength=FEATURES) for c in (0, 1)]
    prior = smoothing / (n0 + n1)
    return np.log((counts[1] / n1 + prior) / (counts[0] / n0 + prior))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of cost * hinge loss, by dual coordinate descent."""
    w, bias, alpha, sign = np.zeros(FEATURES), 0.0, np.zeros(len(rows)), np.where(y == 1, 1.0, -1.0)
    square, order = np.array([float(v @ v) + 1.0 for v in values]), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            step = min(max(alpha[i] - gradient / square[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * sign[i] * values[i]
                bias += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level by Newton's method, with targets drawn in from 0 and 1."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target, a, b = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit_rows(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 15) -> Model:
    """A model of labelled feature sets. With one class or no rows, every score is that class's share."""
    if len(set(y.tolist())) < 2:
        level = 0.0 if not len(y) else 3.0 if y[0] == 1 else -3.0
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 1.0, level)
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[apart].tolist())) < 2:
        apart[:] = False
    seen = [r for r, out in zip(rows, apart, strict=True) if not out]
    ratio = log_ratios(seen, y[~apart])
    values = []
    for r in seen:
        v = ratio[r].astype(np.float32)
        norm = float(v @ v) ** 0.5
        values.append(v / norm if norm > 0 else v)
    share = np.array([(y[~apart] == c).mean() for c in (0, 1)])
    w, bias = dual_descent(seen, values, y[~apart], cost * 0.5 / share[y[~apart]], epochs)
    model = Model(w * ratio, ratio**2, bias, 1.0, 0.0)
    test = [(r, v) for r, v, out in zip(rows, y, apart, strict=True) if out or not apart.any()]
    margin = np.array([-np.log(1 / p - 1) for p in (min(max(model.score(r), 1e-12), 1 - 1e-12) for r, _ in test)])
    slope, level = _logistic(margin, np.array([v for _, v in test]))
    return Model(model.weight.astype(np.float32), model.square.astype(np.float32), bias, slope, level)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` labelled rows of ``docs``, in one task; only the model comes to the driver."""
    work = Workspace(docs.sparkSession, "quality")

    def sets(batches):
        table = Table(token_code)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"label": batch.column(0), "features": pa.array([ngram_features(x or "", table).tobytes() for x in batch.column(1).to_pylist()], pa.binary())})

    def whole(batches):
        """All rows of the sample, which is bounded, in an order that does not depend on the partitions."""
        rows = [(y, np.frombuffer(x, np.int32)) for batch in batches for y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        rows.sort(key=lambda r: (hashlib.blake2b(r[1], digest_size=12).digest(), r[0]))
        model = fit_rows([x for _, x in rows], np.array([y for y, _ in rows], np.int64))
        held = [model.weight.astype("<f4").tobytes(), model.square.astype("<f4").tobytes(), np.array([model.bias, model.slope, model.level]).tobytes()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(3), pa.int32()), "held": pa.array(held, pa.binary())})

    featured = training_rows(docs, labels, label, train_rows, work).mapInArrow(released(sets), "label int, features binary")
    parts = {r["part"]: r["held"] for r in featured.repartition(1).mapInArrow(released(whole), "part int, held binary").collect()}
    work.close()
    if not parts:
        return fit_rows([], np.zeros(0, np.int64))
    bias, slope, level = np.frombuffer(parts[2]).tolist()
    return Model(np.frombuffer(parts[0], "<f4"), np.frombuffer(parts[1], "<f4"), bias, slope, level)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.7, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``.

    A null text is scored as an empty one, whose score is the model's at no features. Rows with a null
    id are not held out; rows that repeat are each scored; an empty table gives no rows. Labels that
    are null or not 0 or 1 are not used. Only the named columns are read, and only the text is scored.
    """
    own = columns_as(docs, doc_id=id_col, text=text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(own, labels, label, train_rows))  # FEATURES numbers, 8 MB

    def score():
        table = Table(token_code)
        return lambda text: (model.value.score(ngram_features(text, table)),)

    out = scored(own, score, [("score", pa.float64())], "score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, text_col: str = "text", label: str = "quality", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``.

    The model is fitted on ``train_docs`` (doc_id, text) as in :func:`quality_scores`.
    """
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    model = docs.sparkSession.sparkContext.broadcast(fit(train_docs, labels, label, train_rows))

    def run(batches):
        table = Table(token_code)
        for batch in batches:
            yield batch.filter(pa.array([model.value.score(ngram_features(row[text_col].as_py() or "", table)) >= threshold for row in batch.column(0)], pa.bool_()))

    return docs.select(F.struct("*").alias("row")).mapInArrow(released(run), T.StructType([T.StructField("row", docs.schema)])).select("row.*")
