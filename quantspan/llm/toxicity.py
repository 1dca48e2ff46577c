"""Toxicity severity by cumulative-link ordinal regression.

Features are words and the runs of four and five characters within them. One weight a feature is shared
by all thresholds: P(grade <= k) = logistic(threshold_k - sum of the text's weights). The labels say
only whether a text is toxic. Grades above 0 are therefore derived from the training rows: toxic texts
are ranked by the share of their words whose features have high odds of being toxic, and the terciles
are grades 1 to 3. Weights are kept sparse by an absolute-value penalty, so features that say nothing
have weight 0 and long clean texts do not add up to a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, columns_as
from .tokens import Table, scored, training_rows, word

#: Labelled rows that the model is fitted on, at most; scoring covers every row.
TRAIN_ROWS = 12_000
#: Sample texts that a feature of the model is in, at least.
LEAST = 3
#: A feature must be told apart from chance at about one in two thousand.
CHI_SQUARE = 12.0
GRADES = 4


def features(token: str) -> tuple[int, ...]:
    """32-bit keys of the word and of the runs of four and five characters in it."""
    own = word(token)
    runs = {own[i : i + n] for n in (4, 5) for i in range(len(own) - n + 1)}
    return (zlib.crc32(b"=" + own.encode()), *(zlib.crc32(b"~" + x.encode()) for x in sorted(runs)))


@dataclass(frozen=True)
class Model:
    weight: dict[int, float]  # by key; other features count for nothing
    thresholds: np.ndarray

    def at_least(self, total: float) -> np.ndarray:
        """Probability of each grade from 1 up, or a higher one."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - total, -500, 500)))


def fit_rows(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, keys: np.ndarray, penalty: float = 3e-5, steps: int = 500) -> Model:
    """``rows``: of each text, which of the features it has; ``dense``: its share of strong words."""
    if len(set(y.tolist())) < 2:
        return Model({}, np.full(GRADES - 1, 4.0 if not len(y) or y[0] == 0 else -4.0))
    flat, of = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cuts = np.quantile(dense[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, dense, "left"), 0)
    n, w = len(rows), np.zeros(len(keys))
    reached = np.array([(grade >= k).mean() for k in range(1, GRADES)]).clip(1e-4, 1 - 1e-4)
    theta = np.log((1 - reached) / reached)
    sum_w, sum_t = np.full(len(keys), 1e-8), np.full(GRADES - 1, 1e-8)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(steps):
        total = np.bincount(of, weights=w[flat], minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        low, high = logistic(edges[grade] - total), logistic(edges[grade + 1] - total)
        gap = np.maximum(high - low, 1e-12)
        slope = 1 - low - high
        g = np.bincount(flat, weights=slope[of], minlength=len(keys)) / n
        g_low, g_high = low * (1 - low) / gap, -high * (1 - high) / gap
        t = np.array([g_low[grade == k].sum() + g_high[grade == k - 1].sum() for k in range(1, GRADES)]) / n
        sum_w, sum_t = sum_w + g * g, sum_t + t * t
        rate = 0.5 / np.sqrt(sum_w)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        theta = np.maximum.accumulate(theta - 0.5 / np.sqrt(sum_t) * t + np.arange(GRADES - 1) * 1e-9)
    return Model({int(k): float(v) for k, v in zip(keys, w, strict=True) if v}, theta)


def _counts(batches):
    """Of each feature, in how many clean and toxic texts of this partition it is."""
    table, found = Table(features), ([], [])
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys = set().union(*map(table.__getitem__, (text or "").split()))
            found[y].append(np.fromiter(keys, np.int64, len(keys)))
    for y in (0, 1):
        keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found[y]]), return_counts=True)
        for k in range(0, len(keys), 50_000):
            part = n[k : k + 50_000]
            both = [np.zeros_like(part), part] if y else [part, np.zeros_like(part)]
            yield pa.RecordBatch.from_pydict({"key": keys[k : k + 50_000], "clean": both[0], "toxic": both[1]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` labelled rows of ``docs``, in one task. What comes to the driver is bounded
    by the sample: the features that tell the classes apart, and the model."""
    work = Workspace(docs.sparkSession, "toxicity")
    sample = training_rows(docs, labels, label, train_rows, work)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    counts = sample.mapInArrow(_counts, "key long, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST)
    having = F.col("toxic") + F.col("clean")
    apart = F.pow(F.col("toxic") * float(n0) - F.col("clean") * float(n1), 2) * (n0 + n1) / (having * F.greatest(n0 + n1 - having, F.lit(1)) * float(max(1, n0 * n1)))
    best = counts.where(apart >= CHI_SQUARE).orderBy(apart.desc(), "key").toArrow()
    key, clean, toxic = (best[c].to_numpy() for c in ("key", "clean", "toxic"))
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    place, strong = {int(k): i for i, k in enumerate(key)}, {int(k) for k, o in zip(key, odds, strict=True) if o > 2.5}

    def run(batches):
        def known(token: str) -> tuple:
            keys = features(token)
            return tuple(place[k] for k in keys if k in place), not strong.isdisjoint(keys)

        table = Table(known)
        for batch in batches:
            rows, dense = [], []
            for text in batch.column(1).to_pylist():
                found = [table[x] for x in (text or "").split()]
                rows.append(np.array(sorted(set().union(*(x[0] for x in found))), np.int32).tobytes())
                dense.append(sum(x[1] for x in found) / max(1, len(found)))
            yield pa.RecordBatch.from_pydict({"label": batch.column(0), "dense": pa.array(dense, pa.float64()), "found": pa.array(rows, pa.binary())})

    def whole(batches):
        """All rows of the sample, which is bounded, in an order that does not depend on the partitions."""
        rows = sorted((found, y, d) for batch in batches for y, d, found in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        model = fit_rows([np.frombuffer(found, np.int32) for found, _, _ in rows], np.array([d for _, _, d in rows]), np.array([y for _, y, _ in rows], np.int64), key)
        yield pa.RecordBatch.from_pydict({"key": pa.array([*model.weight, *(-1 - k for k in range(GRADES - 1))], pa.int64()), "value": pa.array([*model.weight.values(), *model.thresholds], pa.float64())})

    got = sample.mapInArrow(run, "label int, dense double, found binary").repartition(1).mapInArrow(whole, "key long, value double").collect()
    work.close()
    if not got:
        return fit_rows([], np.zeros(0), np.zeros(0, np.int64), key)
    held = {r["key"]: r["value"] for r in got}
    return Model({k: v for k, v in held.items() if k >= 0}, np.array([held[-1 - k] for k in range(GRADES - 1)]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Grade every whole text: ``doc_id, held_out, score, predicted, severity_grade, expected_severity``.

    ``score`` is the probability of any grade above 0 and ``predicted`` is 1 if it reaches ``threshold``;
    ``severity_grade`` is the likeliest grade and ``expected_severity`` the mean of the grades. A null
    text is graded as an empty one, rows that repeat are each graded, an empty table gives no rows,
    rows with a null id are not held out, labels that are null or not 0 or 1 are not used, and only
    the named columns are read.
    """
    own = columns_as(docs, doc_id=id_col, text=text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(own, labels, label, train_rows))  # words of the sample at most

    def score():
        weight = model.value.weight
        table = Table(lambda token: tuple(k for k in features(token) if k in weight))

        def of(text: str) -> tuple:
            found = set().union(*map(table.__getitem__, text.split()))
            reach = model.value.at_least(float(sum(weight[k] for k in sorted(found))))
            grades = -np.diff(np.concatenate([[1.0], reach, [0.0]]))
            return float(reach[0]), int(grades.argmax()), float(reach.sum())

        return of

    fields = [("score", pa.float64()), ("severity_grade", pa.int32()), ("expected_severity", pa.float64())]
    out = scored(own, score, fields, "score double, severity_grade int, expected_severity double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "severity_grade", "expected_severity")
