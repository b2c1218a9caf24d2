"""Quality scores by a support vector machine on naive-Bayes-scaled n-grams.

Features are indicators of the word 1-grams and 2-grams of the whole text, hashed into ``2**BITS`` places; a word is taken
with A-Z lowered, and a run of bytes that are neither letters, digits, white space nor above 127 is a word of its own. Each
indicator is scaled by its log-count ratio between the classes. A linear machine with squared hinge loss is fitted to them by
dual coordinate descent, and its margin is turned into a probability by a logistic curve fitted on rows left out of the fit.

The fit uses at most ``PER_CLASS`` labelled rows of each class, the first by a hash of the id (a documented bound); the
classes' true numbers come back in as weights of the logistic curve. Rows whose label is null or contradictory are not used. With
one class only, or none, every score is that class's share (0.5 for none). Null and empty texts have no n-gram and are scored
by the intercept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import materialize
from weft.llm.kernels import CHUNK, Words, mix, runs, text_bytes, windows

BITS = 18
PER_CLASS = 8_000
EPOCHS = 12
COST = 1.0
SMOOTH = 1.0
#: Every this many-th row of the sample fits the logistic curve instead of the machine.
CALIBRATE = 4
THRESHOLD = 0.3

#: Bytes that stand for themselves as words: ASCII but letters, digits and white space.
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def features(texts: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """Sorted distinct places per text."""
    data, offsets = text_bytes(texts)
    for lo, hi in runs(offsets, CHUNK):
        own = offsets[lo:hi + 1]
        part = data[own[0]:own[-1]]
        words = Words(part, own - own[0])
        # cut words where marks begin and end
        mark = _MARK[part]
        change = np.flatnonzero(mark[1:] != mark[:-1]) + 1
        inside = np.searchsorted(words.start, change, "right") - 1
        valid = (inside >= 0) & (change < words.end[inside]) & (change > words.start[inside]) if len(words.start) else (
            np.zeros(len(change), bool))
        cuts = change[valid]
        starts = np.sort(np.concatenate([words.start, cuts]))
        ends = np.sort(np.concatenate([words.end, cuts]))
        words.start, words.end = starts, ends
        words.first = np.searchsorted(starts, own - own[0])
        one = words.hashes()
        two = windows(one, 2)
        shift = np.uint64(64 - bits)
        one_at, two_at = (mix(one) >> shift).astype(np.int32), (two >> shift).astype(np.int32)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            yield np.unique(np.concatenate([one_at[a:b], two_at[a:max(a, b - 1)]]))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Per place the log of its share among the positive texts' features over that among the negative ones'."""
    counts = np.full((2, 1 << bits), SMOOTH)
    for row, label in zip(rows, labels.tolist(), strict=True):
        counts[label, row] += 1
    share = counts / counts.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, size: int, cost: np.ndarray,
                 epochs: int = EPOCHS) -> np.ndarray:
    """Weights and intercept (last) of the machine with squared hinge loss; one pass over the rows per epoch."""
    weights = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    diagonal = 0.5 / cost
    norm = np.array([float(v @ v) + 1.0 for v in values]) + diagonal
    order = np.random.default_rng(1)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)).tolist():
            row, value, y = rows[i], values[i], sign[i]
            gradient = y * (float(weights[row] @ value) + weights[-1]) - 1.0 + diagonal[i] * alpha[i]
            if alpha[i] == 0.0 and gradient >= 0.0:
                continue
            new = max(alpha[i] - gradient / norm[i], 0.0)
            step = (new - alpha[i]) * y
            alpha[i] = new
            weights[row] += step * value
            weights[-1] += step
            largest = max(largest, abs(gradient))
        if largest < 1e-3:
            break
    return weights


def logistic(margin: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve that turns margins into probabilities, by Newton steps."""
    slope, offset = 1.0, 0.0
    total = weight.sum()
    # targets short of 0 and 1 keep the curve finite when the classes are apart
    target = np.where(labels == 1, 1 - 1 / (len(labels) + 2), 1 / (len(labels) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -40, 40)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(g * margin).sum() + 1e-4 * total * (slope - 1), g.sum()])
        hessian = np.array([[(h * margin * margin).sum() + 1e-4 * total, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.linalg.solve(hessian + 1e-9 * np.eye(2), gradient)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        slope, offset = max(slope - step[0], 1e-3), offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return slope, offset


def fit(rows: list[np.ndarray], labels: np.ndarray, numbers: tuple[int, int], bits: int = BITS) -> np.ndarray:
    """The model: scaled weights, intercept, slope and offset. ``numbers``: rows of each class in all labelled data."""
    model = np.zeros((1 << bits) + 3)
    model[-2] = 1.0
    if min(np.bincount(labels, minlength=2)) < 2:
        share = (numbers[1] + 0.5) / (sum(numbers) + 1) if sum(numbers) else 0.5
        model[-1] = np.log(share / (1 - share))
        return model
    turn = np.zeros(len(labels), np.int64)
    for label in (0, 1):
        turn[labels == label] = np.arange((labels == label).sum())
    held = turn % CALIBRATE == CALIBRATE - 1
    if len(np.unique(labels[held])) < 2:
        held = np.zeros(len(labels), bool)
    use = np.flatnonzero(~held).tolist()
    ratio = log_ratios([rows[i] for i in use], labels[~held], bits)
    own = [rows[i] for i in use]
    values = [ratio[r] / max(np.sqrt(len(r)), 1.0) for r in own]
    count = np.bincount(labels[~held], minlength=2)
    cost = COST * len(own) / (2 * count[labels[~held]])
    weights = dual_descent(own, values, labels[~held] * 2.0 - 1, 1 << bits, cost)
    model[:1 << bits], model[-3] = weights[:-1] * ratio, weights[-1]
    check = np.flatnonzero(held if held.any() else ~held)
    margin = margins([rows[i] for i in check.tolist()], model)
    seen = np.bincount(labels[check], minlength=2)
    weight = (np.array(numbers) / np.maximum(seen, 1))[labels[check]]
    model[-2:] = logistic(margin, labels[check], weight)
    return model


def margins(rows: list[np.ndarray], model: np.ndarray) -> np.ndarray:
    return np.array([model[r].sum() / max(np.sqrt(len(r)), 1.0) for r in rows]) + model[-3]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> np.ndarray:
    """Fit on the texts of ``docs`` whose doc_id has a label in ``labels`` (doc_id, label); see the module."""
    agreed = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("_most"))
    agreed = agreed.where("label = _most").select("doc_id", "label")
    order = F.xxhash64(F.lit(11), "doc_id")
    picked, numbers = None, [0, 0]
    for r in agreed.groupBy("label").count().collect():
        numbers[r["label"]] = r["count"]
    for value in (0, 1):
        own = agreed.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        picked = own if picked is None else picked.unionByName(own)
    # at most two times per_class ids, and a text for each
    sample = docs.select("doc_id", "text").join(F.broadcast(materialize(picked, "sample")), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    counted = (int(numbers[0]), int(numbers[1]))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([r.tobytes() for r in features(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), rows],
                                             ["doc_id", "label", "places"])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        rows = [np.frombuffer(x, np.int32) for x in group["places"]]
        return pd.DataFrame({"model": [fit(rows, group["label"].to_numpy(np.int64), counted).tobytes()]})

    seen = sample.select("doc_id", "label", "text").mapInArrow(places, "doc_id long, label int, places binary")
    made = materialize(seen.withColumn("sample", F.lit(1)).groupBy("sample").applyInPandas(one, "model binary"), "model").first()
    return np.frombuffer(made[0]) if made else fit([], np.zeros(0, np.int64), counted)


def score(docs: DataFrame, model: np.ndarray, out: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 for each text; higher: more like label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*kept).schema.add(out, "double")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = sent.value
            rows = list(features(batch.column("text")))
            margin = margins(rows, m) if rows else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(m[-2] * margin + m[-1], -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p)], [*kept, out])

    return docs.select(*kept).mapInArrow(task, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose crc32 of the id as text is divisible by ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == 0, F.lit(False))

