"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: words, pairs of words, word shapes and pairs of shapes (a shape is
what a word looks like: runs of lower case, upper case and digits become one sign each). Each indicator is
scaled by the log ratio of its class frequencies, counted by Spark over all labelled rows; a linear
hinge-loss model on these scaled, length-normalised vectors is fitted by dual coordinate descent on a bounded
sample of labelled rows, and a logistic curve fitted on the part of the sample that the model has not seen
turns margins into scores.

Defined cases: a null or empty text has no features and gets the score of the bias alone. Without labels, or
with one class only, every score is the share of label 1 (one half without labels). A doc_id labelled twice counts with
its lower label; a repeated row is scored again. A null doc_id is never labelled. An empty table gives no
rows. Only doc_id and text are read from the documents, and doc_id is no input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from waybridge.llm.common import batched, discard, mix, objects, per_batch, picked, record_batch, slotted, stored

#: Hashed n-grams; bounds the model and the count tables.
FEATURE_BITS = 18
FEATURES = 1 << FEATURE_BITS
#: Labelled rows that the linear model is fitted on at most, half of them from each class.
SAMPLE_ROWS = 4_000
#: Slots of labelled ids, and so most rows of the table that is broadcast to find them.
LABEL_SLOTS = 1 << 20
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 12
THRESHOLD = 0.3
_SIGNS = ".,;:!?%&$#*+=/|-_()[]{}\"'"


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the checksum of the id's text; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _codes(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(objects(values), dtype=object), categorize=False) if len(values) else np.zeros(0, np.uint64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a column of texts, ordered by row and feature."""
    split = pc.utf8_split_whitespace(column.fill_null(""))
    coded = split.flatten().dictionary_encode()
    word, at = coded.dictionary, coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(column), dtype=np.uint64), np.diff(split.offsets.to_numpy()))
    plain = _codes(pc.utf8_lower(pc.utf8_trim(word, characters=_SIGNS)))
    shape = word
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{Lo}+", "o"), (r"\p{N}+", "9")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    shape = shape.dictionary_encode()
    shaped = _codes(shape.dictionary)[shape.indices.to_numpy()] if len(word) else np.zeros(0, np.uint64)
    real = pc.binary_length(word).to_numpy()[at] > 0 if len(at) else np.zeros(0, bool)
    at, owner = at[real], owner[real]
    keys = []
    for salt, values in ((1, plain), (2, shaped)):
        one = mix(values + np.uint64(salt))[at]
        keys.append((owner, one))
        if len(one) > 1:
            same = owner[1:] == owner[:-1]
            keys.append((owner[1:][same], mix(one[:-1] * np.uint64(3) + one[1:])[same]))
    pairs = np.unique(np.concatenate(
        [(o << np.uint64(FEATURE_BITS)) | (k >> np.uint64(64 - FEATURE_BITS)) for o, k in keys]))
    return (pairs >> np.uint64(FEATURE_BITS)).astype(np.int64), (pairs & np.uint64(FEATURES - 1)).astype(np.int64)


@dataclass
class Model:
    """``weights`` and ``scale`` per feature; margin m of a text becomes 1 / (1 + exp(-(slope * m + shift)))."""
    weights: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, rows: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(rows, self.scale[found] ** 2, minlength=n))
        return np.bincount(rows, self.weights[found], minlength=n) / np.maximum(norm, 1e-9) + self.bias

    def scores(self, rows: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows, found, n) + self.shift, -30, 30)))


def dual_coordinate_descent(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: float,
                            epochs: int, size: int) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model with a constant feature: minimise |w|^2 / 2 + cost * hinge loss in the dual."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(samples))
    square = np.array([float(v @ v) + 1 for _, v in samples])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(samples)):
            index, value = samples[i]
            slope = labels[i] * (w[index] @ value + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * labels[i]
            if step:
                w[index] += step * value
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * theta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def labelled(docs: DataFrame, labels: DataFrame, folds: int, held_out: int) -> DataFrame:
    """doc_id, y and text of the rows to learn from, written once."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("y"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(fold(F.col("doc_id"), folds) != held_out)
    # texts without a label are left out before the shuffle, as far as the slots of labelled ids tell them apart
    likely = slotted(rows, ["doc_id"], marks)
    # the same plan at every size: few labels could be broadcast, many could not
    return stored(likely.hint("merge").join(marks, "doc_id"))


def class_counts(train: DataFrame) -> np.ndarray:
    """Texts of each class that hold a feature, over all rows: two rows of ``FEATURES`` counts."""
    def count(batches):
        seen = np.zeros((2, FEATURES), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            rows, found = features(batch.column("text"))
            for label in (0, 1):
                seen[label] += np.bincount(found[y[rows] == label], minlength=FEATURES)
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])],
                                         names=["feature", "n0", "n1"])

    sums = batched(train.select("y", "text")).mapInArrow(count, "feature long, n0 long, n1 long").groupBy(
        "feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.zeros((2, FEATURES))
    for label in (0, 1):
        counts[label, sums["feature"].to_numpy()] = sums[f"n{label}"].to_numpy()
    return counts


def fit(train: DataFrame) -> Model:
    """Learn from rows (doc_id, y, text)."""
    totals = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        share = {0: 0.02, 1: 0.98}.get(next(iter(totals), None), 0.5)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))
    p, q = class_counts(train)[::-1] + SMOOTHING
    scale = np.log((p / p.sum()) / (q / q.sum()))
    some = None
    for label in (0, 1):
        part = picked(train.where(F.col("y") == label), SAMPLE_ROWS // 2)
        some = part if some is None else some.unionByName(part)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = features(batch.column("text"))
        offsets = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.astype(np.int32)))],
            names=["doc_id", "y", "found"])

    sample = batched(some.select("doc_id", "y", "text")).mapInArrow(
        per_batch(describe), "doc_id long, y int, found array<int>").toArrow().sort_by("doc_id")
    y = sample["y"].to_numpy().astype(float)
    lists = sample["found"].combine_chunks()
    rows, found = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64)
    cut = np.searchsorted(rows, np.arange(len(y) + 1))
    index = [found[a:b] for a, b in zip(cut[:-1], cut[1:])]
    value = [scale[i] / max(np.linalg.norm(scale[i]), 1e-9) for i in index]
    order = np.random.default_rng(3).permutation(len(y))
    apart = order[: len(y) // 4]
    learn = order[len(y) // 4:] if len(set(y[order[len(y) // 4:]])) == 2 else order
    share = np.bincount(y[learn].astype(int), minlength=2)
    w, bias = dual_coordinate_descent(
        [(index[i], value[i]) for i in learn], 2 * y[learn] - 1, COST, EPOCHS, FEATURES)
    model = Model(w * scale, scale, bias, 1.0, 0.0)
    if len(set(y[apart])) < 2 or not share.all():
        apart = order
    margins = model.margins(rows, found, len(y))
    model.slope, model.shift = _logistic(margins[apart], y[apart])
    return model


def learned(docs: DataFrame, labels: DataFrame, folds: int, held_out: int) -> Model:
    """Model from the labelled rows outside the held-out fold."""
    train = labelled(docs, labels, folds, held_out)
    model = fit(train)
    discard(train)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score of every whole text, in column ``score`` behind the columns of ``docs``' doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = features(batch.column("text"))
        return record_batch(schema, {
            "doc_id": batch.column("doc_id"), "score": shared.value.scores(rows, found, batch.num_rows)})

    return batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(
        per_batch(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores at least ``threshold``, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = features(batch.column("text"))
        return batch.filter(pa.array(shared.value.scores(rows, found, batch.num_rows) >= threshold))

    return batched(docs).mapInArrow(per_batch(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold and score every row."""
    model = learned(docs, labels, folds, held_out)
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
