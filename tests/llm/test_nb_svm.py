import random
import zlib

import numpy as np
import pytest

from tests.llm.data import documents, odd, vocabulary
from waybridge.llm import nb_svm


def labelled_texts(n=400):
    """Prose and junk; a third of the rows carries no label."""
    rng, words = random.Random(10), vocabulary(10, 600)
    texts, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        ws = [rng.choice(words) for _ in range(rng.randint(8, 80))]
        texts.append((i, " ".join(ws) if good else rng.choice([" | ".join(ws), " ".join(w + "%%%" for w in ws), " ".join(w.upper() + "!!" for w in ws)])))
        if rng.random() < 0.66:
            labels.append((i, int(good), 0))
    return texts, labels


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_learns_junk_from_the_learning_folds_only(spark):
    texts, labels = labelled_texts()
    rng = random.Random(1)
    got = nb_svm.classify(documents(spark, texts + odd(rng, vocabulary(10, 600))), marks(spark, labels)).collect()
    truth = dict((i, q) for i, q, _ in labels)
    assert len(got) == len(texts) + 8
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 20
    # flipped labels of the held-out fold change nothing
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    again = {r.doc_id: r.score for r in nb_svm.classify(documents(spark, texts), marks(spark, flipped)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got if r.doc_id < 900)


def test_counts_and_scales_equal_counting_by_hand(spark):
    texts, labels = labelled_texts(60)
    train = nb_svm.labelled(documents(spark, texts), marks(spark, labels + labels[:5] + [(1, None, 0)]), 5, 0)
    counts = nb_svm.class_counts(train)
    want = np.zeros((2, nb_svm.FEATURES))
    import pyarrow as pa
    truth, by_id = {i: q for i, q, _ in labels}, dict(texts)
    for i, q in truth.items():
        if zlib.crc32(str(i).encode()) % 5:
            _, found = nb_svm.features(pa.array([by_id[i]]))
            want[q, found] += 1
    assert (counts == want).all()


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5))
    y = np.sign(x @ rng.standard_normal(5) + 0.3 * rng.standard_normal(60))
    w, b = nb_svm.dual_coordinate_descent([(np.arange(5), v) for v in x], y, 1.0, 500, 5)
    loss = lambda w, b: (w @ w + b * b) / 2 + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    for _ in range(300):
        assert loss(w + 0.05 * rng.standard_normal(5), b + 0.05 * rng.standard_normal()) >= best - 0.02


@pytest.mark.parametrize("rows, score", [([], 0.5), ([(1, 1, 0), (2, 1, 0)], 0.98), ([(1, 0, 0), (2, 0, 0)], 0.02)])
def test_without_two_classes_the_score_is_one_share(spark, rows, score):
    got = nb_svm.classify(documents(spark, [(1, "a b"), (2, "c"), (3, None)]), marks(spark, rows)).collect()
    assert [round(r.score, 6) for r in got] == [score] * 3
    assert nb_svm.classify(documents(spark, []), marks(spark, rows)).count() == 0
