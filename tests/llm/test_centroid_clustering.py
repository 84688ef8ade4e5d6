import hashlib
import math
import random

import duckdb
import pytest

from waybridge.llm import centroid_clustering as cc

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x", "y") for i, e in rows], SCHEMA)


def sample(seed, n=300, groups=9):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(groups)]
    # a third of all vectors are copies of one
    return [(i, centres[0] if i % 3 == 0 else [c + rng.gauss(0, 0.4) for c in rng.choice(centres)]) for i in range(n)]


def by_hand(rows, k=16, rounds=3):
    import numpy as np
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows
             if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    hashed = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in {(i, tuple(v)) for i, v in whole} if i is not None)
    centroids = [list(v) for _, v in hashed[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in whole]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(whole, of) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    best = [(i, *near(v)) for i, v in whole]
    inertia = [sum(d for _, d, c in best if c == j) for j in range(len(centroids))]
    return sorted((str(i), c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in best)


def got(df):
    return sorted((str(r.vec_id), *r[1:]) for r in df.collect())


def test_same_as_by_hand(spark):
    rows = sample(1) + [
        (900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.1] * 63 + [None]), (905, [0.1] * 63 + [math.nan]),
        (906, [math.inf] + [0.1] * 63), (None, [0.25] * 64), (7, [0.5] * 64), (7, [0.5] * 64), (907, [0.0] * 64), (908, [-0.0] * 64)]
    assert got(cc.cluster(vectors(spark, rows).repartition(5))) == by_hand(rows)


def test_same_as_the_sql(spark):
    import pandas as pd
    rows = sample(2, 150)
    con = duckdb.connect()
    con.register("embeddings", pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    con.execute("CREATE TABLE e AS SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM embeddings")
    want = sorted((str(r[0]), *r[1:]) for r in con.sql(cc.SQL.replace("FROM embeddings", "FROM e")).fetchall())
    assert got(cc.cluster(vectors(spark, rows))) == want


def test_ties_few_vectors_and_none(spark):
    # equally near centroids: the first; fewer vectors than centroids: each a start
    rows = [(i, [float(i % 2)] * 64) for i in range(6)]
    assert got(cc.cluster(vectors(spark, rows))) == by_hand(rows)
    assert cc.cluster(vectors(spark, [])).count() == 0
    assert cc.cluster(vectors(spark, [(1, None)])).count() == 0
    only = cc.cluster(vectors(spark, [(None, [1.0] * 64)])).collect()
    assert [tuple(r) for r in only] == [(None, None, None, None, None, None)]


def test_starts_widen_their_threshold(spark):
    # one vector in many rows may fill the first threshold
    rows = [(5, [1.0] * 64)] * 2_000 + sample(4, 60)
    assert got(cc.cluster(vectors(spark, rows))) == by_hand(rows)


def test_large_components_are_held(spark):
    rows = {1: 3e38, 2: -3e38, 3: 0.0}
    held = {i: max(-cc.MOST, min(cc.MOST, int(x))) for i, x in rows.items()}
    start = min(rows, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())
    out = cc.cluster(vectors(spark, [(i, [x] * 64) for i, x in rows.items()]), clusters=1, rounds=0).collect()
    assert {r.vec_id: r.distance for r in out} == {i: 64 * (held[i] - held[start]) ** 2 for i in rows}


@pytest.mark.parametrize("k", [1, 4])
def test_other_numbers_of_clusters(spark, k):
    rows = sample(5, 80)
    assert got(cc.cluster(vectors(spark, rows), clusters=k, rounds=2)) == by_hand(rows, k, 2)


def test_no_python_worker_in_the_plan(spark):
    whole = cc.integers(vectors(spark, sample(6, 20)))
    plan = cc.assign(whole, [[0] * 64, [1] * 64])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
