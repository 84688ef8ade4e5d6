import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tests.llm.data import documents, odd, vocabulary
from waybridge.llm import winnowing


def words_of(t):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_hand(texts, items):
    wanted = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wanted[tuple(w[k:k + n])].add(i)
    sizes, out = {len(k) for k in wanted}, []
    for i, t in texts:
        w, hit, held = words_of(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wanted:
                    hit.update(range(k, k + n))
                    held |= wanted[tuple(w[k:k + n])]
        said = ",".join(sorted(map(str, held)))
        out.append((i, len(w), len(hit), len(held), hashlib.sha256(said.encode()).hexdigest(), bool(hit)))
    return out


def sample(seed=13):
    rng, words = random.Random(seed), vocabulary(seed, 40) + ["É", "ß1", "漢字"]
    line = lambda n: [rng.choice(words) for _ in range(n)]
    items = [line(n) for n in (30, 25, 12, 10, 9, 4, 2, 1, 15, 11)]
    items += [items[0], items[1][5:20], ["same"] * 14]
    texts = []
    for i in range(200):
        t = line(rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items)
            a = rng.randrange(len(item))
            t[rng.randint(0, len(t)):0] = item[a:a + rng.choice([5, 9, 10, 11, 40])]
        texts.append((i, rng.choice([" ", ", ", "\n", "-"]).join(w.upper() if w.isascii() and rng.random() < 0.2 else w for w in t)))
    texts += [(300, "same " * 60), (301, "same " * 13), (302, " ".join(items[0] * 3))] + odd(rng, vocabulary(99))
    return texts, [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, "  ..."), (7, " ".join(items[7]))]


def test_same_as_every_window_by_hand(spark):
    for seed in (13, 14):
        texts, items = sample(seed)
        got = winnowing.decontaminate(documents(spark, texts), documents(spark, items).withColumnRenamed("doc_id", "item_id"))
        want = by_hand(texts, items)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert 20 < sum(w[-1] for w in want) < len(want)


def test_clean_keeps_rows_as_they_are(spark):
    texts, items = sample()
    table, bench = documents(spark, texts), documents(spark, items).withColumnRenamed("doc_id", "item_id")
    kept = winnowing.clean(table, bench)
    assert kept.columns == table.columns
    want = sorted((i, t or "") for (i, t), r in zip(texts, by_hand(texts, items)) if not r[-1])
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == want


def test_every_long_shared_span_gives_a_shared_fingerprint():
    rng = random.Random(15)
    words = vocabulary(15, 12)
    for _ in range(200):
        span = [rng.choice(words) for _ in range(winnowing.SPAN)]
        sides = [" ".join([rng.choice(words) for _ in range(rng.randint(0, 9))] + span + [rng.choice(words) for _ in range(rng.randint(0, 9))]) for _ in range(2)]
        marks = [set(winnowing.fingerprints(*winnowing.words(pa.array([s])), winnowing.K, winnowing.WINDOW)[1].tolist()) for s in sides]
        assert marks[0] & marks[1]
    hashes, starts = winnowing.words(pa.array([" ".join(rng.choice(vocabulary(16, 5_000)) for _ in range(20_000))]))
    # the density of chosen places is 2 / (window + 1)
    assert abs(len(winnowing.fingerprints(hashes, starts, 5, 6)[0]) / np.diff(starts)[0] - 2 / 7) < 0.02


def test_empty_tables(spark):
    bench = documents(spark, [(1, "a b c d e f g h i j k")]).withColumnRenamed("doc_id", "item_id")
    assert winnowing.decontaminate(documents(spark, []), bench).count() == 0
    got = winnowing.decontaminate(documents(spark, [(1, "a b"), (1, "a b")]), bench.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)] * 2
