import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.data import documents, odd, vocabulary
from waybridge.llm import simhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(t):
    words = [w for w in (t or "").encode().translate(LOWER).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(rows):
    """(id, fingerprint, component) by comparing all with all."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    names = {}
    for k, (i, _) in enumerate(rows):
        names.setdefault(find(k), []).append(i)
    return sorted(str((i, f"{f:016x}", min((x for x in names[find(k)] if x is not None), default=None))) for k, (i, f) in enumerate(rows))


def near_texts(seed, groups, size, words_each, edits):
    rng, words = random.Random(seed), vocabulary(seed)
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(words_each)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    return list(enumerate(texts))


def test_same_as_all_pairs(spark):
    texts = near_texts(3, 12, 8, 220, 3) + odd(random.Random(1), vocabulary(3))
    texts += [(910, "a b"), (911, "A \t b"), (912, "b a"), (None, texts[0][1]), (None, "only here and without id"), (913, "")]
    got = simhash.near_duplicates(documents(spark, texts).repartition(4))
    want = grouped([(i, fingerprint(t)) for i, t in texts])
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert len({w.split()[-1] for w in want}) < len(texts) - 20


def test_spark_hashes_the_same(spark):
    words = ["one two three", "straße é ß", "x"]
    hashed = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] % (1 << 64) for r in hashed] == [xxhash.xxh64_intdigest(w.encode(), simhash.SEED) for w in words]


def test_runs_of_a_long_text(monkeypatch):
    rng, words = random.Random(5), vocabulary(5)
    text = " \n".join(rng.choice(words) for _ in range(900)).encode()
    whole = simhash.fingerprint(text)
    for run in (1, 7, 100, 4_000):
        monkeypatch.setattr(simhash, "RUN", run)
        assert simhash.fingerprint(text) == whole
        assert simhash.fingerprint(b"  a   " + b" " * 50 + b"b ") == simhash.fingerprint(b"a b")


def crowd(seed, n):
    """Random fingerprints, and neighbours of a few of them at all small distances and in both halves."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for base in rng.sample(sorted(out), 5):
        for _ in range(n // 4):
            fp = base
            for _ in range(rng.randint(1, 5)):
                fp ^= 1 << rng.choice([*range(0, 12), *range(40, 52)] if rng.random() < 0.9 else range(64))
            out.add(fp)
    return sorted(out)


@pytest.mark.parametrize("limit", [2, 20, 10_000])
def test_no_link_is_lost_in_crowds(spark, limit):
    fps = crowd(limit, 250)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    different = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(different, limit).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    got = {f: find(f) for f in fps}
    groups = {}
    for f, r in got.items():
        groups.setdefault(r, set()).add(f)
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                assert got[a] == got[b]
    assert max(map(len, groups.values())) > 30


def test_finer_keys_hold_few(spark):
    # a crowd in one half: with finer keys no more than four fingerprints meet
    fps = np.array([i * 2654435761 % (1 << 32) for i in range(3_000)], np.uint64)
    keys, places = simhash.index_keys(fps.view(np.int64), np.full(simhash.SLOTS // 8, 255, np.uint8))
    _, sizes = np.unique(keys, return_counts=True)
    assert sizes.max() <= 4 and len(places) == len(keys)


def test_nothing_in_nothing_out(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    got = simhash.near_duplicates(documents(spark, [(4, None), (2, " "), (9, "a b c d")])).collect()
    assert sorted((r.doc_id, r.component_id, r.fingerprint == "0" * 16) for r in got) == [(2, 2, True), (4, 2, True), (9, 9, False)]
