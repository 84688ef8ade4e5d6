import random
import re
from collections import Counter

import numpy as np

from tests.llm.data import documents, odd, vocabulary
from waybridge.llm import signature_join
from waybridge.llm.components import components


def shingles(t, n=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def by_hand(texts, n=3, percent=90):
    sets = [shingles(t, n) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    names = {}
    for k, (i, _) in enumerate(texts):
        names.setdefault(find(k), []).append(i)
    return [(i, len(sets[k]), min((x for x in names[find(k)] if x is not None), default=None) if sets[k] else i) for k, (i, _) in enumerate(texts)]


def crowd(seed, groups, size, edits, length):
    """Copies with a few words changed, from none to past the limit, and strangers that share passages."""
    rng, words = random.Random(seed), vocabulary(seed, 300)
    passage = [rng.choice(words) for _ in range(30)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(*length))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t = t[: len(t) - rng.randint(0, max(1, len(t) // 20))]
            texts.append(" ".join(t if rng.random() < 0.8 else [w.upper() for w in t]))
    texts += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(0, 20))]) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_same_components_as_all_pairs(spark):
    texts = crowd(17, 12, 12, 4, (4, 120)) + odd(random.Random(1), vocabulary(17))
    texts += [(910, "a b"), (911, "A  b"), (912, "b a"), (None, texts[0][1]), (None, "only here without id")]
    got = signature_join.join_components(documents(spark, texts))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, by_hand(texts)))


def test_a_crowd_over_several_leaves(spark, monkeypatch):
    monkeypatch.setattr(signature_join, "LEAF", 8)
    texts = crowd(18, 2, 90, 3, (100, 110))
    got = sorted(map(tuple, signature_join.join_components(documents(spark, texts)).collect()))
    want = sorted(by_hand(texts))
    assert got == want and Counter(w[2] for w in want).most_common(1)[0][1] > 3 * 8


def test_other_limits_and_one_document_of_each_group(spark):
    texts = crowd(19, 8, 8, 4, (20, 60)) + [(901, None), (902, " "), (903, None), (904, "said twice here again"), (904, "said twice here again")]
    table = documents(spark, texts)
    kept = signature_join.one_per_component(table, 5, 80)
    assert kept.columns == table.columns
    want = by_hand(texts, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, n, c in want if i == c})


def test_no_pair_above_the_limit_is_pruned():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 56, n)) for n in (3, 40, 300, 2_000) for _ in range(4)]
    sets = []
    for b in base:
        for share in (0, 0.02, 0.05, 0.1):
            drop = rng.random(len(b)) < share
            sets.append(np.unique(np.concatenate([b[~drop], rng.integers(0, 1 << 56, int(drop.sum()))])))
    bits = np.stack([signature_join.signature(s, 64).view(np.uint64) for s in sets])
    tree = signature_join.Tree(bits, np.array([len(s) for s in sets]), np.arange(len(sets)))
    i, j, most = signature_join.candidates(tree, tree, 90)
    left = dict(zip(zip(i.tolist(), j.tolist()), most.tolist()))
    for a in range(len(sets)):
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if a != b and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                assert left[a, b] >= both
    wide = signature_join.Tree(np.stack([np.frombuffer(signature_join.signature(s).tobytes().ljust(1024, b"\0"), np.uint64) for s in sets[:16]]), np.array([len(s) for s in sets[:16]]), np.arange(16))
    assert len(wide.levels) == 3


def test_sets_that_reach_the_limit_share_a_key():
    rng = np.random.default_rng(4)
    for percent in (60, 80, 90, 95):
        for _ in range(400):
            x = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 120)))
            y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.choice([0, 0.05, 0.1])], rng.integers(0, 1 << 40, rng.integers(0, 12))]))
            both = len(np.intersect1d(x, y))
            if len(y) and both < len(x) + len(y) - both and 100 * both >= percent * (len(x) + len(y) - both):
                assert set(signature_join.block_keys(x, percent).tolist()) & set(signature_join.block_keys(y, percent).tolist())


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1002), (1001, 1002), (5000, 5000)]
    random.Random(3).shuffle(chain)
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_nothing_in_nothing_out(spark):
    assert signature_join.join_components(documents(spark, [])).count() == 0
    got = signature_join.join_components(documents(spark, [(1, None), (2, "one text of five words")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 3, 2)]


def template(n, seed, own=24):
    """Texts from one template with words of their own, too many for any two to be linked."""
    rng, words = random.Random(seed), vocabulary(seed, 5_000)
    shared = [rng.choice(words) for _ in range(180)]
    return [(i, " ".join(shared + [rng.choice(words) for _ in range(own)])) for i in range(n)]


def test_texts_from_a_template_do_not_meet_pairwise(spark, monkeypatch):
    monkeypatch.setattr(signature_join, "LEAF", 8)
    searched, real = [], signature_join._searched
    monkeypatch.setattr(signature_join, "_searched", lambda work, percent: (searched.append(work.count()), real(work, percent))[1])
    for n in (100, 300):
        searched.clear()
        got = signature_join.join_components(documents(spark, template(n, 7), clashes=False)).collect()
        assert len({r.component_id for r in got}) == n
        # a leaf meets itself and a first leaf; with all pairs of leaves it would be some n * n / 16
        assert sum(searched) <= 4 * n


def test_a_template_with_links_among_its_texts(spark, monkeypatch):
    monkeypatch.setattr(signature_join, "LEAF", 4)
    rng, words = random.Random(9), vocabulary(9, 5_000)
    shared = [rng.choice(words) for _ in range(60)]
    texts = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.choice([0, 2, 3, 4, 5, 7, 9, 20]))]
        at = rng.choice([0, 30, 60])
        for _ in range(rng.choice([1, 1, 2])):
            texts.append(" ".join(shared[:at] + own + shared[at:]))
            own = own[:-1]
    texts = list(enumerate(texts))
    for cuts in (0, 1, 2):
        monkeypatch.setattr(signature_join, "CUTS", cuts)
        got = sorted(map(tuple, signature_join.join_components(documents(spark, texts)).collect()))
        assert got == sorted(by_hand(texts))


def test_first_common_tokens_are_among_the_keys():
    rng = np.random.default_rng(6)
    for percent in (60, 80, 90):
        for _ in range(400):
            x = rng.permutation(200)[:rng.integers(1, 120)]
            y = np.concatenate([x[rng.random(len(x)) > rng.choice([0, 0.05, 0.1])], 200 + rng.permutation(50)[:rng.integers(0, 9)]])
            if len(y) > len(x):
                x, y = y, x
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= percent * (len(x) + len(y) - both):
                order = rng.permutation(250)
                a, b = (sorted(s, key=lambda t: order[t]) for s in (x, y))
                common = next(t for t in a if t in set(b))
                assert a.index(common) < signature_join.first_common(len(a), percent)[1]
                assert b.index(common) < signature_join.first_common(len(b), percent)[0]
