import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import documents, odd, vocabulary
from waybridge.llm import spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(texts):
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, many = {}, {}
    for w in words:
        close = [x for x in words if near(w, x)]
        many[w] = len(close)
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, many[w], words[form[w]] if form[w] else None) for w, n in words.items())


def sample(seed, docs=150):
    rng = random.Random(seed)
    words = [w for w in vocabulary(seed, 60, "abcdeé") if len(w) > 3] + ["Straße", "×÷×÷×", "aaaaa", "aaaaaa", "aaaaaaa", "ÀÉÎÕÜ", "x" * 300]
    texts = []
    for i in range(docs):
        out = []
        for _ in range(rng.randint(1, 60)):
            w = words[min(int(rng.expovariate(0.1)), len(words) - 1)]
            while rng.random() < 0.35 and len(w) > 2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1:]])
            out.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        texts.append((i, " ,7_"[rng.randrange(4)].join(out)))
    return texts


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_same_as_by_hand(spark):
    texts = sample(3) + odd(random.Random(1), vocabulary(3)) + [(None, "without an id"), (None, "without an id")] + [(5, "repeated rows")] * 3
    # a word that is near another one which is near a third
    texts += [(700 + i, "chains " * 3 + "chainss " * 7 + "xchainss " * 15) for i in range(3)]
    want = by_hand(texts)
    assert got(spelling.variants(documents(spark, texts).repartition(5))) == want
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] and w[2] != w[1] for w in want)


@pytest.mark.parametrize("block", [2, 5])
def test_a_key_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "HELD", 20)
    texts = [(i, " ".join(f"abc{x}{y}fgh abc{x}fgh" for x in "qrstuvw" for y in "qrstuvw")) for i in range(4)]
    assert got(spelling.variants(documents(spark, texts))) == by_hand(texts)


def test_near_words_share_a_key_and_are_seen(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(300)} | {"abcde" * 30, "abcde" * 29 + "abce"})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    found = {(r.word, r.other) for r in spelling.near(table).collect()}
    assert found == {(a, b) for a in words for b in words if near(a, b)}
    i, j = map(np.ravel, np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    i, j = i[i != j], j[i != j]
    assert spelling.near_pairs(words, i, j).tolist() == [near(words[a], words[b]) for a, b in zip(i, j)]


def test_long_chains_of_forms(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(70)]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()))
    assert got == {w: "w070" for w, _ in forms}


def test_nothing_in_nothing_out(spark):
    assert spelling.variants(documents(spark, [])).count() == 0
    assert spelling.variants(documents(spark, [(1, None), (2, "twice words, twice words")])).count() == 0
    texts = [(1, "alone alone alone")]
    assert got(spelling.variants(documents(spark, texts))) == by_hand(texts) == [("alone", None, "alone", 3, 0, None)]
