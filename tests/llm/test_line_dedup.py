import collections
import hashlib
import random

import duckdb

from tests.llm.data import documents, odd, sentence, vocabulary
from waybridge.llm import line_dedup

UPPER = str.maketrans(line_dedup._UPPER, line_dedup._LOWER)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def kept_lines(texts):
    docs = collections.defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                docs[key(line)].add(i)
    shared = {k: max(v) for k, v in docs.items() if len(v) >= 5}
    return {i: ([x for x in (t or "").split("\n") if shared.get(key(x), i) == i], len((t or "").split("\n"))) for i, t in texts}


def sample():
    rng, words = random.Random(12), vocabulary(12)
    common = [sentence(rng, words, 12) for _ in range(6)] + ["É" * 40, "é" * 40, "x" * 39, "y" * 40]
    forms = [lambda s: s, str.upper, lambda s: "  " + s + "\t\r", lambda s: " " + s]
    texts = []
    for i in range(120):
        lines = [rng.choice(forms)(rng.choice(common)) if rng.random() < 0.4 else sentence(rng, words, rng.randint(1, 12)) for _ in range(rng.randint(1, 12))]
        texts.append((i, "\n".join(lines + [lines[0]] * (i % 3))))
    return texts + [(200 + i, common[0]) for i in range(300)] + odd(rng, words)


def test_same_as_by_hand(spark):
    texts = sample()
    got = line_dedup.digests(documents(spark, texts).repartition(7)).collect()
    want = kept_lines(texts)
    assert len(got) == len(texts) and sum(r.n_dropped for r in got) > 300
    for r in got:
        lines, n = want[r.doc_id]
        assert (r.n_lines, r.n_dropped) == (n, n - len(lines))
        assert r.kept_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_same_as_the_sql(spark):
    import pandas as pd
    texts = [t for t in sample() if t[0] != 905]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(texts, columns=["doc_id", "text"]))
    want = {r[0]: r[1:] for r in con.sql(line_dedup.SQL).fetchall()}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digests(documents(spark, texts)).collect()}
    assert got == want


def test_bitmaps_and_odd_ids(spark):
    line = "this line is long enough to be compared and shared"
    texts = [(i, f"a\n{line}\n{line}\nb\n{line}") for i in range(4)] + [(None, line)]
    got = line_dedup.keep_bitmaps(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.dropped, [tuple(x) for x in r.lost]) for r in got] == [
        (None, 1, [(0, 1)]), *[(i, 3, [(1, 2), (4, 1)]) for i in range(3)]]
    # four documents and a repeated row are four documents
    assert line_dedup.keep_bitmaps(documents(spark, [(i % 4, line) for i in range(8)])).count() == 0
    assert line_dedup.digests(documents(spark, [])).count() == 0
    passed = line_dedup.deduplicated(documents(spark, [(1, None), (2, "x")])).orderBy("doc_id").collect()
    assert [r.text for r in passed] == [None, "x"] and passed[0].h1 == "x"
