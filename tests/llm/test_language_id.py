import collections
import math
import random
import zlib

import pyarrow as pa

from tests.llm.data import CLASHES, DOCS, vocabulary
from pyspark.sql import functions as F
from waybridge.llm import language_id

ALPHABETS = {"aa": "aeioubcdlmnrst", "bb": "aouhgkzwäößt", "cc": "абвгдежзик"}


def corpus(spark, n=150, extra=()):
    rng = random.Random(11)
    words = {k: vocabulary(k, 300, a) for k, a in ALPHABETS.items()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 40))) + ".", lang, "s", 0)
            for i in range(n) for lang in [rng.choice(sorted(words))]]
    df = spark.createDataFrame(rows + list(extra), DOCS)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    return df, rows


def test_held_out_texts_are_recognised(spark):
    extra = [(900, None, "aa", "s", 0), (901, "", "bb", "s", 0), (902, "123 -- !", "cc", "s", 0), (903, "漢字", None, "s", 0), (904, "x " * 100_000, None, "s", 0), (None, "aeiou", None, "s", 0)]
    df, rows = corpus(spark, extra=extra)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    for i, text, lang, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        assert got[i].lang_pred == lang
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred in ALPHABETS and got[903].rejected and not got[0].rejected
    # without anything to learn from
    silent = language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in silent} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


def by_hand(words, order=4):
    """Interpolated Kneser-Ney over a multiset of words, written as the textbook has it."""
    grams = collections.Counter()
    for w in words:
        s = " " * (order - 1) + w + " "
        for i in range(order - 1, len(s)):
            grams[s[i - order + 1:i + 1]] += 1
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])
    discount = {}
    for n, c in levels.items():
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        discount[n] = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / 4096
        some = [v for g, v in levels[n].items() if g[:-1] == gram[:-1]]
        if not some:
            return p(gram[1:])
        return max(levels[n][gram] - discount[n], 0) / sum(some) + discount[n] * len(some) / sum(some) * p(gram[1:])

    return p


def test_probabilities_equal_the_textbook_and_sum_to_one(spark):
    df, rows = corpus(spark, 60)
    models = language_id.learn(df, 4, 2)
    # what is kept for calibration is not counted
    apart = {r.doc_id for r in df.where(language_id.kept_apart(F.col("doc_id"))).collect()}
    assert apart
    rows = [r for r in rows if r[0] not in apart]
    text = rows[0][1]
    for at, lang in enumerate(models.langs):
        words = [w.rstrip(".").lower() for i, t, la, _, _ in rows if la == lang and zlib.crc32(str(i).encode()) % 4 != 2 for w in t.split()]
        p = by_hand(words)
        entropy, chars = models.entropies(pa.array([text]))
        want, n = 0.0, 0
        for w in (w.rstrip(".").lower() for w in text.split()):
            s = "   " + w + " "
            want -= sum(math.log(p(s[i - 3:i + 1])) for i in range(3, len(s)))
            n += len(w) + 1
        assert chars[0] == n and abs(entropy[0, at] - want / n) < 1e-9
    letters = set("".join(ALPHABETS.values())) | {" "}
    assert abs(sum(p("  a"[:3] + c) for c in letters) + (4096 - len(letters)) * 0 - 1) < 0.05


def test_every_learning_row_is_counted_and_calibrated_on(spark):
    df, rows = corpus(spark, 150)
    # repeated rows are learned from, and calibrated on, again
    df = df.unionByName(df.where("doc_id % 3 = 0"))
    times = {r[0]: 1 + (r[0] % 3 == 0) for r in rows}
    learning = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    models, trial = language_id.learn_whole(df, 4, 2), language_id.learn(df, 4, 2)
    words = lambda t: [w.rstrip(".").lower() for w in t.split()]
    text = rows[0][1]
    for at, lang in enumerate(models.langs):
        p = by_hand([w for i, t, la, _, _ in learning if la == lang for w in words(t) * times[i]])
        grams = [s[i - 3:i + 1] for s in ("   " + w + " " for w in words(text)) for i in range(3, len(s))]
        entropy, chars = models.entropies(pa.array([text]))
        assert abs(entropy[0, at] + sum(math.log(p(g)) for g in grams) / chars[0]) < 1e-9
    apart = {r.doc_id for r in df.where(language_id.kept_apart(F.col("doc_id"))).collect()}
    for at, lang in enumerate(trial.langs):
        texts = [t for i, t, la, _, _ in learning if la == lang and i in apart for _ in range(times[i])]
        assert texts or math.isinf(models.limits[at])
        if texts:
            own = trial.entropies(pa.array(texts))[0][:, at]
            assert abs(models.limits[at] - (own.mean() + 4 * max(own.std(), 0.05))) < 1e-9
    assert models.sharpness == trial.sharpness and max(times[i] for i in apart & {r[0] for r in learning}) == 2
