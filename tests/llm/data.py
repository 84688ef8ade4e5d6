"""Small tables for the tests of the corpus operators."""

import functools
import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as columns of the input they must not matter.
CLASHES = ["row", "h1", "version", "pos", "curve", "ids", "score", "lines", "marks", "target", "digest", "cls", "host", "component", "y", "_doc", "_version"]


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


@functools.cache
def _vocabulary(seed, n, letters):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)]


def vocabulary(seed, n=400, letters="abcdefghijklmnopqrstuvwxyz"):
    """A new list each time, made up once: one test asks for it for each of 20,000 words."""
    return list(_vocabulary(seed, n, letters))


def documents(spark, texts, clashes=True):
    """Texts, or (doc_id, text) pairs, as a table of documents with extra columns."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOCS)
    if clashes:
        for name in CLASHES:
            df = df.withColumn(name, F.lit("x"))
    return df


def odd(rng, words):
    """Null, empty, blank, tiny, very long and repeated texts."""
    long = "\n".join(sentence(rng, words, 12) for _ in range(3_000))
    return [(900, None), (901, ""), (902, " \n\t \n"), (903, "a"), (904, long), (905, "Twice the same."), (905, "Twice the same."), (906, "ÀÉ漢字 ß\x00x")]


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
