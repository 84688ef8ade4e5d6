"""Spelling variants: words that one edit turns into each other, by dense tiles of prefix and suffix lengths.

Words that differ by one inserted, deleted or replaced code point have a common prefix and a common suffix that together
reach the longer length minus one. The edit lies in one of ``PIECES`` stretches of the longer word; what lies before
and after that stretch is the same in both. So a word has a key per stretch, for its own length and for one more, and near
words share a key. The words of a key are cut into blocks, and every pair of blocks is a tile of its own, so a key that
many words share spreads over tasks. A tile is compared densely: words as rows of padded matrices of code points, read from
the left and from the right, give prefix and suffix lengths of all pairs of one block with the other.

Defined cases: a null text has no words. A null doc_id reads as an empty one in the checksum that deletes code points. A
repeated row counts again. A word without near words has itself as root. An empty table gives no rows. Long
texts are read to their end; blocks get smaller as words get longer, so a tile has bounded size. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waybridge.llm.common import batched, stored

LEAST_CHARS, LEAST_COUNT, DELETES, FACTOR = 5, 3, 97, 2
#: Stretches of a word, one of which holds the edit; below ``LEAST_CHARS``.
PIECES = 4
#: Words in a block at most, and code points in a block's matrix.
BLOCK, CELLS = 256, 1 << 16
#: Different words that a task counts before it passes them on.
HELD = 300_000
_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def document_words(doc_id: int | None, text: bytes) -> Counter:
    """Long enough words of a text, each as often as it occurs, with the code points that the checksum deletes gone."""
    out: Counter = Counter()
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUNS.findall(text.translate(_LOWER).decode("utf-8", "replace"))).items():
        if len(run) < LEAST_CHARS:
            continue
        h = zlib.crc32(run.encode(), prefix)
        if h % DELETES == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_CHARS:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words that occur often enough."""
    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if text.is_valid:
                    counts.update(document_words(doc_id, text.as_py()))
                if len(counts) > HELD:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return batched(rows).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= least_count)


def keyed(words: DataFrame) -> DataFrame:
    """(key, longer, word, n): near words share a key, under the length of the longer one."""
    both = words.withColumn("longer", F.explode(F.array(F.length("word"), F.length("word") + 1))).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    before = F.floor(F.col("piece") * F.col("longer") / PIECES).cast("int")
    behind = F.col("longer") - F.floor((F.col("piece") + 1) * F.col("longer") / PIECES).cast("int")
    return both.select(
        F.xxhash64("longer", "piece", F.substring("word", F.lit(1), before), F.substring(
            "word", F.length("word") - behind + 1, behind)).alias("key"), "longer", "word", "n")


def tiles(keys: DataFrame) -> DataFrame:
    """(longer, key, one, two, block, word, n): the words of every pair of blocks that may hold near words."""
    size = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(CELLS) / F.col("longer")))).cast("long")
    # words of the shorter length meet each other under their own length
    shared = keys.groupBy("longer", "key").agg(
        F.count(F.lit(1)).alias("m"), F.count_if(F.length("word") == F.col("longer")).alias("long")).where(
        "m > 1 and long > 0").select("longer", "key", F.ceil(F.col("m") / size).alias("blocks"))
    rows = keys.join(shared, ["longer", "key"]).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "longer", "key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "word", "n")


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words from the left and from the right, padded with zeros, and the words' lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    inside = np.arange(int(lengths.max(initial=0))) < lengths[:, None]
    left, right = np.zeros((2, *inside.shape), np.uint32)
    left[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    right[inside] = np.frombuffer("".join(w[::-1] for w in words).encode("utf-32-le"), np.uint32)
    return left, right, lengths


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the equal beginnings of rows."""
    differ = np.ones((len(a), a.shape[1] + 1), bool)
    np.not_equal(a, b, out=differ[:, :-1])
    return differ.argmax(axis=1)


def near_pairs(words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of different words are one edit apart."""
    left, right, lengths = matrices(words)
    out = np.zeros(len(i), bool)
    for at in np.array_split(np.arange(len(i)), len(i) * left.shape[1] // (1 << 22) + 1):
        a, b = i[at], j[at]
        longer, shorter = np.maximum(lengths[a], lengths[b]), np.minimum(lengths[a], lengths[b])
        prefix = np.minimum(_common(left[a], left[b]), shorter)
        suffix = np.minimum(_common(right[a], right[b]), shorter)
        out[at] = (longer - shorter <= 1) & (prefix + suffix >= longer - 1)
    return out


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all pairs of near words, both ways round."""
    order = ["longer", "key", "one", "two"]
    names = ["word", "n", "other", "other_n"]

    def compared(rows: list[tuple]) -> pa.RecordBatch | None:
        words, counts = [r[1] for r in rows], [r[2] for r in rows]
        i, j, at = [], [], 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            a, b = np.triu_indices(end - at, 1)
            if rows[at][0][2] != rows[at][0][3]:
                # blocks that differ meet each other only; each meets itself in its own tile
                block = np.array([r[3] for r in rows[at:end]])
                cross = block[a] != block[b]
                a, b = a[cross], b[cross]
            i.append(a + at)
            j.append(b + at)
            at = end
        i, j = np.concatenate(i), np.concatenate(j)
        ok = near_pairs(words, i, j)
        a, b = np.concatenate([i[ok], j[ok]]).tolist(), np.concatenate([j[ok], i[ok]]).tolist()
        if not a:
            return None
        return pa.RecordBatch.from_arrays([
            pa.array([words[x] for x in a], pa.string()), pa.array([counts[x] for x in a], pa.int64()),
            pa.array([words[x] for x in b], pa.string()), pa.array([counts[x] for x in b], pa.int64())], names=names)

    def run(batches):
        done, tile, key = [], [], None
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in order])
            for now, word, n, block in zip(keys, *[batch.column(c).to_pylist() for c in ("word", "n", "block")]):
                if now != key:
                    done += tile if len(tile) > 1 else []
                    # whole tiles of words of one length are compared together
                    if done and (len(done) > 4 * BLOCK or now[0] != key[0]):
                        if (out := compared(done)) is not None:
                            yield out
                        done = []
                    tile, key = [], now
                tile.append((now, word, n, block))
        done += tile if len(tile) > 1 else []
        if done and (out := compared(done)) is not None:
            yield out

    rows = tiles(keyed(words))
    return batched(rows.repartition(*order).sortWithinPartitions(*order)).mapInArrow(
        run, "word string, n long, other string, other_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms (word, form) lead to. Each turn doubles the steps of all words."""
    state = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = stored(state.join(further, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        state = moved.select("word", "root")
        if moved.where("went").isEmpty():
            return state


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs often enough."""
    words = stored(vocabulary(docs, least_count))
    # the largest count first, then the smallest word
    best = near(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    joined = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best")).alias("best")).select(
        "word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")))
    last = roots(joined.where("form is not null").select("word", "form"))
    return joined.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
