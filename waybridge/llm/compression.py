"""Quality rules with compression bands.

Plain counts of words, symbols and repeats make the base rule. On top of it the text is compressed with
Zstandard, whole and in fixed chunks, the last partial one included. Each length has its band: a ratio below it
means repetition, one above it means noise that language does not produce. Short texts compress badly whatever
they say, so their upper limit is wide, and the band closes in as the text grows. The upper limits are a little
above the highest ratios measured on clean texts, Latin and other ones apart. Noise of few different characters
has a low ratio, so a second limit, for every script, holds the ratio against that of coding each byte by its
frequency alone: language does better, and noise does not.

Defined cases: a null or empty text has no words and fails the base rule. Texts under the first limit's
length are not judged by compression. Rows are judged alone, so repeated rows repeat their result. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from waybridge.llm.common import batched, mix, per_batch, record_batch

#: Whole texts: bytes from, lowest ratio of compressed to plain size, highest one of Latin and of other texts, and highest
#: quotient of the ratio and the bytes' entropy. Below 2000 bytes the quotient of language reaches that of noise.
WHOLE_BANDS = (
    (200, 0.25, 0.99, 1.10, 9.0), (400, 0.25, 0.86, 1.05, 9.0), (600, 0.25, 0.79, 0.98, 9.0), (1_000, 0.20, 0.72, 0.92, 9.0),
    (2_000, 0.20, 0.64, 0.81, 1.045), (4_000, 0.16, 0.58, 0.71, 1.00), (8_000, 0.16, 0.54, 0.645, 0.955),
    (16_000, 0.10, 0.50, 0.60, 0.925))
#: A text of another script than Latin has this share of bytes beyond ASCII.
OTHER_SHARE = 0.3
#: Chunks of this many bytes, their lowest ratio, what their highest one may be above that of a whole text of their length,
#: the share of chunks below their band that rejects a text, and the share of its bytes in chunks above it that does.
CHUNK, CHUNK_LOW, CHUNK_MORE, LOW_SHARE, HIGH_SHARE = 4_096, 0.12, 0.04, 0.5, 0.2
LEVEL = 3
WINDOW = 5
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
    ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.int64())])


def repeat_words(codes: np.ndarray, owner: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Words of each of ``n`` texts that lie in a window of words found twice or more in that text.

    ``codes`` number the words of all texts, ``owner`` names the text of each.
    """
    out = np.zeros(n, np.int64)
    m = len(codes) - window + 1
    if m <= 1:
        return out
    key = mix(owner[:m].astype(np.uint64) + np.uint64(1 << 40))
    for j in range(window):
        key = mix(key ^ mix(codes[j:j + m].astype(np.uint64) + np.uint64(j + 1 << 34)))
    inside = owner[:m] == owner[window - 1:]
    ranked = np.sort(key[inside])
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        starts = np.flatnonzero((twice[at] == key) & inside)
        covered = np.zeros(len(codes), bool)
        for j in range(window):
            covered[starts + j] = True
        out += np.bincount(owner[covered], minlength=n)
    return out


def measured(data: bytes, compressor: zstandard.ZstdCompressor, more: float = 0.0) -> tuple[float, float, bool]:
    """Ratio of a text, the lowest ratio of its length, and whether it is above its band."""
    size = len(data)
    _, low, latin, other, quotient = next(band for band in reversed(WHOLE_BANDS) if size >= band[0])
    ratio = len(compressor.compress(data)) / size
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    high = other if counts[128:].sum() > OTHER_SHARE * size else latin
    share = counts[counts > 0] / size
    entropy = float(-(share * np.log2(share)).sum()) / 8
    return ratio, low, ratio > high + more or ratio > quotient * entropy > 0


def bands(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, bool]:
    """Ratio of the whole text, chunks outside their band, and whether the text passes."""
    size = len(data)
    least = WHOLE_BANDS[0][0]
    if size < least:
        return 1.0, 0, True
    ratio, low, noisy = measured(data, compressor)
    chunks = flat = loud = loud_bytes = 0
    for at in range(0, size if size >= CHUNK else 0, CHUNK):
        part = data[at:at + CHUNK]
        if len(part) < least:
            break
        chunks += 1
        r, _, above = measured(part, compressor, CHUNK_MORE)
        flat += r < CHUNK_LOW
        loud += above
        loud_bytes += above * len(part)
    good = not noisy and ratio >= low and flat <= LOW_SHARE * chunks and loud_bytes <= HIGH_SHARE * size
    return ratio, flat + loud, good


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base rule and verdict of every text; the verdict of the bands is in ``kept`` with the base rule."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text").fill_null("")
        data = column.cast(pa.binary()).to_pylist()
        n = len(data)
        split = pc.ascii_split_whitespace(column)
        flat = split.flatten()
        owner = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        # white space at either end of a text leaves an empty part
        real = pc.binary_length(coded.dictionary).to_numpy()[codes] > 0 if len(codes) else np.zeros(0, bool)
        codes, owner = codes[real], owner[real]
        n_words = np.bincount(owner, minlength=n)
        repeated = repeat_words(codes, owner, n)
        chars = pc.utf8_length(column).to_numpy()
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        word_chars, symbols, lines, ratios, bad_chunks, passed = [], [], [], [], [], []
        for k, b in enumerate(data):
            word_chars.append(int(chars[k]) - len(b) + len(b.translate(None, _SPACE)))
            symbols.append(len(b) - len(b.translate(None, _SYMBOLS)))
            said = [x for x in b.split(b"\n") if x.strip()]
            lines.append(len(said) - len(set(said)))
            ratio, bad, good = bands(b, compressor)
            ratios.append(ratio)
            bad_chunks.append(bad)
            passed.append(good)
        failed = (n_words < 10) | (100 * repeated > 20 * n_words)
        return record_batch(SCHEMA, {
            "doc_id": batch.column("doc_id"), "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols,
            "n_dup_lines": lines, "n_repeat_words": repeated, "base_failed": failed,
            "kept": ~failed & np.array(passed, bool), "ratio": ratios, "bad_chunks": bad_chunks})

    return batched(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")).mapInArrow(
        per_batch(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                        "n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long")
