"""Packing along a space-filling curve.

Documents become token ids; the hashed bag of ids of a document is projected to three dimensions, and
the place of that point on a Hilbert curve is the sort key. A range sort by the key puts similar
documents side by side; each task then lays its stretch of the curve end to end and cuts it every
``length`` tokens, so a sequence holds neighbours and has no padding. The rest at the end of a stretch is
cut into pieces whose lengths are powers of two.

Defined cases: a null or empty text is a document of the end id alone. Equal points are ordered by doc_id,
then ids, so a crowd of copies is spread over many tasks. A repeated row is packed as often as it occurs;
a null doc_id is carried as null. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from waybridge.llm.common import batched, objects, per_batch, record_batch, stored

SEQUENCE = 2048
END_ID = 1
DIMENSIONS, BITS, BUCKETS = 3, 16, 256
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 400_000
#: Signs that the tokenizer keeps apart from a preceding letter or digit.
_SIGNS = ".,;:!?%&$#*+=/|-_()[]{}\""

TOKENIZED = pa.schema([("doc_id", pa.int64()), ("curve", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def curve_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows of ``points``), worked out for all rows at once.

    Bits are turned from coordinates into the transposed index, highest bit first.
    """
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        low = q - 1
        for d in range(n):
            turned = (x[d] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> b) & 1, flip ^ ((1 << b) - 1), flip)
    x = [v ^ flip for v in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> b) & 1)
    return key


def _projection(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each id, and an orthonormal map from buckets to dimensions. Fixed by the seed."""
    rng = np.random.default_rng(20240)
    buckets = rng.integers(0, BUCKETS, vocabulary)
    axes, _ = np.linalg.qr(rng.standard_normal((BUCKETS, DIMENSIONS)))
    return buckets, axes


def curve_of(bags: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Curve key of hashed bags of ids, one per row."""
    unit = np.sqrt(bags / np.maximum(bags.sum(axis=1, keepdims=True), 1))
    cells = np.clip((unit @ axes + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return curve_key(cells.astype(np.int64))


class Encoder:
    """Ids of texts, through the ids of their words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words one
    after another. Only space and line feed are taken for white space here; what lies between two of them
    goes to the tokenizer whole, once per distinct word of a batch. Letters and the signs that follow them
    are looked up apart, letters in lower case, as the tokenizer takes them. Found ids are remembered in two
    generations of ``CACHE_WORDS``: when the younger is full it becomes the older.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.closing = np.zeros(self.size, bool)
        self.closing[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ask(self, words: list[str]) -> None:
        """Ids of words from the tokenizer. Plain words go as one text, told apart by their closing tokens."""
        plain = [w for w in words if w.isalpha() and w == w.lower() and unicodedata.is_normalized("NFC", w)]
        rest = set(words).difference(plain)
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids,
                           dtype=self.kind)
            ends = (np.flatnonzero(self.closing[ids]) + 1) * self.kind.itemsize
            if len(ends) == len(plain):
                data, at = ids.tobytes(), 0
                for w, end in zip(plain, ends.tolist()):
                    self.known[w], at = data[at:end], end
            else:
                rest.update(plain)
        rest = list(rest)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else []):
            self.known[w] = np.array(e.ids, dtype=self.kind).tobytes()

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set(words).difference(known)
        again = new.intersection(older)
        known.update((w, older[w]) for w in again)
        if new := list(new - again):
            self._ask(new)
        return list(map(known.__getitem__, words))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts in one array, and where each text's ids begin in it."""
        split = pc.split_pattern(pc.replace_substring(column.fill_null(""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        word, at = coded.dictionary, coded.indices.to_numpy()
        letters = pc.utf8_rtrim(word, characters=_SIGNS)
        plain = pc.and_(pc.utf8_is_alpha(letters), pc.invert(pc.match_substring(word, "İ")))
        front = pc.if_else(plain, pc.utf8_lower(letters), word).dictionary_encode()
        back = pa.array([w[len(x):] if p else "" for w, x, p in zip(
            objects(word), objects(letters), objects(plain))], pa.string()).dictionary_encode()
        parts = objects(front.dictionary) + objects(back.dictionary)
        ids = self._ids(parts)
        flat = np.frombuffer(b"".join(ids), self.kind)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        starts = np.cumsum(lengths) - lengths
        pair = np.stack([front.indices.to_numpy(), back.indices.to_numpy() + len(front.dictionary)], 1)
        segments = pair[at].ravel()
        size = lengths[segments]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        pick = np.arange(total) + np.repeat(starts[segments] - (end - size), size)
        offsets = split.offsets.to_numpy()
        return flat[pick], np.concatenate([[0], end])[2 * (offsets - offsets[0])]


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    encoder = Encoder(path)
    return encoder, *_projection(encoder.size)


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, curve key and the ids (little-endian, end id last) of every document."""
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, buckets, axes = _encoder(tokenizer_path)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        flat, at = encoder.encode(batch.column("text"))
        spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
        ids = [flat[a:b].tobytes() + end for a, b in spans]
        bags = np.stack([np.bincount(buckets[flat[a:b]], minlength=BUCKETS) for a, b in spans])
        return record_batch(TOKENIZED, {
            "doc_id": batch.column("doc_id"), "curve": curve_of(bags.astype(np.float64), axes), "ids": ids})

    return batched(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")).mapInArrow(
        per_batch(encode), "doc_id long, curve long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, end_id: int = END_ID,
         keep_ids: bool = True) -> DataFrame:
    """Pieces of documents with their place in a sequence, in curve order.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit values; without ``keep_ids`` it is null
    and only the checksum travels on. ``sequence_id`` counts up inside a task, above the task's number.
    """
    rows = stored(tokenized(docs, tokenizer_path, end_id))
    ranged = rows.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids")

    def lay(batches):
        kind = _encoder(tokenizer_path)[0].kind
        task = TaskContext.get().partitionId() << 40
        sequence, fill, pending, out = 0, 0, [], []

        def emit(pieces: list[tuple], number: int) -> None:
            offset = 0
            for doc_id, start, ids, total in pieces:
                data = ids.astype("<u4").tobytes()
                out.append((doc_id, start, len(ids), zlib.crc32(data), total, task + number, offset,
                            data if keep_ids else None))
                offset += len(ids)

        def flush():
            columns = list(zip(*out)) if out else [[]] * len(PIECES)
            return record_batch(PIECES, dict(zip(PIECES.names, columns)))

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids, start = np.frombuffer(data, kind), 0
                while start < len(ids):
                    take = min(length - fill, len(ids) - start)
                    pending.append((doc_id, start, ids[start:start + take], len(ids)))
                    start, fill = start + take, fill + take
                    if fill == length:
                        emit(pending, sequence)
                        sequence, fill, pending = sequence + 1, 0, []
                        if len(out) >= 5_000:
                            yield flush()
                            out.clear()
        # the rest: one sequence per power of two in its length
        for bit in range(fill.bit_length() - 1, -1, -1):
            room, part = fill & (1 << bit), []
            while room:
                doc_id, start, ids, total = pending.pop(0)
                if len(ids) > room:
                    pending.insert(0, (doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                part.append((doc_id, start, ids, total))
                room -= len(ids)
            if part:
                emit(part, sequence)
                sequence += 1
        if out:
            yield flush()

    return batched(ranged.select("doc_id", "ids")).mapInArrow(
        lay, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
             "offset long, ids binary")
