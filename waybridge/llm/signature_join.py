"""N-gram Jaccard join with signature trees.

Each document is the set of its distinct word shingles. Documents with equal sets are one class. Two sets that reach
the similarity differ in few tokens. In any common order, and among the first tokens twice as many as may differ plus
two, some neighbouring pair is therefore the same in both; classes that share such a pair meet in the block of the
smallest of them. A passage that many documents share seldom leaves neighbours together, since other tokens fall
between; the order also puts tokens that many documents hold last.

A block is searched with signature trees. A class's signature is a bitmap of its tokens; a node of the tree holds the
OR of its children's bitmaps and their range of sizes. Pairs of nodes are followed from the roots down and
dropped as soon as the largest overlap they allow is too small: every bit of one side that the other lacks is
at least one token not shared. What is left is compared token by token on the spot, most promising pairs first.
Only components are asked for, so pairs whose classes are already tied together are dropped as well.

Blocks are cut into leaves of at most ``LEAF`` classes and ``LEAF_TOKENS`` tokens. A leaf meets itself and the first leaf, which
holds the block's leader, so a crowd of near copies is tied together at a cost in proportion to its size. A block of several leaves that still holds
several components is cut anew: its members order their tokens so that those the leader lacks come first, and meet only
if they share a token among the first that such an order allows as first common one (fewer for the smaller of
two sets than for the larger). Texts from one template have their own words there and do not meet; their block falls apart. After
``CUTS`` such turns all leaf pairs that hold different components are searched, so every pair that may link has been seen.

Defined cases: null or empty texts have no shingles, link with nothing and are their own component, named by
their doc_id. A repeated row is a copy. A null doc_id links like any other and never names a component that
holds another. An empty table gives no rows. Other columns are passed through by ``one_per_component`` only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from waybridge.llm.common import attached, batched, discard, mix, per_batch, slotted, stored
from waybridge.llm.components import components

SHINGLE, PERCENT = 3, 90
#: Slots in which documents per token are counted, to order tokens; the order does not change results.
SLOT_BITS = 22
#: Classes in a leaf of a block and their tokens, children of a tree node, and widest signature in bits.
LEAF, LEAF_TOKENS, FANOUT, WIDEST = 256, 1 << 21, 8, 1 << 17
#: Turns in which blocks that still hold several components are cut anew.
CUTS = 1
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def token_sets(column: pa.Array, shingle: int, ranks: np.ndarray | None = None) -> list[np.ndarray]:
    """Sorted distinct tokens of every text: 56 bits of a shingle's hash below its rank."""
    plain = pa.array([b.translate(_LOWER) for b in column.fill_null("").cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
    split = pc.ascii_split_whitespace(plain)
    coded = split.flatten().dictionary_encode()
    at = coded.indices.to_numpy()
    n = len(column)
    owner = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    if len(at):
        real = (pc.binary_length(coded.dictionary).to_numpy() > 0)[at]
        hashed = mix(pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False))[at[real]]
        owner = owner[real]
    else:
        hashed = np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    m = max(len(hashed) - shingle + 1, 0)
    runs = np.full(m, shingle, np.uint64)
    for j in range(shingle):
        runs = mix(runs * np.uint64(3) + hashed[j:j + m])

    def ranked(h: np.ndarray) -> np.ndarray:
        out = h >> np.uint64(8)
        if ranks is not None:
            out = out | (ranks[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56))
        return out.astype(np.int64)

    tokens, out = ranked(runs), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(tokens[a:b - shingle + 1]))
        elif b > a:
            whole = np.full(1, 1000 + b - a, np.uint64)
            for j in range(a, b):
                whole = mix(whole * np.uint64(3) + hashed[j:j + 1])
            out.append(ranked(whole))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def token_ranks(docs: DataFrame, shingle: int) -> np.ndarray:
    """Rank per slot of token hashes: 0, or the logarithm of the documents in a slot that stands out."""
    def count(batches):
        seen, held, size = np.zeros(1 << SLOT_BITS, np.int64), [], 0
        for batch in batches:
            for tokens in token_sets(batch.column("text"), shingle):
                held.append((tokens >> (56 - SLOT_BITS)).astype(np.int32))
                size += len(tokens)
            if size > 1 << SLOT_BITS:
                seen += np.bincount(np.concatenate(held), minlength=len(seen))
                held, size = [], 0
        seen += np.bincount(np.concatenate([*held, np.zeros(0, np.int32)]), minlength=len(seen))
        heavy = np.flatnonzero(seen > 4 + 4 * seen.mean())
        yield pa.RecordBatch.from_arrays([pa.array(heavy), pa.array(seen[heavy])], names=["slot", "n"])

    rows = batched(docs.select("text")).mapInArrow(count, "slot long, n long").groupBy("slot").agg(
        F.sum("n").alias("n")).toArrow()
    ranks = np.zeros(1 << SLOT_BITS, np.uint8)
    ranks[rows["slot"].to_numpy()] = np.minimum(np.log2(np.maximum(rows["n"].to_numpy(), 1)) + 1, 127).astype(np.uint8)
    return ranks


def block_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which two sets that reach the similarity, and are not equal, share one.

    With t the similarity and n tokens, a partner differs in at most d = n (1 - t) / t tokens in all. Of the 2 d + 1
    neighbouring pairs among the first 2 d + 2 tokens of both sets together each differing token spoils two, so
    one is whole in both sets. From 0.8 on a set has that many tokens; below, single tokens of the prefix
    that two sets must share are the keys.
    """
    n = len(tokens)
    if percent < 80:
        return tokens[:n - -(-percent * n // 100) + 1]
    d = n * (100 - percent) // percent
    first = tokens[:2 * d + 2].astype(np.uint64)
    return mix(first[:-1] * np.uint64(3) + first[1:]).astype(np.int64) if d else tokens[:0]


def _arrays(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def first_common(n: int, percent: int) -> tuple[int, int]:
    """How many of n ordered tokens may be the first that two similar sets share: if n is the smaller size, if it is the larger.

    Behind the first common token both sets must have percent / (100 + percent) of the sum of sizes left, itself included.
    """
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def described(docs: DataFrame, shingle: int, percent: int, ranks) -> DataFrame:
    """(row, doc_id, version, n_shingles, d1, d2, keys) of every document, written once."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = token_sets(batch.column("text"), shingle, ranks.value)
        digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("version"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array(digest[:, 0]), pa.array(digest[:, 1]), _arrays([block_keys(s, percent) for s in sets])],
            names=["doc_id", "version", "n_shingles", "d1", "d2", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    return stored(batched(rows).mapInArrow(
        per_batch(run), "doc_id long, version long, n_shingles long, d1 long, d2 long, keys array<long>").withColumn(
        "row", F.monotonically_increasing_id()))


def signature_width(n: int) -> int:
    """About four bits a token, a power of two (at least 64, at most ``WIDEST`` bits)."""
    return min(max(64, 1 << (4 * n - 1).bit_length()), WIDEST)


def signature(tokens: np.ndarray, width: int | None = None) -> np.ndarray:
    """Bitmap of tokens."""
    width = signature_width(len(tokens)) if width is None else width
    bits = np.zeros(width, bool)
    bits[mix(tokens.view(np.uint64)) & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little")


class Tree:
    """Classes ordered so that likely partners are neighbours, and above them levels of nodes.

    A level holds per node: OR of bitmaps, least and largest size, largest number of tokens that share a bit with
    another token of their set, least and largest tie (the component a class is known to be in).
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, ties: np.ndarray):
        excess = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, excess, ties, ties)]
        while len(self.levels[-1][0]) > 1:
            bits, least, most, excess, low, high = self.levels[-1]
            cut = np.arange(0, len(bits), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(bits, cut, axis=0), np.minimum.reduceat(least, cut),
                np.maximum.reduceat(most, cut), np.maximum.reduceat(excess, cut),
                np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether node pairs can hold two sets that reach the similarity and join components, and their largest overlap.

    The shared tokens of two sets lie on bits that both have, one on each, save for those tokens of a set that
    share a bit with another. So the overlap is at most the bits of both ORs plus that excess; the similarity
    needs percent / (100 + percent) of the sum of sizes.
    """
    bits_a, least_a, most_a, excess_a, low_a, high_a = a
    bits_b, least_b, most_b, excess_b, low_b, high_b = b
    ok = (100 * most_a[i] >= percent * least_b[j]) & (100 * most_b[j] >= percent * least_a[i])
    ok &= ~((low_a[i] == high_a[i]) & (low_b[j] == high_b[j]) & (low_a[i] == low_b[j]))
    overlap = np.zeros(len(i), np.int64)
    at = np.flatnonzero(ok)
    for some in np.array_split(at, len(at) * bits_a.shape[1] // (1 << 25) + 1):
        both = np.bitwise_count(bits_a[i[some]] & bits_b[j[some]]).sum(axis=1, dtype=np.int64)
        most = both + np.minimum(excess_a[i[some]], excess_b[j[some]])
        overlap[some] = most
        ok[some] = most * (100 + percent) >= percent * (least_a[i[some]] + least_b[j[some]])
    return ok, overlap


def candidates(one: Tree, two: Tree, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class pairs, and their largest overlap, that the dual traversal of two trees leaves over."""
    at = [len(one.levels) - 1, len(two.levels) - 1]
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        ok, overlap = possible(one.levels[at[0]], i, two.levels[at[1]], j, percent)
        i, j = i[ok], j[ok]
        if at == [0, 0] or not len(i):
            return i, j, overlap[ok]
        if at[0] >= at[1]:
            at[0] -= 1
            i, j = _children(i, j, len(one.levels[at[0]][0]))
        else:
            at[1] -= 1
            j, i = _children(j, i, len(two.levels[at[1]][0]))


def _children(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    child = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    other = np.repeat(j, FANOUT)
    return child[child < n], other[child < n]


def _reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * (100 + percent) >= percent * (len(a) + len(b))


def search(side: np.ndarray, name: np.ndarray, ties: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that tie together all classes of a pair of leaves that the similarity ties, beyond those tied already.

    Side 2 is empty when a leaf meets itself. What is tied together is given as links to one of its members.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    # sets of like size side by side, and among them those that begin alike
    order = np.lexsort((name, [s[0] for s in sets], np.floor(np.log(sizes) / np.log(100 / percent)), side))
    side, name, ties, sizes, sets = side[order], name[order], ties[order], sizes[order], [sets[k] for k in order]
    width = signature_width(int(sizes.max()))
    bits = np.stack([signature(s, width).view(np.uint64) for s in sets])
    trees, places = [], []
    for k in (1, 2):
        at = np.flatnonzero(side == k)
        places.append(at)
        trees.append(Tree(bits[at], sizes[at], ties[at]) if len(at) else None)
    other = 0 if trees[1] is None else 1
    i, j, overlap = candidates(trees[0], trees[other], percent)
    i, j = places[0][i], places[other][j]
    if other == 0:
        i, j, overlap = i[i < j], j[i < j], overlap[i < j]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for k in np.lexsort((name[j], name[i], -overlap / (sizes[i] + sizes[j] + 1))).tolist() if len(i) else ():
        a, b = int(i[k]), int(j[k])
        x, y = find(int(ties[a])), find(int(ties[b]))
        if x != y and _reaches(sets[a], sets[b], percent):
            root[max(x, y)] = min(x, y)
    return [(x, top) for x in root if (top := find(x)) != x]


_PAIR = ["leader", "band1", "leaf1", "band2", "leaf2"]


def _list_slices(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _searched(work: DataFrame, percent: int) -> DataFrame:
    """Links found in every pair of leaves; rows of a pair follow one another inside a partition."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def searched(held: list[tuple]) -> pa.RecordBatch | None:
        side, name, ties = (np.concatenate([h[k] for h in held]) for k in range(3))
        found = search(side, name, ties, [s for h in held for s in h[3]], percent) if len(side) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema) if found else None

    def run(batches):
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in _PAIR], 1)
            columns = [batch.column(c).to_numpy() for c in ("side", "cls", "tie")]
            sets = _list_slices(batch.column("tokens"))
            cuts = [0, *(np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                now = tuple(keys[a].tolist())
                if now != key:
                    if held and (out := searched(held)) is not None:
                        yield out
                    held, key = [], now
                held.append((*[c[a:b] for c in columns], sets[a:b]))
        if held and (out := searched(held)) is not None:
            yield out

    ordered = work.repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    return batched(ordered).mapInArrow(run, "a long, b long")


#: A document by its id and its text; a null id is one as well.
_TEXT = ["own_null", "own_id", "own_version"]


def _by_text(rows: DataFrame, doc_id: str = "doc_id", version=None) -> DataFrame:
    version = F.xxhash64("text") if version is None else version
    return rows.withColumns({
        "own_null": F.col(doc_id).isNull(), "own_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")), "own_version": version})


def _with_tokens(docs: DataFrame, wanted: DataFrame, extra: list[str], shingle: int, ranks) -> DataFrame:
    """``wanted`` (cls, doc_id, version, extra) with the tokens of each class, worked out from its text again.

    Texts are moved once, and only those that are wanted; repeated rows fall together on the same shuffle.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = token_sets(batch.column("text"), shingle, ranks.value)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("cls", *extra)], _arrays(sets)], names=["cls", *extra, "tokens"])

    wanted = _by_text(wanted, version=F.col("version")).select(*_TEXT, "cls", *extra)
    texts = slotted(_by_text(docs.select("doc_id", "text")).select(*_TEXT, "text"), _TEXT, wanted)
    rows = texts.join(wanted, _TEXT).dropDuplicates([*_TEXT, "cls", *extra]).select("cls", *extra, "text")
    return batched(rows).mapInArrow(per_batch(run), ", ".join([*[f"{c} long" for c in ("cls", *extra)], "tokens array<long>"]))


def _blocks(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """(leader, cls, n, doc_id, version) of classes that share a key with another one, from (cls, key, short).

    Keys are counted by their least and largest class, which adds up before the shuffle; two classes of a key are named by these, and
    only keys of more classes are joined back. A key joins classes only if it may be the first common token of one that is
    the smaller set (short).
    """
    shared = stored(keys.groupBy("key").agg(
        F.min("cls").alias("leader"), F.max("cls").alias("last"), F.count(F.lit(1)).alias("m"), F.max("short").alias("short")).where(
        "leader < last and short").select("key", "leader", "last", "m"))
    large = shared.where("m > 2").select("key", "leader")
    many = slotted(keys.select("cls", "key"), ["key"], large).join(large, "key").select("leader", "cls")
    two = shared.where("m = 2").select("leader", F.explode(F.array("leader", "last")).alias("cls"))
    out = stored(many.unionByName(two).distinct().join(heads, "cls"))
    discard(shared)
    return out


def _room() -> Column:
    """Classes that a leaf of the largest of them may hold."""
    return F.greatest(F.lit(4), F.least(F.lit(LEAF), F.floor(F.lit(LEAF_TOKENS) / F.max("n"))))


def _large(blocks: DataFrame) -> DataFrame:
    """Members of the blocks that do not fit into one leaf."""
    counted = blocks.groupBy("leader").agg((F.count(F.lit(1)) > _room()).alias("large")).where("large").select("leader")
    return stored(blocks.join(counted, "leader", "left_semi"))


def _leaves(blocks: DataFrame, percent: int) -> DataFrame:
    """``blocks`` with band and leaf: leaves of bounded size, whose members are of like size; a leader is in the first.

    Partners differ in size by the similarity at most, so they are in one band or in two neighbours.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("long")
    banded = blocks.withColumn("band", band)
    counted = banded.groupBy("leader", "band").agg(F.ceil(F.count(F.lit(1)) / _room()).alias("leaves")).where("leaves > 1")
    leaf = F.when(F.col("cls") == F.col("leader"), 0).otherwise(F.pmod(F.xxhash64("cls"), F.coalesce("leaves", F.lit(1))))
    return banded.join(counted, ["leader", "band"], "left").withColumn("leaf", leaf.cast("long")).drop("leaves")


def _tied(rows: DataFrame, tied: DataFrame) -> DataFrame:
    return rows.join(tied, F.col("cls") == F.col("node"), "left").withColumn("tie", F.coalesce("component", "cls")).drop("node", "component")


def _leaf_pairs(leafed: DataFrame, every: bool) -> DataFrame:
    """Pairs of leaves of a block, in one band or in neighbours, that hold different components: each with itself and with first ones, or all."""
    leaves = leafed.groupBy("leader", "band", "leaf").agg(F.min("tie").alias("low"), F.max("tie").alias("high"))
    one, two = (leaves.select("leader", *[F.col(c).alias(f"{c}{k}") for c in ("band", "leaf", "low", "high")]) for k in (1, 2))
    # the neighbouring band is reached by an equality too
    two = two.withColumn("from", F.explode(F.array(F.col("band2"), F.col("band2") - 1))).withColumnRenamed("leader", "_leader")
    pairs = one.join(two, (F.col("leader") == F.col("_leader")) & (F.col("band1") == F.col("from"))).where(
        "band1 < band2 or leaf1 <= leaf2").where("least(low1, low2) < greatest(high1, high2)")
    return pairs.where("true" if every else "leaf1 = 0 or leaf2 = 0 or (band1 = band2 and leaf1 = leaf2)").select(*_PAIR)


def _paired(leafed: DataFrame, every: bool) -> DataFrame:
    """Members of every pair of leaves that is to be searched."""
    pairs = stored(_leaf_pairs(leafed, every))
    work = None
    for k in (1, 2):
        mine = pairs if k == 1 else pairs.where("band1 <> band2 or leaf1 <> leaf2")
        part = mine.withColumns({"band": F.col(f"band{k}"), "leaf": F.col(f"leaf{k}")}).join(
            leafed, ["leader", "band", "leaf"]).select(*_PAIR, F.lit(k).cast("long").alias("side"), "cls", "tie", "doc_id", "version")
        work = part if work is None else work.unionByName(part)
    return work


def _merged(tied: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links; only the components that they touch are worked out anew."""
    if tied is None:
        return stored(components(links))
    of = lambda side: F.coalesce(F.col(f"{side}_component"), F.col(side)).alias(side)
    mapped = links
    for side in ("a", "b"):
        mapped = mapped.join(tied.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component")), side, "left")
    joined = components(mapped.select(of("a"), of("b")))
    before = tied.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select(
        "node", F.coalesce("now", "component").alias("component"))
    return stored(before.unionByName(joined.join(tied.select("node"), "node", "left_anti")))


def _cut(docs: DataFrame, blocks: DataFrame, heads: DataFrame, shingle: int, percent: int, ranks) -> DataFrame:
    """Blocks in place of ``blocks``: members meet if they share a token that may be their first common one
    in an order which puts the tokens of the block's leader last."""
    members = stored(_with_tokens(docs, blocks, ["leader"], shingle, ranks))
    # a leader is a member of its block
    rows = members.join(members.where("cls = leader").select("leader", F.col("tokens").alias("last")), "leader")

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, leaders = batch.column("cls").to_numpy(), batch.column("leader").to_numpy()
        cls, key, short = [], [], []
        for k, (tokens, last) in enumerate(zip(_list_slices(batch.column("tokens")), _list_slices(batch.column("last")))):
            shared = np.isin(tokens, last, assume_unique=True)
            smaller, larger = first_common(len(tokens), percent)
            first = np.concatenate([tokens[~shared], tokens[shared]])[:larger]
            key.append(mix(mix(first.view(np.uint64)) ^ mix(leaders[k:k + 1].view(np.uint64))).view(np.int64))
            cls.append(np.full(len(first), names[k]))
            short.append(np.arange(len(first)) < smaller)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (cls, key, short)], names=["cls", "key", "short"])

    found = stored(batched(rows).mapInArrow(per_batch(keys), "cls long, key long, short boolean"))
    discard(members)
    out = _blocks(found, heads)
    discard(found)
    return out


def linked_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents (row, doc_id, version, n_shingles, d1, d2), their classes (cls, d1, d2, n_shingles, n, doc_id, version, best)
    and components (node, component) of linked classes."""
    ranks = docs.sparkSession.sparkContext.broadcast(token_ranks(docs, shingle))
    keyed = described(docs, shingle, percent, ranks)
    named = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"), F.col("version").alias("version"))
    # equal sets have equal keys; these are large, so each table that holds them goes as soon as it is read
    with_keys = stored(keyed.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(
        F.min("row").alias("cls"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("doc_id", "version"), "row").alias("f"),
        F.min(named).alias("best"), F.first("keys").alias("keys")).select("cls", "d1", "d2", "n_shingles", "n", "f.*", "best", "keys"))
    rows, classes = stored(keyed.drop("keys")), stored(with_keys.drop("keys"))
    discard(keyed)
    heads = classes.select("cls", F.col("n_shingles").alias("n"), "doc_id", "version")
    blocks = _blocks(with_keys.select("cls", F.explode("keys").alias("key"), F.lit(True).alias("short")), heads)
    discard(with_keys)
    searched = lambda work: stored(_searched(_with_tokens(docs, work, [*_PAIR, "side", "tie"], shingle, ranks), percent))
    alone = lambda rows: rows.select("leader", *[F.lit(0).cast("long").alias(c) for c in _PAIR[1:]], F.lit(1).cast("long").alias("side"),
                                     "cls", "tie", "doc_id", "version")
    tied = None
    for turn in range(CUTS + 1):
        large = _large(blocks)
        known = lambda rows: rows.withColumn("tie", F.col("cls")) if tied is None else _tied(rows, tied)
        # blocks of one leaf are searched whole
        work = alone(known(blocks).join(large.select("leader").distinct(), "leader", "left_anti"))
        several = not large.isEmpty()
        if several:
            large = stored(known(_leaves(large, percent)))
            work = work.unionByName(_paired(large, every=turn == CUTS))
        work = stored(work)
        links = searched(work)
        discard(work)
        tied = _merged(tied, links)
        if not several or turn == CUTS:
            break
        now = _tied(large.drop("tie"), tied)
        left = now.groupBy("leader").agg(F.min("tie").alias("low"), F.max("tie").alias("high")).where("low < high").select("leader")
        left = stored(now.join(left, "leader", "left_semi").select("leader", "cls", "doc_id", "version"))
        if left.isEmpty():
            break
        blocks = _cut(docs, left, heads, shingle, percent, ranks)
    return rows, classes, tied


def _grouped(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All documents, and their classes (d1, d2, n_shingles, n, best) with the least document of their component."""
    keyed, classes, tied = linked_classes(docs, shingle, percent)
    grouped = stored(classes.join(tied, F.col("cls") == F.col("node"), "left").select(
        "d1", "d2", "n_shingles", F.col("n").alias("copies"), "best", F.coalesce("component", "cls").alias("group")))
    least = stored(grouped.groupBy("group").agg(F.min("best").alias("least"), F.count(F.lit(1)).alias("n")))
    return keyed, stored(attached(grouped.drop("best"), least, ["group"]).select(
        "d1", "d2", "n_shingles", F.col("copies").alias("n"), "least", "group"))


def join_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Size of every document's set, and the smallest doc_id that links lead to."""
    keyed, groups = _grouped(docs, shingle, percent)
    same = ["d1", "d2", "n_shingles"]
    rows = keyed.select("doc_id", *same)
    named = attached(rows.where("n_shingles > 0"), groups.select(*same, "n", F.col("least.doc_id").alias("component_id")), same)
    return named.select("doc_id", "n_shingles", "component_id").unionByName(
        rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_per_component(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs``, columns unchanged: the smallest doc_id of every component, and all texts without shingles."""
    _, groups = _grouped(docs, shingle, percent)
    keep = _by_text(groups.groupBy("group").agg(F.first("least").alias("s")).select("s.doc_id", "s.version"), version=F.col("version")).select(*_TEXT)
    blank = F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))) == 0
    whole = _by_text(docs.select(F.struct("*").alias("doc"), "doc_id", "text")).drop("doc_id")
    # repeated rows cannot be told apart by id and text; one of them stays
    kept = whole.where(~blank).join(keep, _TEXT).dropDuplicates(_TEXT).select("doc")
    # texts without shingles are no copies of each other and all stay
    return kept.unionByName(whole.where(blank).select("doc")).select("doc.*")
