"""Language identification with interpolated Kneser-Ney character models.

Per language a character model of order four over lower-case words, with a space before and behind each word.
Counts of four-grams are gathered over all learning rows; the lower orders are worked out from them as numbers of
distinct left neighbours. Discounted parts and back-off weights are stored per language and order in sorted
arrays of hashed grams. A text's language is the one with the lowest cross-entropy per character. The
entropies that one learning row in eight, all such rows, reach under models of the other seven set the sharpness of the score and the
limit above which a text is marked as rejected; then these rows are counted with the others.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when nothing was
learned. Ties go to the language that sorts first. A repeated row is judged, and learned from, again. An empty
table gives no rows. Only doc_id, text and lang are read; lang and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from waybridge.llm.common import batched, discard, objects, per_batch, record_batch, stored
from waybridge.llm.nb_svm import fold

ORDER = 4
#: A character is kept in so many bits: those below are themselves, the others share the values by remainder.
CHAR_BITS = 12
#: Grams are stored by their remainder of this prime, which bounds each array. It lies far from any power of two,
#: since grams are packed by powers of two.
SLOTS = 15_485_863
#: One learning row in so many is kept for the rejection limits and the sharpness of the score, and counted after that.
CALIBRATION_PART = 8
#: Sharpnesses of the score that are tried.
SHARPNESS = (0.01, 0.03, 0.1, 0.3, 1.0)
#: A text is rejected beyond this many standard deviations of its language's usual entropy.
REJECT_DEVIATIONS = 4.0
#: Four-grams whose values a Python worker remembers.
CACHE_GRAMS = 1_000_000
_MASK = (1 << CHAR_BITS) - 1


def _unique_words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct runs of letters in lower case, and (row, word) of every occurrence."""
    split = pc.utf8_split_whitespace(column.fill_null(""))
    coded = split.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(column)), np.diff(split.offsets.to_numpy()))
    at = coded.indices.to_numpy()
    letters = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}]+", " ")
    parts = pc.split_pattern(pc.utf8_trim_whitespace(letters), " ")
    words = parts.flatten().dictionary_encode()
    first = parts.offsets.to_numpy()
    count = np.diff(first)
    # every occurrence of a token stands for the words it holds
    times = count[at] if len(at) else np.zeros(0, np.int64)
    pick = np.arange(times.sum()) + np.repeat(first[:-1][at] - (np.cumsum(times) - times), times) if len(at) else at
    word = words.indices.to_numpy()[pick] if len(at) else at
    owner = np.repeat(owner, times) if len(at) else owner
    real = pc.binary_length(words.dictionary).to_numpy()[word] > 0 if len(word) else np.zeros(0, bool)
    return objects(words.dictionary), owner[real], word[real]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed four-gram ending at every character of every word and at the space behind it, and its word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pad = " " * (ORDER - 1)
    codes = np.frombuffer("".join([pad + w + " " for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = np.where(codes <= _MASK, codes, codes % (_MASK - 1024) + 1024)
    starts = np.cumsum(lengths + ORDER) - (lengths + ORDER)
    ends = np.repeat(starts + ORDER - 1, lengths + 1) + (
        np.arange((lengths + 1).sum()) - np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths + 1))
    key = np.zeros(len(ends), np.int64)
    for j in range(ORDER - 1, -1, -1):
        key = (key << CHAR_BITS) | codes[ends - j]
    return key, np.repeat(np.arange(len(words)), lengths + 1)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows with text and lang. Tasks add up their own grams before the shuffle."""
    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold_up(some):
            key, at = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
            return [(key, np.bincount(at, np.concatenate([n for _, n in some])).astype(np.int64))]

        for batch in batches:
            words, owner, word = _unique_words(batch.column("text"))
            key, of = _grams(words)
            distinct, at = np.unique(key, return_inverse=True)
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            for name in set(lang):
                times = np.bincount(word[(lang == name)[owner]], minlength=len(words))
                n = np.bincount(at, times[of], minlength=len(distinct)).astype(np.int64)
                some = held.setdefault(name, [])
                some.append((distinct[n > 0], n[n > 0]))
                if len(some) >= 16:
                    held[name] = fold_up(some)
        for name, some in held.items():
            key, n = fold_up(some)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(key), pa.string()), pa.array(key), pa.array(n)], names=["lang", "gram", "n"])

    return batched(rows.select("lang", "text")).mapInArrow(count, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))


def smoothed(counts: DataFrame) -> DataFrame:
    """Kneser-Ney parts (lang, part, slot, value) from four-gram counts.

    Part n (1 to 4) is the discounted share of a gram of n characters, part -n the weight that its context
    gives to the order below. Equal slots keep the larger value.
    """
    out, grams = None, counts
    for n in range(ORDER, 0, -1):
        # discount from the grams that occur once and twice
        discount = grams.groupBy("lang").agg(
            F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).select(
            "lang", F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.coalesce(
                F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0)), F.lit(0.5)))).alias("d"))
        context = grams.withColumn("context", F.shiftright("gram", CHAR_BITS)) if n > 1 else grams.withColumn("context", F.lit(0).cast("long"))
        totals = context.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("types")).join(discount, "lang")
        shares = context.join(totals, ["lang", "context"]).select(
            "lang", F.lit(n).alias("part"), "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("value"))
        weights = totals.select("lang", F.lit(-n).alias("part"), F.col("context").alias("gram"),
                                (F.col("d") * F.col("types") / F.col("total")).alias("value"))
        both = shares.unionByName(weights)
        out = both if out is None else out.unionByName(both)
        if n > 1:
            grams = grams.groupBy("lang", F.col("gram").bitwiseAND((1 << CHAR_BITS * (n - 1)) - 1).alias("gram")).agg(
                F.count(F.lit(1)).alias("n"))
    return out.groupBy("lang", "part", F.pmod("gram", F.lit(SLOTS)).alias("slot")).agg(F.max("value").alias("value"))


@dataclass
class Models:
    """Languages with their sorted arrays: ``parts[lang][part] = (slots, values)``."""
    langs: list[str]
    parts: list[dict[int, tuple[np.ndarray, np.ndarray]]]
    limits: np.ndarray | None = None
    sharpness: float = 0.1
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    values: np.ndarray | None = None

    def _look(self, lang: int, part: int, slots: np.ndarray, missing: float) -> np.ndarray:
        have, values = self.parts[lang].get(part, (np.zeros(0, np.int64), np.zeros(0)))
        if not len(have):
            return np.full(len(slots), missing)
        at = np.minimum(np.searchsorted(have, slots), len(have) - 1)
        return np.where(have[at] == slots, values[at], missing)

    def _work_out(self, grams: np.ndarray) -> np.ndarray:
        """Natural log of the interpolated probability of grams, a column per language."""
        out = np.empty((len(grams), len(self.langs)))
        for lang in range(len(self.langs)):
            p = np.full(len(grams), 1 / (_MASK + 1))
            for n in range(1, ORDER + 1):
                gram = grams & ((1 << CHAR_BITS * n) - 1)
                weight = self._look(lang, -n, (gram >> CHAR_BITS) % SLOTS if n > 1 else np.zeros(len(grams), np.int64), 1.0)
                p = self._look(lang, n, gram % SLOTS, 0.0) + weight * p
            out[:, lang] = np.log(p)
        return out

    def gram_values(self, grams: np.ndarray) -> np.ndarray:
        """The same for sorted distinct grams, remembered between batches."""
        if self.values is None or len(self.known) > CACHE_GRAMS:
            self.known, self.values = np.zeros(0, np.int64), np.zeros((0, len(self.langs)))
        new = grams[~np.isin(grams, self.known, assume_unique=True)]
        if len(new):
            order = np.argsort(both := np.concatenate([self.known, new]), kind="stable")
            self.values = np.concatenate([self.values, self._work_out(new)])[order]
            self.known = both[order]
        return self.values[np.searchsorted(self.known, grams)]

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of every text under every language, and the texts' characters."""
        n = len(column)
        words, owner, word = _unique_words(column)
        if not len(word):
            return np.zeros((n, len(self.langs))), np.zeros(n)
        key, of = _grams(words)
        distinct, at = np.unique(key, return_inverse=True)
        values = self.gram_values(distinct)
        size = np.bincount(of, minlength=len(words))
        chars = np.bincount(owner, size[word], minlength=n)
        out = np.empty((n, len(self.langs)))
        for lang in range(len(self.langs)):
            per_word = np.bincount(of, values[at, lang], minlength=len(words))
            out[:, lang] = -np.bincount(owner, per_word[word], minlength=n)
        return out / np.maximum(chars, 1)[:, None], chars

    def posterior(self, entropy: np.ndarray, chars: np.ndarray, sharpness: float | None = None) -> np.ndarray:
        """Share of the best language, sharper for longer texts."""
        gap = entropy - entropy.min(axis=1, keepdims=True)
        weight = np.minimum(chars, 1_000)[:, None] * (self.sharpness if sharpness is None else sharpness)
        return 1 / np.exp(-np.minimum(gap * weight, 50)).sum(axis=1)


def kept_apart(doc_id: Column) -> Column:
    """Whether a learning row is kept for calibration and counted after it."""
    return F.pmod(F.xxhash64(F.lit("calibration"), doc_id), F.lit(CALIBRATION_PART)) == 0


def _models(counts: DataFrame) -> Models:
    """The models of four-gram counts."""
    table = smoothed(counts).toArrow()
    lang, part = np.array(table["lang"].to_numpy(zero_copy_only=False)), table["part"].to_numpy()
    slot, value = table["slot"].to_numpy(), table["value"].to_numpy()
    langs = sorted(set(lang))
    parts = []
    for name in langs:
        arrays = {}
        for p in range(-ORDER, ORDER + 1):
            some = np.flatnonzero((lang == name) & (part == p))
            if len(some):
                some = some[np.argsort(slot[some])]
                arrays[p] = (slot[some], value[some])
        parts.append(arrays)
    return Models(langs, parts)


def _learning_rows(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        "text is not null and lang is not null").where(fold(F.col("doc_id"), folds) != held_out)


def _trial(rows: DataFrame) -> tuple[Models, DataFrame]:
    """Models and stored counts of the rows that are not kept apart, calibrated on those that are."""
    # calibration meets texts that its models were not learned from
    apart = kept_apart(F.col("doc_id"))
    # the counts are read several times by the lower orders
    counts = stored(gram_counts(rows.where(~apart)))
    models = _models(counts)
    if models.langs:
        _calibrate(models, rows.where(apart))
    return models, counts


def learn(docs: DataFrame, folds: int, held_out: int) -> Models:
    """Models from the rows with text and lang outside the held-out fold but for those kept apart, calibrated on these."""
    models, counts = _trial(_learning_rows(docs, folds, held_out))
    discard(counts)
    return models


def learn_whole(docs: DataFrame, folds: int, held_out: int) -> Models:
    """Models from all rows with text and lang outside the held-out fold, with the calibration of :func:`learn`."""
    rows = _learning_rows(docs, folds, held_out)
    trial, counts = _trial(rows)
    limits = {} if trial.limits is None else dict(zip(trial.langs, trial.limits))
    rest = gram_counts(rows.where(kept_apart(F.col("doc_id"))))
    whole = stored(counts.unionByName(rest).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    discard(counts)
    models = _models(whole)
    discard(whole)
    models.limits = np.array([limits.get(name, np.inf) for name in models.langs])
    models.sharpness = trial.sharpness
    return models


def _calibrate(models: Models, rows: DataFrame) -> None:
    """Rejection limits per language, and the sharpness that makes scores match how often they are right.

    Every text of ``rows`` with a letter takes part, each in the task that reads it; only sums reach the driver. A language
    without such a text rejects none.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def sums(batches):
        models = shared.value
        at = {name: i for i, name in enumerate(models.langs)}
        own, loss = np.zeros((len(at), 3)), np.zeros(len(SHARPNESS))
        for batch in batches:
            entropy, chars = models.entropies(batch.column("text"))
            truth = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)
            some = chars > 0
            entropy, chars, truth = entropy[some], chars[some], truth[some]
            if not len(truth):
                continue
            value = entropy[np.arange(len(truth)), truth]
            for power in range(3):
                own[:, power] += np.bincount(truth, value ** power, minlength=len(at))
            right = (entropy.argmin(axis=1) == truth).astype(float)
            for i, sharpness in enumerate(SHARPNESS):
                p = np.clip(models.posterior(entropy, chars, sharpness), 1e-6, 1 - 1e-6)
                loss[i] -= (right * np.log(p) + (1 - right) * np.log(1 - p)).sum()
        values = np.concatenate([own.ravel(), loss])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["place", "value"])

    table = batched(rows.where(F.col("lang").isin(models.langs)).select("text", "lang")).mapInArrow(
        sums, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(3 * len(models.langs) + len(SHARPNESS))
    total[table["place"].to_numpy()] = table["value"].to_numpy()
    limits = np.full(len(models.langs), np.inf)
    for lang, (n, first, second) in enumerate(total[:3 * len(limits)].reshape(-1, 3)):
        if n:
            deviation = np.sqrt(max(second / n - (first / n) ** 2, 0.0))
            limits[lang] = first / n + REJECT_DEVIATIONS * max(deviation, 0.05)
    models.limits = limits
    if np.isfinite(limits).any():
        models.sharpness = SHARPNESS[int(total[3 * len(limits):].argmin())]
    shared.destroy()


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Language of every whole text; ``rejected`` marks texts unlike what their language was learned from."""
    models = learn_whole(docs, folds, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("entropy", pa.float64()), ("rejected", pa.bool_())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        models, n = shared.value, batch.num_rows
        if models.langs:
            entropy, chars = models.entropies(batch.column("text"))
            best = entropy.argmin(axis=1)
            least = entropy[np.arange(n), best]
            named = chars > 0
            names = [models.langs[b] if ok else "und" for b, ok in zip(best, named)]
            score = np.where(named, models.posterior(entropy, chars), 0.0)
            rejected = ~named | (least > models.limits[best])
        else:
            names, score, least, rejected = ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        return record_batch(schema, {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": score,
                                     "entropy": least, "rejected": rejected})

    return batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(
        per_batch(run), "doc_id long, lang_pred string, score double, entropy double, rejected boolean").select(
        "doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
