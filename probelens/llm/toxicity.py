"""Toxicity from two class-conditional Kneser-Ney models.

A word is spelled by a model for each class: the probability of a character after up to ORDER earlier ones of
the word is the class's discounted count, and what the discount frees goes to a lower order that both classes
share, built on continuation counts. Spellings that one class has often and the other never thus differ, also for
inflected forms of a rare stem, while words that neither has cancel out.

A text is compared by the length-normalised difference of its two log-likelihoods: over all of its words, and over its most
toxic run of RUN words and single word, since a long text may be toxic in one place. A logistic curve on
these, fitted on labelled rows that the counts don't come from, makes the score.

Both are fitted on a bounded sample of labelled rows, chosen by a hash of the id; whole texts are counted in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.llm.language_id import held_out
from probelens.llm.store import small_batches
from probelens.llm.words import _POWERS, NOT_ALNUM, Words, mix, ranges, slices

ORDER = 5
SHARED = (3, 1)
#: Of the shared orders, and of a class's counts, where what one or two texts have is left to the shared orders.
DISCOUNT, CLASS_DISCOUNT = 0.75, 1.5
RUN = 8
#: Labelled rows of each class that counts are taken from, and that the curve is fitted on; the sample's bound.
COUNTED_ROWS = 8000
FITTED_ROWS = 2000

_VALUES = mix(np.arange(301, 557, dtype=np.uint64))
_BEGIN, _END = 2, 3


class Spelling:
    """The characters of words, each with a mark before and after, and hashes of what comes before each of them."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n = ends - starts + 2
        self.counts = n - 1  # characters to predict, the end among them
        offsets = np.cumsum(n) - n
        inner = np.repeat(starts, n) + ranges(n) - 1
        data = np.empty(int(n.sum()), np.uint8)
        mask = np.ones(len(data), bool)
        mask[offsets] = mask[offsets + n - 1] = False
        data[mask] = buf[inner[mask]]
        upper = (data >= 0x41) & (data <= 0x5A) & mask
        data[upper] += 32
        data[offsets], data[offsets + n - 1] = _BEGIN, _END
        self.begin = np.repeat(offsets, self.counts)
        self.at = np.repeat(offsets + 1, self.counts) + ranges(self.counts)
        up, self.down = _POWERS.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[:-1], out=self.sums[1:])

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each character with its context, and of the context alone."""
        low = np.maximum(self.at - order, self.begin)
        salt = np.uint64(2 * order + 1)
        gram = mix((self.sums[self.at + 1] - self.sums[low]) * self.down[low] + salt)
        context = mix((self.sums[self.at] - self.sums[low]) * self.down[low] ^ np.uint64(0x5555) + salt)
        return gram, context


class Table:
    """Numbers by key; 0 where a key is absent."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.columns = keys[order], [c[order].astype(np.float32) for c in columns]

    def __call__(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(keys), np.float32) for _ in self.columns]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return [np.where(hit, c[at], np.float32(0)) for c in self.columns]


@dataclass
class Model:
    grams: Table  # counts of the top order in both classes
    contexts: Table  # totals and numbers of different characters after a context, in both classes
    shared: list[tuple[Table, Table]]  # of each lower order: continuations; their totals and numbers of characters
    curve: np.ndarray | None = None

    def differences(self, spelling: Spelling) -> np.ndarray:
        """Log-likelihood of each word in the toxic model less that in the ordinary one."""
        base = np.full(len(spelling.at), 1 / 256, np.float32)
        for order, (grams, contexts) in reversed(list(zip(SHARED, self.shared))):
            gram, context = spelling.keys(order)
            (count,), (total, kinds) = grams(gram), contexts(context)
            safe = np.maximum(total, 1)
            base = np.where(total > 0, np.maximum(count - DISCOUNT, 0) / safe + DISCOUNT * kinds / safe * base, base)
        gram, context = spelling.keys(ORDER)
        counts, (toxic, ordinary, toxic_kinds, ordinary_kinds) = self.grams(gram), self.contexts(context)
        logs = []
        for count, total, kinds in ((counts[0], toxic, toxic_kinds), (counts[1], ordinary, ordinary_kinds)):
            safe = np.maximum(total, 1)
            freed = np.minimum(CLASS_DISCOUNT * np.maximum(kinds, 1) / safe, 1)
            logs.append(np.log(np.where(total > 0, np.maximum(count - CLASS_DISCOUNT, 0) / safe + freed * base, base)))
        by_character = (logs[0] - logs[1]).astype(np.float64)
        return np.add.reduceat(by_character, np.cumsum(spelling.counts) - spelling.counts) if len(by_character) else np.zeros(0)

    def features(self, texts: pa.Array) -> np.ndarray:
        """For each text: the difference per word over all words, over the highest run and of the highest word, and
        the logarithm of the number of words."""
        words = Words(texts, NOT_ALNUM, lower=True)
        _, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        known = np.empty(len(first))
        sizes = np.cumsum(words.ends[first] - words.starts[first] + 2)
        for a, b in _chunks(sizes, 1 << 20):
            some = first[a:b]
            known[a:b] = self.differences(Spelling(words.buf, words.starts[some], words.ends[some]))
        each, out = known[which], np.zeros((len(texts), 4))
        for i, (low, n) in enumerate(zip(words.first.tolist(), words.counts.tolist())):
            if n:
                own = each[low : low + n]
                sums = np.concatenate(([0.0], np.cumsum(own)))
                run = min(RUN, n)
                out[i] = own.mean(), (sums[run:] - sums[:-run]).max() / run, own.max(), np.log(n)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_with_one(self.features(texts)) @ self.curve, -30, 30)))


def _chunks(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` by running totals."""
    group = (ends - 1) // most if len(ends) else ends
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(ends)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.ones((len(x), 1))), axis=1)


def sample(labels: DataFrame, doc_id: str, label: str, rows: int, salt: int) -> DataFrame:
    """(doc_id, label) of about `rows` ids of each class at most, by a hash of the id."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__label"))
    sizes = {r[0]: r[1] for r in ids.groupBy("__label").count().collect()}
    share = F.when(F.col("__label") == 1, min(1.0, rows / max(1, sizes.get(1, 0)))).otherwise(min(1.0, rows / max(1, sizes.get(0, 0))))
    return ids.where(F.pmod(F.xxhash64("__id", F.lit(salt)), F.lit(1_000_003)) < 1_000_003 * share)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__text"):
        words = Words(batch.column("__text"), NOT_ALNUM, lower=True)
        if not len(words.hashes):
            continue
        doc = np.repeat(np.arange(len(batch)), words.counts)
        order = np.lexsort((words.hashes, doc))
        new = np.concatenate(([True], (np.diff(doc[order]) != 0) | (np.diff(words.hashes[order]) != 0)))
        once = order[new]  # a word counts once in a text
        label = batch.column("__label").to_numpy()[doc[once]]
        _, first, which = np.unique(words.hashes[once], return_index=True, return_inverse=True)
        first = once[first]
        toxic = np.bincount(which, weights=label == 1, minlength=len(first)).astype(np.int64)
        ordinary = np.bincount(which, weights=label == 0, minlength=len(first)).astype(np.int64)
        data = words.buf.tobytes()
        spelled = [data[a:b].lower() for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.binary()), pa.array(toxic), pa.array(ordinary)], names=["word", "toxic", "ordinary"])


def _sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


def count(words: pa.Table, at_once: int = 50_000) -> Model:
    """Models from a table of distinct words with their counts in both classes, `at_once` words at a time."""
    found = [_grams(words.slice(low, at_once).combine_chunks()) for low in range(0, len(words), at_once)]
    columns = [np.concatenate(c) for c in zip(*found)]
    del found
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1])))
    a, b = (np.add.reduceat(c, first) for c in columns[1:3])
    grams, owner, *lower = (c[first] for c in (columns[0], *columns[3:]))
    contexts = _sums(owner, a, b, a > 0, b > 0)
    shared, higher = [], np.arange(len(grams))
    for g, c in zip(lower[::2], lower[1::2]):  # a gram of a lower order counts once for each different one of the next higher order
        g, c = g[higher], c[higher]
        keys, n = _sums(g, np.ones(len(g), np.int64))
        _, at = np.unique(g, return_index=True)
        totals = _sums(c[at], n, np.ones(len(n), np.int64))
        shared.append((Table(keys, n), Table(*totals)))
        higher = higher[at]
    often = a + b > 1
    return Model(Table(grams[often], a[often], b[often]), Table(*contexts), shared)


def _grams(words: pa.Table) -> list[np.ndarray]:
    """Distinct grams of the top order with their counts, their contexts, and the grams and contexts of lower orders."""
    spelled = words.column("word").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset : spelled.offset + len(spelled) + 1]
    spelling = Spelling(np.frombuffer(spelled.buffers()[2], np.uint8), offsets[:-1], offsets[1:])
    gram, context = spelling.keys(ORDER)
    distinct, at, which = np.unique(gram, return_index=True, return_inverse=True)
    counts = [np.bincount(which, weights=np.repeat(words.column(n).to_numpy(), spelling.counts)).astype(np.int32) for n in ("toxic", "ordinary")]
    return [distinct, *counts, context[at], *(x[at] for order in SHARED for x in spelling.keys(order))]


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = _with_one(x / scale), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + 1e-2 * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    w[:-1] /= scale
    return w


def fit(docs: DataFrame, labels: DataFrame, counted, fitted, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        counted_rows: int = COUNTED_ROWS, fitted_rows: int = FITTED_ROWS) -> Model | None:
    """counted, fitted: conditions on the labels' ids for rows that counts and the curve come from. None if either
    lacks a class or words."""
    spark = docs.sparkSession
    small_batches(spark)

    def labelled(condition, rows: int, salt: int) -> DataFrame:
        chosen = sample(labels.where(condition), doc_id, label, rows, salt)
        rows = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("__id")).select(F.col("__label").cast("long"), F.col(text).alias("__text"))
        return rows.dropDuplicates()  # copies say nothing new

    counts = labelled(counted, counted_rows, 1).mapInArrow(_count_words, "word BINARY, toxic BIGINT, ordinary BIGINT")
    words = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow()
    if not len(words) or not all(np.any(words.column(n).to_numpy() > 0) for n in ("toxic", "ordinary")):
        return None
    model = count(words)
    shared = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            x = shared.value.features(batch.column("__text"))
            yield pa.RecordBatch.from_arrays([batch.column("__label"), *map(pa.array, x.T)], names=["y", "a", "b", "c", "d"])

    rows = np.array(labelled(fitted, fitted_rows, 2).mapInArrow(features, "y BIGINT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE").collect(), np.float64)
    if not len(rows) or len(np.unique(rows[:, 0])) < 2:
        return None
    rows = rows[np.lexsort(rows.T)]
    model.curve = fit_curve(rows[:, 1:], rows[:, 0])
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the `carry` columns and score. Texts without words have the features of no evidence;
    without a model every score is 0. Only the text is read; repeated rows give repeated results."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*carry, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["score DOUBLE"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = shared.value.scores(batch.column("__text")) if shared.value is not None else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit(docs, labels, remainder.isin(1, 2, 3), remainder == 4)
    out = held_out("doc_id", 5, 0)
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
