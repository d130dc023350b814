"""Language-model scores: a hashed maximum-entropy model with a softmax factored by levels of classes.

Tokens are words, and one end for each text. The frequent words of the training texts (heads) are the vocabulary, a tree
by frequency; every other word is one unknown token, spelled out by its smoothed frequency among unknown words. A token's
probability is the product of those of the branches that lead to it, each a softmax over weights of hashed features of what
comes before: the last token, the last two, and the second and third last alone (skips). Biases are the logarithms of frequencies,
so training starts from the unigram model.

Vocabulary and weights grow with the square root of the training tokens, as the number of different words of a share does; levels
are added as the vocabulary needs them.

Counts cover all training texts: words are counted by part of the hash space (see `keyed`). Heads go to all tasks; only the
other words travel, once for each text that has them. The weights
are trained on all blocks of all training texts in rounds: each task descends on its blocks from the weights of the round
before, and Spark averages what the tasks changed. Only that average, of the model's size, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.llm import keyed
from probelens.llm.language_id import held_out
from probelens.llm.store import new_dir, parts_of, small_batches
from probelens.llm.substring_dedup import _LAST, _OWNER, owners_of
from probelens.llm.words import SPACES, Words, give_back, keep_freed, mix, ranges, slices

#: Branches of a node of the tree of words, and tokens of the smallest tree, of two levels.
BRANCHES = 32
TOKENS = BRANCHES**2
END, UNKNOWN = 0, 1
#: Rows of the hashed weights for the first level, and for each further one, up to ROWS_FROM training tokens.
CLASS_ROWS, WORD_ROWS, ROWS_FROM = 1 << 13, 1 << 14, 1 << 22
FEATURES = 4
#: A word with at least one of so many of all training tokens is a head, up to HEADS_FROM training tokens.
HEADS, HEADS_FROM = 1 << 17, 1 << 20
#: Tasks of a round of training, up to ROWS_FROM training tokens.
TASKS = 6
#: Tokens of a block, and rounds that the blocks are dealt to.
BLOCK, ROUNDS = 64, 6
RATE, BATCH = 0.15, 2048


def growth(tokens: int, start: int) -> float:
    """By how much what grows with the square root of the training tokens is larger than at `start` tokens."""
    return max(1.0, tokens / start) ** 0.5


@dataclass
class Counts:
    keys: np.ndarray  # hashes of heads, sorted
    counts: np.ndarray
    tokens: int  # N
    distinct: int  # V
    ends: int  # training texts

    def __post_init__(self) -> None:
        order = np.lexsort((self.keys, -self.counts))
        self.rank = np.full(len(self.keys), UNKNOWN, np.int64)
        self.rank[order] = np.arange(2, 2 + len(order))
        self.vocabulary = order
        known = int(self.counts[order].sum())
        self.unknown, self.unknown_distinct = self.tokens - known - self.ends, self.distinct - len(order) - (self.ends > 0)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is a head, its count and its id."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), np.full(len(hashes), UNKNOWN, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        head = self.keys[at] == hashes
        return head, np.where(head, self.counts[at], 0), np.where(head, self.rank[at], UNKNOWN)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__text"):
        words = Words(batch.column("__text"), SPACES, hashed=False)
        yield pa.RecordBatch.from_arrays([pa.array([int(words.counts.sum())]), pa.array([len(batch)])], names=["words", "texts"])


def _word_counts(words: Words, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(words.hashes[np.repeat(train, words.counts)], return_counts=True)


def _counts_only(keys: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    """Counts of a batch for the parts; such rows have no owners."""
    dealt = keyed.deal(keys, np.array([len(keys)]), np.zeros(1, _OWNER), parts, 8, n.astype("<i8"))
    return dealt.set_column(1, "owners", pa.nulls(len(dealt), pa.binary()))


def _deal_counts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            keys, n = _word_counts(Words(batch.column("__text"), SPACES, lower=True), np.ones(len(batch), bool))
            if len(keys):
                yield _counts_only(keys, n, parts)

    return run


def _added(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(k, "<u8") for k, _ in rows]) if rows else np.zeros(0, np.uint64)
    n = np.concatenate([np.frombuffer(c, "<i8") for _, c in rows]) if rows else np.zeros(0, np.int64)
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, weights=n, minlength=len(distinct)).astype(np.int64)


def _heads(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("keys").to_pylist(), b.column("extra").to_pylist())]
        keys, n = _added(rows)
        head = n >= least
        yield pa.RecordBatch.from_arrays([pa.array([keys[head].tobytes()], pa.binary()), pa.array([n[head].tobytes()], pa.binary()), pa.array([len(keys)])], names=["keys", "counts", "distinct"])

    return run


def count(train: DataFrame, parts: int) -> Counts:
    """Counts of all words of the training texts; those of heads by word."""
    total = train.mapInArrow(_tokens, "words BIGINT, texts BIGINT").agg(F.sum("words"), F.sum("texts")).first()
    words, texts = total[0] or 0, total[1] or 0
    least = max(1, -(-(words + texts) // int(HEADS * growth(words + texts, HEADS_FROM))))
    found = keyed.by_part(train.mapInArrow(_deal_counts(parts), keyed.SCHEMA), parts).mapInArrow(_heads(least), "keys BINARY, counts BINARY, distinct BIGINT").collect()
    keys = np.concatenate([np.frombuffer(r[0], "<u8") for r in found] or [np.zeros(0, np.uint64)])
    n = np.concatenate([np.frombuffer(r[1], "<i8") for r in found] or [np.zeros(0, np.int64)])
    order = np.argsort(keys)
    return Counts(keys[order], n[order], words + texts, sum(r[2] for r in found) + (texts > 0), texts)


# The model


class Model:
    """Weights and biases by level; a token's id in base BRANCHES gives its branches, from the root on."""

    def __init__(self, counts: Counts):
        self.depth = 2
        while BRANCHES**self.depth < len(counts.vocabulary) + 2:
            self.depth += 1
        n = np.full(BRANCHES**self.depth, 0.01 * TOKENS / BRANCHES**self.depth)
        n[END], n[UNKNOWN] = counts.ends + 0.5, counts.unknown + 0.5
        n[2 : 2 + len(counts.vocabulary)] = counts.counts[counts.vocabulary] + 0.5
        self.bias = [np.log(n.reshape(-1, BRANCHES, BRANCHES ** (self.depth - k - 1)).sum(axis=2)).astype(np.float32) for k in range(self.depth)]
        times = 1 << int(np.log2(growth(counts.tokens, ROWS_FROM)))
        self.by_class = np.zeros((CLASS_ROWS * times, BRANCHES), np.float32)
        self.by_word = [np.zeros((WORD_ROWS * times, BRANCHES), np.float32) for _ in range(self.depth - 1)]

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.by_class, *self.by_word]

    def plus(self, change: np.ndarray | None = None) -> Model:
        """A copy to which a change of all weights is added."""
        own, at = [], 0
        for w in self.weights:
            own.append(w.copy() if change is None else w + change[at : at + w.size].reshape(w.shape))
            at += w.size
        out = Model.__new__(Model)
        out.__dict__ = self.__dict__ | {"by_class": own[0], "by_word": own[1:]}
        return out

    def features(self, before: np.ndarray) -> np.ndarray:
        """Hashed features by position; before: the last three tokens of each, nearest first."""
        b = np.ascontiguousarray(before.T).astype(np.uint64)
        out = np.stack((b[0], ((b[0] + 1) << np.uint64(28)) + b[1], b[1], b[2]))
        out *= np.uint64(FEATURES)
        out += np.arange(FEATURES, dtype=np.uint64)[:, None]
        return mix(out)

    def levels(self, ids: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: its number, the rows of the weights by feature, the scores of all branches of each position's node,
        their exponentials and the sums of these, and the branch that was taken."""
        features, ones = self.features(before), np.ones(BRANCHES, np.float32)
        for k, weights in enumerate(self.weights):
            node = ids // BRANCHES ** (self.depth - k)
            inner = mix(features ^ (node.astype(np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)) if k else features
            at = ((inner >> np.uint64(32)) & np.uint64(len(weights) - 1)).view(np.int64)  # rows are a power of two
            z = self.bias[k].take(node, axis=0)
            for rows in at:
                z += weights.take(rows, axis=0)
            with np.errstate(over="ignore"):
                e = np.exp(z)
            total = e @ ones
            far = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))
            if len(far):  # out of the range of single precision
                z[far] -= z[far].max(axis=1, keepdims=True)
                e[far] = np.exp(z[far])
                total[far] = e[far] @ ones
            yield k, at, z, e, total, ids // BRANCHES ** (self.depth - k - 1) % BRANCHES

    def log_probability(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids))
        for low in range(0, len(ids), BATCH):
            some = ids[low : low + BATCH]
            for _, _, z, _, total, branch in self.levels(some, before[low : low + BATCH]):
                out[low : low + BATCH] += z[np.arange(len(some)), branch] - np.log(total)
        return out

    def descend(self, ids: np.ndarray, before: np.ndarray, seen: list[np.ndarray]) -> None:
        """A step on some positions; seen: squared gradients of each row so far."""
        for level, at, _, error, total, branch in self.levels(ids, before):
            weights, squares = self.weights[level], seen[level]
            error *= (1 / total)[:, None]
            error[np.arange(len(ids)), branch] -= 1
            rows, gradients, cuts = _sums(error, at)
            norms = np.einsum("ij,ij->i", gradients, gradients) / np.float32(BRANCHES)
            for low, high in zip(cuts, cuts[1:]):  # features one by one: they may share rows
                row, gradient = rows[low:high], gradients[low:high]
                of_row = squares.take(row) + norms[low:high]
                squares[row] = of_row
                gradient *= (RATE / np.sqrt(of_row + np.float32(1e-3)))[:, None]
                new = weights.take(row, axis=0)
                new -= gradient
                weights[row] = new


def _sums(error: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """By feature, the different rows of the weights and the sums of the errors of each one's positions; and where features begin."""
    n, bits = at.shape[1], at.shape[1].bit_length()
    packed = np.sort((at << bits) | np.arange(n), axis=1)
    own, order = (packed >> bits).ravel(), (packed & ((1 << bits) - 1)).ravel()
    begins = np.ones(len(own) + 1, bool)
    np.not_equal(own[1:], own[:-1], out=begins[1:-1])
    begins[::n] = True
    first = np.flatnonzero(begins)
    lengths, first = first[1:] - first[:-1], first[:-1]
    sums = error.take(order[first], axis=0)
    more = np.arange(len(first))
    for k in range(1, 4):  # most rows have few positions
        more = more[lengths[more] > k]
        sums[more] += error.take(order[first[more] + k], axis=0)
    more = more[lengths[more] > 4]
    if len(more):
        runs = lengths[more] - 4
        inside = error.take(order[np.repeat(first[more] + 4, runs) + ranges(runs)], axis=0)
        # two columns as one complex number: half as many cells to add up
        sums[more] += np.add.reduceat(inside.view(np.complex64), np.cumsum(runs) - runs, axis=0).view(np.float32)
    return own[first], sums, np.searchsorted(first, np.arange(0, len(own) + 1, n)).tolist()


def preceding(ids: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The last three tokens before each position of joined texts, END before a text begins."""
    place = ranges(counts)
    out = np.full((len(ids), 3), END, np.int64)
    for k in range(3):
        inside = place > k
        out[inside, k] = ids[np.flatnonzero(inside) - k - 1]
    return out


def encode(words: Words, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Ids of all texts, an end after each; tokens of each; and for distinct words (head, count, id), with each word's."""
    distinct, which = np.unique(words.hashes, return_inverse=True)
    known = counts.of(distinct)
    n = words.counts + 1
    ids = np.full(int(n.sum()), END, np.int64)
    spots = np.ones(len(ids), bool)
    spots[np.cumsum(n) - 1] = False
    ids[spots] = known[2][which]
    return ids, n, which, (distinct, *known)


def _blocks(shared):
    """All blocks of tokens, with the three before each block, and the round they are for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            ids, n, _, _ = encode(Words(batch.column("__text"), SPACES, lower=True), shared.value)
            hashes = batch.column("__hash").to_numpy().view(np.uint64)
            blocks = -(-n // BLOCK)
            number = ranges(blocks)
            with np.errstate(over="ignore"):
                draw = mix(np.repeat(hashes, blocks) + number.astype(np.uint64))
            led = np.full(len(ids) + 3 * len(n), END, "<u4")  # three ends before each text
            led[np.arange(len(ids)) + 3 * np.repeat(np.arange(1, len(n) + 1), n)] = ids
            size = np.minimum(np.repeat(n, blocks) - number * BLOCK, BLOCK) + 3
            own = led[np.repeat(np.repeat(np.cumsum(n + 3) - n - 3, blocks) + number * BLOCK, size) + ranges(size)]
            ends = np.concatenate(([0], np.cumsum(4 * size))).astype(np.int32)
            found = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(own)])
            yield pa.RecordBatch.from_arrays([pa.array(((draw >> np.uint64(32)) % np.uint64(ROUNDS)).astype(np.int32)), found], names=["round", "ids"])

    return run


_CHANGE = "slice INT, changed BINARY, weight DOUBLE"
_SLICES = 24


def _descend(shared):
    """A task's changes to the weights, in slices and with half precision, weighted by its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, positions = shared.value, 0
        model = start.plus()
        seen = [np.zeros(len(w), np.float32) for w in model.weights]
        rng = np.random.default_rng(7)
        keep_freed()
        for batch in batches:
            if not len(batch):
                continue
            blocks = batch.column("ids").cast(pa.large_binary())
            n = np.frombuffer(blocks.buffers()[1], np.int64)[blocks.offset : blocks.offset + len(blocks) + 1]
            flat = np.frombuffer(blocks.buffers()[2], np.uint8)[n[0] : n[-1]].view("<u4").astype(np.int64)
            n = np.diff(n) // 4
            at = np.repeat(np.cumsum(n) - n + 3, n - 3) + ranges(n - 3)
            at = at[rng.permutation(len(at))]
            for low in range(0, len(at), BATCH):
                some = at[low : low + BATCH]
                model.descend(flat[some], np.stack([flat[some - k] for k in (1, 2, 3)], axis=1), seen)
            positions += len(at)
        give_back()
        if positions:
            change = np.array_split(np.concatenate([(a - b).astype(np.float16).ravel() for a, b in zip(model.weights, start.weights)]), _SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([c.tobytes() for c in change], pa.binary()), pa.array([float(positions)] * _SLICES)], names=["slice", "changed", "weight"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for k, data, weight in zip(*(batch.column(n).to_pylist() for n in ("slice", "changed", "weight"))):
            had = sums.setdefault(k, [0.0, 0.0])
            had[0] = had[0] + np.frombuffer(data, np.float16).astype(np.float32) * weight
            had[1] += weight
    if sums:
        rows = [(k, (total / weight).astype(np.float32).tobytes(), weight) for k, (total, weight) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows])], names=["slice", "changed", "weight"])


def fit(train: DataFrame, counts: Counts, shared_counts) -> Model:
    spark, model = train.sparkSession, Model(counts)
    path = new_dir(spark, "blocks")
    train.mapInArrow(_blocks(shared_counts), "round INT, ids BINARY").write.partitionBy("round").parquet(path)
    blocks = spark.read.schema("ids BINARY, round INT").parquet(path)
    tasks = int(TASKS * growth(counts.tokens, ROWS_FROM))
    for r in range(ROUNDS):
        weights = spark.sparkContext.broadcast(model)
        changes = blocks.where(F.col("round") == r).select("ids").coalesce(tasks).mapInArrow(_descend(weights), _CHANGE)
        found = changes.repartition(min(_SLICES, parts_of(spark)), "slice").mapInArrow(_average, _CHANGE).collect()
        weights.destroy()
        if found:
            model = model.plus(np.concatenate([np.frombuffer(x.changed, np.float32) for x in sorted(found)]))
    return model


# Scores

_TAIL = np.dtype([("sum", "<f8"), ("known", "<i8")])


def _deal_tail(shared, parts: int):
    """Counts of words that are no heads from training texts, and these words of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            words, train = Words(batch.column("__text"), SPACES, lower=True), batch.column("__train").to_numpy(zero_copy_only=False)
            distinct, which = np.unique(words.hashes, return_inverse=True)
            tail = ~shared.value.of(distinct)[0]
            doc = np.repeat(np.arange(len(batch)), words.counts)
            keep = tail[which]
            if not keep.any():
                continue
            pairs, often = np.unique(doc[keep] * len(distinct) + which[keep], return_counts=True)
            owner, word = pairs // len(distinct), pairs % len(distinct)
            yield keyed.deal(distinct[word], np.bincount(owner, minlength=len(batch)), owners_of(batch), parts, 8, often.astype("<u4"))
            counted = train[owner]
            n = np.bincount(word[counted], weights=often[counted], minlength=len(distinct)).astype(np.int64)
            if n.any():
                yield _counts_only(distinct[n > 0], n[n > 0], parts)

    return run


def _tail_sums(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_part: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for part, *row in zip(*(batch.column(n).to_pylist() for n in ("part", "owners", "counts", "keys", "extra"))):
                of_part.setdefault(part, ([], []))[row[0] is None].append(row)
        for p, (pairs, counted) in of_part.items():
            keys, n = _added([(r[2], r[3]) for r in counted])
            part = keyed.Part(p, pairs, _OWNER, 8, np.dtype("<u4"))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, part.keys), len(keys) - 1)
                c = np.where(keys[at] == part.keys, n[at], 0)
            else:
                c = np.zeros(len(part.keys), np.int64)
            out = np.empty(len(part.owners), _TAIL)
            out["sum"] = np.add.reduceat(part.extra * np.log10(c + 0.5), part.offsets[:-1])
            out["known"] = np.add.reduceat(np.where(c > 0, part.extra, 0), part.offsets[:-1])
            _, once = np.unique(part.owners, return_index=True)  # repeated rows answer once
            yield from keyed.answers(p, part.owners[once], np.full(len(once), _TAIL.itemsize), out[once].view(np.uint8), parts)

    return run


def _tail_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(x, _TAIL) for x in batch.column("found").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__hash"), pa.array([float(x["sum"].sum()) for x in found]), pa.array([int(x["known"].sum()) for x in found])],
                                         names=["__id", "__hash", "tail_sum", "tail_known"])


_LOCAL = "n_tokens BIGINT, n_unknown BIGINT, head_known BIGINT, head_sum DOUBLE, model DOUBLE"


def _local(shared_counts, shared_model):
    """What a text's score needs besides its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, model = shared_counts.value, shared_model.value
        keep_freed()
        for batch in slices(batches, "__text"):
            words = Words(batch.column("__text"), SPACES, lower=True)
            ids, n, which, (_, head, count, rank) = encode(words, counts)
            logs = np.log10(count + 0.5)
            columns = [np.where(head & (count > 0), 1, 0), np.where(head, logs, 0), np.where(rank == UNKNOWN, 1, 0)]
            doc = np.repeat(np.arange(len(batch)), words.counts)
            known, heads, unknown = (np.bincount(doc, weights=c[which], minlength=len(batch)) for c in columns)
            log_p = model.log_probability(ids, preceding(ids, None, n)) / np.log(10)
            of_model = np.bincount(np.repeat(np.arange(len(batch)), n), weights=log_p, minlength=len(batch))
            made = [pa.array(n), pa.array(unknown.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(heads), pa.array(of_model)]
            names = [c.split()[0] for c in _LOCAL.split(", ")]
            keep = [i for i, x in enumerate(batch.schema.names) if x not in ("__text", "__train")]
            yield pa.RecordBatch.from_arrays([*(batch.columns[i] for i in keep), *made], names=[*(batch.schema.names[i] for i in keep), *names])

    return run


def score(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the `carry` columns, n_tokens, n_known, train_tokens, base_score and score.

    train: condition for the texts to learn from. base_score is of the smoothed unigram model over all words, score
    of the maximum-entropy model, both log10 probabilities. A null or blank text is one end. Rows that repeat an
    id are texts of their own. Without training texts, every word is unknown. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts_of(spark)
    kept = [f"__kept_{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(carry, kept)], F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("__id"), F.xxhash64(text).alias("__hash"),
                       F.col(text).alias("__text"), F.coalesce(train, F.lit(False)).alias("__train"))
    learned = rows.where("__train").select("__hash", "__text")
    counts = count(learned, parts)
    shared = spark.sparkContext.broadcast(counts)
    model = spark.sparkContext.broadcast(fit(learned, counts, shared))
    dealt = rows.select("__id", "__hash", "__text", "__train").mapInArrow(_deal_tail(shared, parts), keyed.SCHEMA)
    sent = keyed.by_part(dealt, parts).mapInArrow(_tail_sums(parts), keyed.ANSWERS)
    tails = keyed.gathered(sent, parts, _OWNER).mapInArrow(_tail_totals, "__id BIGINT, __hash BIGINT, tail_sum DOUBLE, tail_known BIGINT")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("__text", "__train")] + [_LOCAL])
    out = rows.mapInArrow(_local(shared, model), schema).join(tails, ["__id", "__hash"], "left")
    tail, whole = F.coalesce("tail_sum", F.lit(0.0)), float(np.log10(counts.tokens + 0.5 * (counts.distinct + 1)))
    rare = float(np.log10(counts.unknown + 0.5 * (counts.unknown_distinct + 1)))
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + (1 if counts.ends else 0)
    base = F.col("head_sum") + tail + float(np.log10(counts.ends + 0.5)) - F.col("n_tokens") * whole
    of_model = F.col("model") + tail - F.col("n_unknown") * rare
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, carry)], "n_tokens", known.cast("long").alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
                      base.alias("base_score"), of_model.alias("score"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out("doc_id", 5, 1)
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~out)
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
