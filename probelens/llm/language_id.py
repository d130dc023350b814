"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords: byte n-grams inside words, word ends included, hashed to
`BUCKETS` rows. Embeddings and softmax are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled rows. Part of the sample is kept from training to fit a temperature, and the confidence under
which a prediction is rejected. Scoring is linear, so embedding times weights is one small table, which goes to
the tasks; documents don't move.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.llm.store import small_batches
from probelens.llm.words import slices

BUCKETS = 1 << 14
DIM = 16
LENGTHS = (2, 3, 4)
#: Labelled rows a language contributes to the fit, about; the bound of the sample.
ROWS_PER_LANGUAGE = 1500
#: Steps of gradient descent at least, also for a small sample.
LEAST_STEPS = 400
#: Share of right predictions that may be rejected.
REJECTED = 0.002
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
#: Bytes as subwords see them: letters in lower case, every other ASCII byte is a word end (0).
_SEEN = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256)], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def subwords(text: str) -> np.ndarray:
    """The bucket of every byte n-gram that lies in one word, where a word end counts as its first or last byte."""
    data = _SEEN[np.frombuffer(f" {text} ".encode(), np.uint8)]
    inner, out = data != 0, []
    for n in LENGTHS:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        code = np.full(m, n, np.uint32)
        for i in range(n):
            code = code * np.uint32(0x01000193) ^ data[i : i + m]
        ok = inner[:m] | inner[1 : 1 + m] if n == 2 else inner[1 : 1 + m]
        for i in range(2, n - 1):
            ok = ok & inner[i : i + m]
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append((code[ok] >> np.uint32(18)) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """By the checksum of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, embedding times weights
    bias: np.ndarray
    temperature: float
    least: float  # confidence under which a prediction is rejected

    def logits(self, text: str) -> np.ndarray:
        buckets = subwords(text)
        if not len(buckets):
            return self.bias
        return np.bincount(buckets, minlength=BUCKETS).astype(np.float32) @ self.table / len(buckets) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        p = _softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, p[best]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for order, lang, text in zip(*(batch.column(n).to_pylist() for n in ("h", "lang", "text"))):
            if has_letter(text):
                ids, n = np.unique(subwords(text), return_counts=True)
                rows.append((order, lang, ids.astype("<u2").tobytes(), (n / n.sum()).astype("<f4").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=["h", "lang", "ids", "weights"])


def fit(train: DataFrame, doc_id: str, text: str, lang: str, rows_per_language: int = ROWS_PER_LANGUAGE, epochs: int = 8, rate: float = 8.0, seed: int = 1) -> Model | None:
    """Train on about `rows_per_language` rows of each language, chosen by a hash of the id. None without rows."""
    labelled = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not sizes:
        return None
    h = F.xxhash64(F.col(doc_id).cast("string"))
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_language / n))])
    sample = labelled.select(h.alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sample = sample.where(F.pmod(F.col("h"), F.lit(1_000_003)) < 1_000_003 * shares[F.col("lang")])
    rows = sorted(sample.mapInArrow(_count, "h BIGINT, lang STRING, ids BINARY, weights BINARY").collect())
    if not rows:
        return None
    return _descend(rows, sorted({r.lang for r in rows}), epochs, rate, seed)


def _dense(rows: Sequence) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.ids, "<u2")] = np.frombuffer(r.weights, "<f4")
    return x


def _descend(rows: list, languages: list[str], epochs: int, rate: float, seed: int) -> Model:
    rng, target = np.random.default_rng(seed), {k: i for i, k in enumerate(languages)}
    rows = [rows[i] for i in rng.permutation(len(rows))]
    cut = len(rows) // 5 if len(rows) >= 50 else 0
    kept, training = rows[:cut] or rows, rows[cut:]
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    batches = -(-len(training) // 64)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(training))
        for low in range(0, len(order), 64):
            some = [training[i] for i in order[low : low + 64]]
            x, y = _dense(some), np.array([target[r.lang] for r in some])
            hidden = x @ embed
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(y)), y] -= 1
            error *= rate * (1 - step / steps) / len(y)
            embed_step = x.T @ (error @ weights.T)
            weights -= hidden.T @ error * 4
            bias -= error.sum(axis=0) * 0.01
            embed -= embed_step * 64
            step += 1
    table = embed @ weights
    z = np.concatenate([_dense(kept[i : i + 64]) @ table + bias for i in range(0, len(kept), 64)])
    y = np.array([target[r.lang] for r in kept])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    return Model(languages, table, bias, temperature, float(np.quantile(right, REJECTED)) if len(right) else 0.0)


_OUT = "lang_pred STRING, score DOUBLE, rejected BOOLEAN"


def identify(docs: DataFrame, model: Model | None, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the `carry` columns, lang_pred, score (calibrated confidence) and rejected.

    Null texts and texts without a letter are `und` with score 0, and rejected; so is everything without a model.
    Texts whose confidence is under the model's limit keep their prediction and are marked as rejected. The label
    and all other columns are ignored; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*carry, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [_OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in slices(batches, "__text"):
            found = [fitted.predict(t) if fitted is not None and has_letter(t) else (UNDETERMINED, 0.0) for t in batch.column("__text").to_pylist()]
            low = fitted.least if fitted is not None else 0.0
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[0] == UNDETERMINED or x[1] < low for x in found])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small_batches(spark)
    out = held_out("doc_id", 4, 2)
    model = fit(docs.where(~out), "doc_id", "text", "lang")
    return identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
