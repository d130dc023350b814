"""Substring deduplication: passages of a fixed number of words that an earlier document has too.

Every window of `width` consecutive words gets a Rabin-Karp hash (polynomial over word hashes, rolled by prefix
sums). Spark brings all occurrences of a hash together, packed by part of the hash space (see `keyed`), and the
task finds the smallest document id of each. A window is repeated if that id is smaller than its own document's. What
returns to a document is one flag for each of its windows in that part, and only from parts with a repeated one.
Windows that a large share of the corpus has would all meet in one task. A sketch finds them; their counts and smallest ids
combine inside tasks, the few that are as frequent as the sketch says go to all tasks, and they are not exchanged.
The document is then hashed again, the flags go back to their windows, and windows merge into maximal intervals.

Hashes have 56 bits beside the part of the space they are in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.llm import keyed
from probelens.llm.store import parts_of, small_batches
from probelens.llm.words import SPACES, Words, ranges, slices

WIDTH = 50
#: How far above twice the mean of the sketch's buckets a window is frequent.
FREQUENT = 1000
KEY_BYTES = 7

#: __id: the document's id; __hash: tells rows of one id with different texts apart.
_OWNER = np.dtype([("__id", "<i8"), ("__hash", "<i8")])
_LAST = (1 << 63) - 1


def owners_of(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(len(batch), _OWNER)
    out["__id"], out["__hash"] = batch.column("__id").to_numpy(), batch.column("__hash").to_numpy()
    return out


class Frequent:
    """Frequent windows with the smallest id of each; fewer than half of the sketch's buckets."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each window is frequent, and where it is here."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[at] == hashes, at


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(keyed.SKETCH, np.int64)
        for batch in slices(batches, "__text"):
            counts += np.bincount(keyed.bucket_of(Words(batch.column("__text"), SPACES).windows(width)[0]), minlength=keyed.SKETCH)
        if counts.any():
            yield keyed.sketch_slices(counts)

    return run


_CANDIDATES = "part INT, keys BINARY, n BINARY, ids BINARY"


def _least(keys: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their sums and smallest ids."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n, np.minimum.reduceat(ids[order], first) if len(first) else ids


def _packed(parts: np.ndarray, keys: np.ndarray, n: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    rows = [(int(p), keys[m].tobytes(), n[m].tobytes(), ids[m].tobytes()) for p in np.unique(parts) for m in [parts == p]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "keys", "n", "ids"])


def frequent_windows(texts: DataFrame, width: int, parts: int, above: int) -> Frequent:
    """Windows that occur more often than the sketch's limit."""
    spark = texts.sparkSession
    full, limit = keyed.crowded(texts.mapInArrow(_sketch(width), keyed.SKETCHES), above)
    if not full.any():
        return Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    shared = spark.sparkContext.broadcast(full)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            hashes, counts = Words(batch.column("__text"), SPACES).windows(width)
            keep = shared.value[keyed.bucket_of(hashes)]
            if keep.any():
                ids = np.repeat(batch.column("__id").to_numpy(), counts)[keep]
                keys, n, ids = _least(hashes[keep], np.ones(len(ids), np.int64), ids)
                yield _packed(keyed.part_of(keys, parts), keys, n, ids)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("keys", "n", "ids")))]
        if rows:
            keys, n, ids = _least(*(np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate(("<u8", "<i8", "<i8"))))
            often = n > limit
            if often.any():
                yield _packed(np.zeros(int(often.sum()), np.int32), keys[often], n[often], ids[often])

    met = texts.mapInArrow(candidates, _CANDIDATES).repartitionById(parts, F.col("part"))
    found = met.mapInArrow(frequent, _CANDIDATES).collect()
    shared.unpersist()
    return Frequent(*(np.concatenate([np.frombuffer(r[c], t) for r in found] or [np.zeros(0, t)]) for c, t in (("keys", "<u8"), ("ids", "<i8"))))


def _deal(width: int, parts: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            hashes, counts = Words(batch.column("__text"), SPACES).windows(width)
            rare = ~frequent.value.of(hashes)[0]
            if rare.any():
                counts = np.bincount(np.repeat(np.arange(len(batch)), counts)[rare], minlength=len(batch))
                yield keyed.deal(hashes[rare], counts, owners_of(batch), parts, KEY_BYTES)

    return run


def _flag(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in keyed.parts(batches, _OWNER, KEY_BYTES):
            order = np.argsort(part.keys)
            keys = part.keys[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            ids = part.owners["__id"][part.entry]
            smallest = np.minimum.reduceat(ids[order], first)
            repeated = np.empty(len(keys), np.uint8)
            repeated[order] = ids[order] > np.repeat(smallest, np.diff(np.append(first, len(keys))))
            _, entries = np.unique(part.owners, return_index=True)  # repeated rows answer once
            some = entries[np.add.reduceat(repeated, part.offsets[:-1], dtype=np.int64)[entries] > 0]
            n = part.counts[some]
            yield from keyed.answers(part.part, part.owners[some], n, repeated[np.repeat(part.offsets[some], n) + ranges(n)], parts)

    return run


def covered_words(repeated: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """For each word, whether a repeated window covers it."""
    opened = np.zeros(n_words + 1, np.int64)
    opened[: len(repeated)] += repeated
    opened[width : width + len(repeated)] -= repeated
    return np.cumsum(opened)[:n_words] > 0


def intervals(covered: np.ndarray) -> list[dict]:
    """Runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


_OUT = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
_OUT_SQL = "n_words BIGINT, n_removed BIGINT, kept STRING, removed ARRAY<STRUCT<start: INT, end: INT>>"


def _cut(width: int, parts: int, frequent):
    def repeated(doc: int, answer: dict, hashes: np.ndarray) -> np.ndarray:
        often, at = frequent.value.of(hashes)
        out = np.zeros(len(hashes), np.int64)
        out[~often] = keyed.placed(answer if answer["found"] is not None else None, hashes[~often], parts, 0)
        out[often] = doc > frequent.value.ids[at[often]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            flags, rows = batch.select(["parts", "counts", "found"]).to_pylist(), []
            marked = [i for i, f in enumerate(flags) if f["found"] is not None or len(frequent.value.keys)]
            ids = batch.column("__id").to_pylist()
            found = {}
            if marked:
                some = Words(batch.column("__text").take(pa.array(marked)), SPACES)
                hashes, counts = some.windows(width)
                ends = np.cumsum(counts)
                for i, n, end, words in zip(marked, counts, ends, some.counts):
                    drop = covered_words(repeated(ids[i], flags[i], hashes[end - n : end]), int(words), width)
                    if drop.any():
                        found[i] = drop
            for i, text in enumerate(batch.column("__text").to_pylist()):
                words = [w.decode() for w in (text or "").encode().split()]
                if i in found:
                    drop = found[i]
                    kept = [w for w, d in zip(words, drop.tolist()) if not d]
                    rows.append((len(words), len(words) - len(kept), " ".join(kept), intervals(drop)))
                else:
                    rows.append((len(words), 0, " ".join(words), []))
            made = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _OUT)]
            yield pa.RecordBatch.from_arrays([*batch.columns[5:], *made], names=[*batch.schema.names[5:], *(n for n, _ in _OUT)])

    return run


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the `carry` columns, n_words, n_removed, kept (the other words, joined by one space)
    and removed (maximal intervals of word positions).

    A window counts as repeated if its words also start in a document with a smaller id; repeats inside one
    document stay, and so does the copy in the document with the smallest id. Null text has no words. A null id
    comes after all others. Rows that repeat an id are one document for this purpose, so none of them removes from
    another. Windows are judged on the input, not on what is left. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts_of(spark)
    kept = [f"__kept_{i}" for i in range(len(carry))]
    keyed_docs = docs.select(*[F.col(c).alias(k) for c, k in zip(carry, kept)], F.coalesce(F.col(doc_id), F.lit(_LAST)).alias("__id"), F.xxhash64(text).alias("__hash"), F.col(text).alias("__text"))
    texts = keyed_docs.select("__id", "__hash", "__text")
    frequent = spark.sparkContext.broadcast(frequent_windows(texts, width, parts, FREQUENT))
    dealt = texts.mapInArrow(_deal(width, parts, frequent), keyed.SCHEMA)
    sent = keyed.by_part(dealt, parts).mapInArrow(_flag(parts), keyed.ANSWERS)
    flags = keyed.gathered(sent, parts, _OWNER)
    joined = keyed_docs.join(flags, ["__id", "__hash"], "left").select("__id", "__text", "parts", "counts", "found", *[f"`{c}`" for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[5:]] + [_OUT_SQL])
    out = joined.mapInArrow(_cut(width, parts, frequent), schema)
    return out.withColumnsRenamed(dict(zip(kept, carry)))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_CLASS = r" \t\n\x0B\f\r"
#: For small tables: every window is a row.
SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[{_CLASS}]+'), lambda x: x <> '') AS words FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + {WIDTH - 1}], ' ')) AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WIDTH - 2})) AS i FROM d WHERE len(words) >= {WIDTH})),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE doc_id > least),
covered AS (SELECT DISTINCT doc_id, i + o AS j FROM hit, range(0, {WIDTH}) r(o)),
w AS (SELECT doc_id, generate_subscripts(words, 1) AS j, unnest(words) AS word FROM d),
kept AS (
  SELECT doc_id, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY w.j) FILTER (WHERE c.j IS NULL) AS kept
  FROM w LEFT JOIN covered c USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
