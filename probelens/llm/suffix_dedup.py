"""Removal of byte strings that occur more than once, by suffix arrays over shards of the corpus.

A string of `width` bytes belongs to the shard of its minimizer, the least of its shorter strings of K bytes in a fixed
pseudo-random order, so equal strings meet in one shard. Neighbouring strings with the same minimizer make one stretch.
Strings of K bytes that a large share of the corpus has (found by a sketch) come last in that order; a stretch of near copies that
differ is therefore dealt by where they differ.

1. Chunks of documents send the hashes of their distinct stretches, by minimizer. A minimizer that occurs once has no
   repeated string; of the others, one chunk is asked for the bytes of each distinct stretch.
2. Each part sorts its different stretches, with how often each occurs, in shards: induced sorting gives the suffix array, and the
   permuted common prefixes tell which strings of `width` bytes occur twice.
3. What is repeated goes back to every chunk that has the stretch, and overlapping strings merge into spans.

Texts are exchanged once, by chunk; all else is hashes, flags and one copy of each stretch whose minimizer repeats. Results
are found by value, so a chunk that is read again in another order gives the same. Stretches are told apart by 128 bits of hash;
whether strings are equal is decided on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.llm import keyed
from probelens.llm.store import parts_of, small_batches
from probelens.llm.suffix_array import permuted_prefixes, suffix_array
from probelens.llm.words import Powers, mix, ranges

WIDTH = 200
#: Bytes of the strings that minimizers are chosen from.
K = 48
#: Bytes of text in a chunk, of which a task holds one at a time, and of a shard that is sorted at once.
CHUNK_BYTES = 2 << 20
SHARD_BYTES = 2 << 20
#: How far above twice the mean of the sketch's buckets a string of K bytes is frequent.
FREQUENT = 1000

_PIECE = 1 << 19
_POSITION = np.uint64((1 << 20) - 1)
_POWERS = Powers()
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_DEALT = "part INT, chunk BIGINT, m BINARY, h BINARY, n BINARY"
_ASKED = "chunk BIGINT, keys BINARY, copies BINARY"
_STRETCHES = "part INT, chunk BIGINT, m BINARY, h BINARY, copies BINARY, lengths BINARY, data BINARY"
_FLAGS = "chunk BIGINT, keys BINARY, bits BINARY"


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _POWERS.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins and ends."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]


def _pieces(offsets: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position, offsets from there) of pieces of about _PIECE bytes: several texts, or a part of a longer one, which has
    all windows that begin in it."""
    at = 0
    while at < len(offsets) - 1:
        low = int(offsets[at])
        to = int(np.searchsorted(offsets, low + _PIECE, side="right")) - 1
        if to > at:
            yield low, offsets[at : to + 1] - low
            at = to
        else:
            high = int(offsets[at + 1])
            for begin in range(low, high, _PIECE):
                yield begin, np.array([0, min(begin + _PIECE + width - 1, high) - begin])
            at += 1


def _hashes(buf: np.ndarray, low: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers of a piece, and the hash of every string of K bytes, across texts too."""
    sums, down = _sums(buf[low : low + int(offsets[-1])])
    n = len(sums) - K
    return sums, down, mix((sums[K:] - sums[:-K]) * down[:n]) if n > 0 else np.zeros(0, np.uint64)


class Stretches:
    """The stretches of a chunk. start: where the first window begins; windows: how many; m: hash of the minimizer
    (mixed again, as minimizers are small in their order); h: hash of the bytes; key: one value for both, for look-ups inside a chunk."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, width: int):
        found = [self._of(buf, low, at, frequent, width) for low, at in _pieces(offsets, width)]
        empty = np.zeros(0, np.int64)
        self.start, self.windows, self.m, self.h = (np.concatenate(c) for c in zip(*found)) if found else (empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
        self.key = mix(self.m ^ mix(self.h))

    @staticmethod
    def _of(buf, low, offsets, frequent, width):
        n_windows = int(offsets[-1]) - width + 1
        sums, down, grams = _hashes(buf, low, offsets)
        if n_windows <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), grams[:0], grams[:0]
        edges = np.zeros(n_windows + 1, np.int8)
        long = np.diff(offsets) >= width
        edges[offsets[:-1][long]] += 1
        edges[offsets[1:][long] - width + 1] -= 1
        valid = np.cumsum(edges[:n_windows], dtype=np.int8) > 0
        least = (grams >> np.uint64(1)) | (frequent[keyed.bucket_of(grams)].astype(np.uint64) << np.uint64(63))
        least = (least & ~_POSITION) | np.arange(len(least), dtype=np.uint64)
        span, step = width - K + 1, 1
        while step * 2 <= span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if span > step:
            least = np.minimum(least[: step - span], least[span - step :])
        at = (least & _POSITION).astype(np.int64)
        new = valid & np.concatenate(([True], (at[1:] != at[:-1]) | ~valid[:-1]))
        start = np.flatnonzero(new)
        cuts = np.flatnonzero(np.concatenate((new | ~valid, [True])))
        windows = cuts[np.searchsorted(cuts, start) + 1] - start if len(start) else start
        end = start + windows + width - 1
        return start + low, windows, mix(grams[at[start]]), mix((sums[end] - sums[start]) * down[start] + windows.astype(np.uint64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(keyed.SKETCH, np.int64)
    for batch in batches:
        buf, offsets = _joined(batch.column("__text"))
        for low, at in _pieces(offsets, K):
            counts += np.bincount(keyed.bucket_of(_hashes(buf, low, at)[2]), minlength=keyed.SKETCH)
    if counts.any():
        yield keyed.sketch_slices(counts)


def _rows(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The members of each part."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, order[cuts[p] : cuts[p + 1]]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"INT": pa.int32(), "BIGINT": pa.int64(), "BINARY": pa.binary()}
    fields = [(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _deal(width: int, parts: int, frequent):
    def run(key: tuple, texts: pa.Table) -> pa.Table:
        found = Stretches(*_joined(texts.column("__text").combine_chunks()), frequent.value, width)
        order = np.argsort(found.key)
        key_sorted = found.key[order]
        first = np.flatnonzero(np.concatenate(([True], key_sorted[1:] != key_sorted[:-1]))) if len(order) else order
        n = np.minimum(np.diff(np.append(first, len(order))), 2).astype(np.uint8)
        m, h = found.m[order[first]], found.h[order[first]]
        chunk = key[0].as_py()
        return _table([(p, chunk, m[i].tobytes(), h[i].tobytes(), n[i].tobytes()) for p, i in _rows(keyed.part_of(m, parts), parts)], _DEALT)

    return run


class _Part:
    """What was dealt to one part: rows of (chunk, m, h, ...), their entries joined and in order of m, h and chunk."""

    def __init__(self, rows: list[dict]):
        self.chunk_ids = np.array([r["chunk"] for r in rows], np.int64)
        m, h = (np.frombuffer(b"".join(r[c] for r in rows), np.uint64) for c in ("m", "h"))
        row = np.repeat(np.arange(len(rows)), [len(r["m"]) // 8 for r in rows])
        self.order = np.lexsort((self.chunk_ids[row], h, m))
        self.row, self.m, self.h = row[self.order], m[self.order], h[self.order]
        other = np.concatenate(([True], self.m[1:] != self.m[:-1]))
        self.group = np.cumsum(other) - 1  # of equal minimizers
        self.stretch = np.cumsum(other | np.concatenate(([True], self.h[1:] != self.h[:-1]))) - 1
        self.first = np.flatnonzero(np.concatenate(([True], self.stretch[1:] != self.stretch[:-1])))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part | list]:
    """Rows of a task by part."""
    seen: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            seen.setdefault(row["part"], []).append(row)
    while seen:
        yield seen.popitem()[1]


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk: its stretches with repeated minimizers, and how often it is to send their bytes (0: another does)."""
    for rows in _by_part(batches):
        part = _Part(rows)
        n = np.frombuffer(b"".join(r["n"] for r in rows), np.uint8)[part.order].astype(np.int64)
        repeated = np.bincount(part.group, n)[part.group] > 1
        copies = np.zeros(len(n), np.uint8)
        copies[part.first] = np.minimum(np.add.reduceat(n, part.first), 2)
        keys = mix(part.m ^ mix(part.h))
        at = np.flatnonzero(repeated)
        out = [(int(part.chunk_ids[r]), keys[at[i]].tobytes(), copies[at[i]].tobytes()) for r, i in _rows(part.row[at], len(rows))]
        yield from _table(out, _ASKED).to_batches()


def _looked_up(found: Stretches, answers: pa.Table, column: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which stretches have an answer, and those answers (rows of `width` bytes)."""
    keys = np.frombuffer(b"".join(answers.column("keys").to_pylist()), np.uint64)
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros((0, width), np.uint8)
    values = np.frombuffer(b"".join(answers.column(column).to_pylist()), np.uint8).reshape(-1, width)
    order = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys[order], found.key), len(keys) - 1)
    hit = np.flatnonzero(keys[order][at] == found.key)
    return hit, values[order[at[hit]]]


def _send(width: int, parts: int, frequent):
    def run(key: tuple, texts: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not texts.num_rows:
            return _table([], _STRETCHES)
        buf, offsets = _joined(texts.column("__text").combine_chunks())
        found = Stretches(buf, offsets, frequent.value, width)
        hit, copies = _looked_up(found, asked, "copies", 1)
        _, once = np.unique(found.key[hit], return_index=True)
        hit, copies = hit[once], copies[once, 0]
        m, h, start = found.m[hit], found.h[hit], found.start[hit]
        lengths = np.where(copies > 0, found.windows[hit] + width - 1, 0)
        rows, chunk = [], key[0].as_py()
        for p, i in _rows(keyed.part_of(m, parts), parts):
            data = buf[np.repeat(start[i], lengths[i]) + ranges(lengths[i])]
            rows.append((p, chunk, m[i].tobytes(), h[i].tobytes(), copies[i].tobytes(), lengths[i].astype("<u4").tobytes(), data.tobytes()))
        return _table(rows, _STRETCHES)

    return run


def repeated_windows(data: np.ndarray, lengths: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """For different stretches joined in `data`, which occur `weights` times: which of their windows occur twice or more, as a row of
    packed bits for each. Windows are equal where a run of the suffix array has a common prefix of `width`; the weights of a run
    add up. A stretch has so many windows at most as a row has bits."""
    starts = np.cumsum(lengths + 1) - lengths - 1  # one symbol less than all others ends a stretch
    text = np.zeros(int((lengths + 1).sum()), np.int32)
    text[np.repeat(starts, lengths) + ranges(lengths)] = data
    text[np.repeat(starts, lengths) + ranges(lengths)] += 1
    order = suffix_array(text, 257)
    common, before = permuted_prefixes(text, order)
    longest = common.copy()
    has = before >= 0
    longest[before[has]] = np.maximum(longest[before[has]], common[has])
    n = lengths - width + 1
    at = np.repeat(starts, n) + ranges(n)
    bits = np.zeros((len(lengths), 8 * _flag_bytes(width)), np.uint8)
    # windows don't reach the end of a stretch
    bits[np.repeat(np.arange(len(lengths)), n), ranges(n)] = (longest[at] >= width) | np.repeat(weights > 1, n)
    return np.packbits(bits, axis=1)


def _flag_bytes(width: int) -> int:
    return (width - K + 1 + 7) // 8


def _sort(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            part = _Part(rows)
            copies, lengths = (np.frombuffer(b"".join(r[c] for r in rows), t).astype(np.int64) for c, t in (("copies", np.uint8), ("lengths", "<u4")))
            data = np.frombuffer(b"".join(r.pop("data") for r in rows), np.uint8)
            offsets = np.cumsum(lengths) - lengths
            sender = part.order[copies[part.order] > 0]  # one for each stretch, in order of minimizers
            group = part.group[copies[part.order] > 0]
            stretch = part.stretch[copies[part.order] > 0]
            flags = np.zeros((int(part.stretch[-1]) + 1, _flag_bytes(width)), np.uint8)
            # shards: whole groups of equal minimizers
            size = np.cumsum(lengths[sender] + 1)
            last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
            shard = np.repeat(size[last] // SHARD_BYTES, np.diff(np.concatenate(([-1], last))))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(sender)]))
            for low, high in zip(cuts[:-1], cuts[1:]):
                some = sender[low:high]
                own = data[np.repeat(offsets[some], lengths[some]) + ranges(lengths[some])]
                flags[stretch[low:high]] = repeated_windows(own, lengths[some], copies[some], width)
            told = np.flatnonzero(flags.any(axis=1)[part.stretch])
            keys = mix(part.m ^ mix(part.h))
            out = [(int(part.chunk_ids[r]), keys[told[i]].tobytes(), flags[part.stretch[told[i]]].tobytes()) for r, i in _rows(part.row[told], len(rows))]
            yield from _table(out, _FLAGS).to_batches()

    return run


_OUT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
_OUT_SQL = "n_bytes BIGINT, n_removed BIGINT, kept BINARY, removed ARRAY<STRUCT<start: BIGINT, end: BIGINT>>"


def _cut(width: int, frequent):
    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        buf, offsets = _joined(texts.column("__text").combine_chunks()) if texts.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        edges = np.zeros(len(buf) + 1, np.int32)
        if flags.num_rows:
            found = Stretches(buf, offsets, frequent.value, width)
            hit, bits = _looked_up(found, flags, "bits", _flag_bytes(width))
            n = found.windows[hit]
            start = (np.repeat(found.start[hit], n) + ranges(n))[np.unpackbits(bits, axis=1)[np.repeat(np.arange(len(hit)), n), ranges(n)] > 0]
            edges[start] += 1  # windows begin at different bytes, but one may end where another begins
            np.subtract.at(edges, start + width, 1)
        covered = np.cumsum(edges[:-1]) > 0
        removed = np.concatenate(([0], np.cumsum(covered)))[offsets]
        inner = np.zeros(len(buf) + 1, bool)
        inner[offsets] = True
        opens = np.flatnonzero(covered & (inner[:-1] | ~np.concatenate(([False], covered[:-1]))))
        closes = np.flatnonzero(covered & (inner[1:] | ~np.concatenate((covered[1:], [False])))) + 1
        doc = np.searchsorted(offsets, opens, side="right") - 1
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(doc, np.arange(len(offsets))), pa.int32()),
            pa.StructArray.from_arrays([pa.array(opens - offsets[doc]), pa.array(closes - offsets[doc])], ["start", "end"]),
        )
        kept_at = offsets - removed
        kept = keyed.binary_array(buf[~covered], kept_at)
        made = [pa.array(np.diff(offsets)), pa.array(np.diff(removed)), kept, spans]
        carried = texts.column_names[2:]
        return pa.table([*(texts.column(c) for c in carried), *(a.cast(t) for a, (_, t) in zip(made, _OUT))], names=[*carried, *(n for n, _ in _OUT)])

    return run


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, carry: Sequence[str] = ("doc_id",), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: the `carry` columns, then n_bytes, n_removed, kept (the other bytes, joined) and removed (maximal runs
    of byte positions in UTF-8).

    A byte is removed if it lies in a string of `width` bytes that also starts elsewhere, in another row or in the same one,
    overlapping or not; all copies go. Matches do not cross rows, and strings are judged on the input. Null text counts as
    empty; null and repeated ids are rows like others, so repeated rows of `width` bytes or more lose everything. Texts
    shorter than `width` stay whole. `carry` columns must not be named like an output (ValueError). Other columns are ignored.
    `width` is K at least.
    """
    clash = {n for n, _ in _OUT} & set(carry)
    if clash or width < K:
        raise ValueError(f"carried columns named like outputs: {sorted(clash)}" if clash else f"width is below {K}")
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts_of(spark)
    sketch = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(_sketch, keyed.SKETCHES)
    frequent = spark.sparkContext.broadcast(keyed.crowded(sketch, FREQUENT)[0])
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    kept = [f"__kept_{i}" for i in range(len(carry))]
    chunk = F.pmod(F.xxhash64(doc_id, text), F.lit(size // chunk_bytes + 1))
    texts = docs.select(chunk.alias("__chunk"), F.coalesce(F.col(text), F.lit("")).alias("__text"), *[F.col(c).alias(k) for c, k in zip(carry, kept)])
    dealt = texts.groupBy("__chunk").applyInArrow(_deal(width, parts, frequent), _DEALT)
    asked = dealt.repartitionById(parts, F.col("part")).mapInArrow(_ask, _ASKED).withColumnRenamed("chunk", "__chunk")
    sent = texts.groupBy("__chunk").cogroup(asked.groupBy("__chunk")).applyInArrow(_send(width, parts, frequent), _STRETCHES)
    flags = sent.repartitionById(parts, F.col("part")).mapInArrow(_sort(width), _FLAGS).withColumnRenamed("chunk", "__chunk")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[2:]] + [_OUT_SQL])
    out = texts.groupBy("__chunk").cogroup(flags.groupBy("__chunk")).applyInArrow(_cut(width, frequent), schema)
    return out.withColumnsRenamed(dict(zip(kept, carry)))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: For small tables: every string of bytes is a row.
SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, md5(b[i:i + {WIDTH - 1}]) AS k FROM (SELECT doc_id, b, unnest(range(1, n - {WIDTH - 2})) AS i FROM d WHERE n >= {WIDTH})),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
edge AS (SELECT doc_id, i, lag(i) OVER w AS p, lead(i) OVER w AS q FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
opens AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM edge WHERE p IS NULL OR i > p + {WIDTH}),
closes AS (SELECT doc_id, i + {WIDTH} AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM edge WHERE q IS NULL OR q > i + {WIDTH}),
spans AS (SELECT doc_id, s, i, e FROM opens JOIN closes USING (doc_id, s)),
removed AS (SELECT doc_id, sum(e - i)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY doc_id),
gaps AS (
  SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS a, i AS z FROM spans
  UNION ALL SELECT doc_id, 1000000000, coalesce(max(e), 1), max(n) + 1 FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN z > a THEN hex(b[a:z - 1]) ELSE '' END, '' ORDER BY s) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
