"""Exchange of many small keys between documents, packed.

One row per key would cost far more than the key. `deal` puts the keys of a batch of documents that fall into the
same part of the hash space into one row of packed arrays; Spark shuffles those rows by part; the receiving task
sees every occurrence of each of its keys. The memory of a task is the keys of one part, so the number of parts
(spark.sql.shuffle.partitions) has to grow with the input as for any other shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.llm.words import give_back, mix, ranges

SCHEMA = "part INT, owners BINARY, counts BINARY, keys BINARY, extra BINARY"
_ARROW = pa.schema([("part", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("extra", pa.binary())])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: its top 32 bits scaled down."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def narrow(keys: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each key; the part stands for some of the rest."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widen(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def deal(keys: np.ndarray, counts: np.ndarray, owners: np.ndarray, parts: int, width: int = 8, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of SCHEMA for one batch. keys: of all documents joined; counts: keys of each document;
    owners: what names each document (any fixed-width dtype); extra: a value for each key.

    Within a part, the keys of a document keep their order.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    rows = {name: [] for name in _ARROW.names}
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[p] : cuts[p + 1]]
        who, n = np.unique(owner[own], return_counts=True)  # owners ascend within a part
        rows["part"].append(p)
        rows["owners"].append(owners[who].tobytes())
        rows["counts"].append(n.astype("<u4").tobytes())
        rows["keys"].append(narrow(keys[own], width))
        rows["extra"].append(None if extra is None else extra[own].tobytes())
    return pa.RecordBatch.from_pydict(rows, _ARROW)


def by_part(dealt: DataFrame, parts: int) -> DataFrame:
    """All rows of a part in one task."""
    return dealt.repartitionById(parts, F.col("part"))


class Part:
    """Everything that was dealt to one part. offsets: where each entry's keys begin; an entry is a document's
    share in one row."""

    def __init__(self, part: int, rows: list[tuple], owner_type: np.dtype, width: int, extra_type: np.dtype | None):
        """`rows` is emptied."""
        self.part = part
        self.owners = np.concatenate([np.frombuffer(r[0], owner_type) for r in rows])
        self.counts = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows]).astype(np.int64)
        self.keys = np.concatenate([widen(r[2], width) for r in rows])
        self.extra = None if extra_type is None else np.concatenate([np.frombuffer(r[3], extra_type) for r in rows])
        rows.clear()
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))
        self.entry = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)


def parts(batches: Iterator[pa.RecordBatch], owner_type: np.dtype, width: int = 8, extra_type: np.dtype | None = None) -> Iterator[Part]:
    """The parts of a task that holds whole parts."""
    seen: dict[int, list[tuple]] = {}
    for batch in batches:
        columns = batch.to_pydict()
        for p, *row in zip(*(columns[n] for n in _ARROW.names)):
            seen.setdefault(p, []).append(tuple(row))
    while seen:
        p, rows = seen.popitem()
        yield Part(p, rows, owner_type, width, extra_type)
    give_back()


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from joined bytes and the offsets of each value."""
    if int(offsets[-1]) < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    raise ValueError("more than 2 GiB in one batch")


# Answers: what a part found for its documents, sent back to them. They travel packed as well, by a hash of the owner
# (two 64-bit fields), and come out as one row per owner.

ANSWERS = "bucket INT, part INT, owners BINARY, counts BINARY, found BINARY"
_ANSWERS_ARROW = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("found", pa.binary())])
GATHERED = "parts BINARY, counts BINARY, found BINARY"


def answers(part: int, owners: np.ndarray, counts: np.ndarray, found: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of ANSWERS: counts: bytes of `found` that each owner gets."""
    a, b = (owners[n].view(np.uint64) for n in owners.dtype.names)
    bucket = part_of(mix(a ^ mix(b)), parts)
    order = np.argsort(bucket, kind="stable")
    n, offsets = counts[order], (np.cumsum(counts) - counts)[order]
    data, ends = found[np.repeat(offsets, n) + ranges(n)], np.concatenate(([0], np.cumsum(n)))
    cuts = np.searchsorted(bucket[order], np.arange(parts + 1))
    rows = {name: [] for name in _ANSWERS_ARROW.names}
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        low, high = cuts[k], cuts[k + 1]
        for name, value in zip(rows, (k, part, owners[order[low:high]].tobytes(), n[low:high].astype("<u4").tobytes(), data[ends[low] : ends[high]].tobytes())):
            rows[name].append(value)
    if rows["bucket"]:
        yield pa.RecordBatch.from_pydict(rows, _ANSWERS_ARROW)


def gathered(sent: DataFrame, parts: int, owner_type: np.dtype) -> DataFrame:
    """One row per owner: its two fields, the parts that answered, how much each gave, and what, joined."""
    names = owner_type.names
    schema = f"`{names[0]}` BIGINT, `{names[1]}` BIGINT, {GATHERED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(n).to_pylist() for n in _ANSWERS_ARROW.names[1:]))]
        if not rows:
            return
        owners = np.concatenate([np.frombuffer(r[1], owner_type) for r in rows])
        counts = [np.frombuffer(r[2], "<u4").astype(np.int64) for r in rows]
        part = np.repeat([r[0] for r in rows], [len(c) for c in counts]).astype("<i4")
        counts, found = np.concatenate(counts), np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows])
        order = np.lexsort((part, owners[names[1]], owners[names[0]]))
        offsets = (np.cumsum(counts) - counts)[order]
        owners, counts, part = owners[order], counts[order], part[order]
        first = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
        for low in range(0, len(first), 2000):
            starts = first[low : low + 2000]
            end = first[low + 2000] if low + 2000 < len(first) else len(owners)
            n = counts[starts[0] : end]
            bounds = np.append(starts, end) - starts[0]
            data = found[np.repeat(offsets[starts[0] : end], n) + ranges(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners[names[0]][starts]), pa.array(owners[names[1]][starts]), binary_array(part[starts[0] : end].view(np.uint8), 4 * bounds),
                 binary_array(n.astype("<u4").view(np.uint8), 4 * bounds), binary_array(data, np.concatenate(([0], np.cumsum(n)))[bounds])],
                names=[*names, "parts", "counts", "found"])

    return sent.repartitionById(parts, F.col("bucket")).mapInArrow(run, schema)


def placed(answer: dict | None, keys: np.ndarray, parts: int, default: int) -> np.ndarray:
    """The value of each of a document's keys, from its gathered answers of one byte a key."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
    ordered = np.full(len(keys), default, np.int64)
    if answer:
        at = 0
        found = np.frombuffer(answer["found"], np.uint8)
        for p, n in zip(np.frombuffer(answer["parts"], "<i4").tolist(), np.frombuffer(answer["counts"], "<u4").tolist()):
            ordered[offsets[p] : offsets[p] + n] = found[at : at + n]
            at += n
    out = np.empty(len(keys), np.int64)
    out[order] = ordered
    return out


# A sketch of how often keys occur: counts in a fixed number of buckets, so what the driver gets and sends is bounded.

SKETCH = 1 << 18
_SLICES = 64
SKETCHES = "part INT, sketch BINARY"


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(SKETCH - 1)).astype(np.int64)


def sketch_slices(counts: np.ndarray) -> pa.RecordBatch:
    """A task's counts of all buckets, as rows of SKETCHES."""
    slices = [c.tobytes() for c in counts.reshape(_SLICES, -1)]
    return pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(slices, pa.binary())], names=["part", "sketch"])


def crowded(slices: DataFrame, above: int) -> tuple[np.ndarray, int]:
    """Which buckets hold more than twice the mean and `above`, and that limit. Fewer than SKETCH / 2 keys can
    occur more often than it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("sketch").to_pylist()):
                counts = np.frombuffer(data, np.int64)
                sums[part] = sums[part] + counts if part in sums else counts
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "sketch"])

    rows = slices.select("part", "sketch").mapInArrow(add, SKETCHES).repartition(8, "part").mapInArrow(add, SKETCHES).collect()
    counts = np.zeros(SKETCH, np.int64)
    for part, data in rows:
        counts.reshape(_SLICES, -1)[part] = np.frombuffer(data, np.int64)
    limit = int(2 * counts.mean() + above)
    return counts > limit, limit
