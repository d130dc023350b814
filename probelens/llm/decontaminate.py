"""Benchmark decontamination: occurrences of test passages in documents, by one Aho-Corasick automaton.

Questions and answers are normalised (A-Z lower-cased, everything in ASCII that is no letter or digit separates
words) and cut into windows of `width` consecutive words; a shorter item is one window. The automaton holds every
window with a space on both sides, so that it matches whole words only. Each document is normalised in the same
way and scanned once; a match's end gives the word it ends at, and word positions map back to the original text.

Documents never move: the windows go to the tasks. They come from the benchmark in blocks of at most
`block_bytes` of text, one automaton for each; a benchmark of one block takes one pass over the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.llm.store import small_batches, written
from probelens.llm.words import NOT_ALNUM, Words, slices

WIDTH = 10
BLOCK_BYTES = 16 << 20

_NORMAL = bytes(0x20 if b in NOT_ALNUM else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

OUTPUT = "n_words BIGINT, hits ARRAY<STRUCT<start: INT, end: INT>>, spans ARRAY<STRUCT<start: INT, end: INT>>, items ARRAY<STRING>"
_RANGE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ARROW = [("n_words", pa.int64()), ("hits", _RANGE), ("spans", _RANGE), ("items", pa.list_(pa.string()))]


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


def automaton_of(items: Sequence[tuple[str, str]], width: int) -> ahocorasick.Automaton | None:
    """All windows of (item id, text) pairs; each leads to its length in words and the items that have it."""
    windows: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        words = normal_words(text)
        for i in range(max(len(words) - width, 0) + 1 if words else 0):
            window = words[i : i + width]
            windows.setdefault(b" " + b" ".join(window) + b" ", (len(window), set()))[1].add(item)
    if not windows:
        return None
    automaton = ahocorasick.Automaton()
    for pattern, value in windows.items():
        automaton.add_word(pattern.decode("latin-1"), value)
    automaton.make_automaton()
    return automaton


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one, in order."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def scan(normal: bytes, automaton: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges that are hit, and the items, of a text whose words are joined by one space, one at each end."""
    ends, lengths, items = [], [], set()
    for end, (n, who) in automaton.iter(normal.decode("latin-1")):
        ends.append(end)
        lengths.append(n)
        items |= who
    if not ends:
        return [], items
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 0x20)
    last = np.searchsorted(spaces, ends)  # the space after word i is the (i+1)st
    return merged([(int(k) - n, int(k)) for k, n in zip(last, lengths)]), items


def original_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character ranges of the original text."""
    if not hits:
        return []
    words, raw = Words(pa.array([text]), NOT_ALNUM, hashed=False), text.encode()
    ends = [(int(words.starts[a]), int(words.ends[b - 1])) for a, b in hits]
    return [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in ends]


def _pass(docs: DataFrame, text: str, items, width: int, carry: Sequence[str]) -> DataFrame:
    rows = docs.select(*carry, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [OUTPUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(items.value, width)
        for batch in slices(batches, "__text"):
            out = []
            for text in batch.column("__text").to_pylist():
                words = normal_words(text or "")
                hits, who = scan(b" " + b" ".join(words) + b" ", automaton) if automaton and words else ([], set())
                out.append((len(words), hits, original_spans(text, hits), sorted(who)))
            columns = list(zip(*out))
            ranges = [[[{"start": a, "end": b} for a, b in r] for r in c] for c in columns[1:3]]
            made = [pa.array(c, t) for c, (_, t) in zip((columns[0], *ranges, columns[3]), _ARROW)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *(n for n, _ in _ARROW)])

    return rows.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  width: int = WIDTH, carry: Sequence[str] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: the `carry` columns, n_words, hits (word ranges), spans (character ranges of the
    original text) and items (ids as strings, sorted).

    Null or empty texts have no words; items without words or with null text match nothing; an item without id
    goes by the empty string; rows of one item id count as one item; repeated documents give repeated rows. An
    empty benchmark hits nothing. Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    block = F.pmod(F.xxhash64("item", "t"), F.lit(blocks))

    def windows_of(b: int):
        return spark.sparkContext.broadcast([tuple(r) for r in items.where(block == b).collect()])

    if blocks == 1:
        return _pass(docs, text, windows_of(0), width, carry)
    kept = [f"__kept_{i}" for i in range(len(carry))]
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), *[F.col(c).alias(k) for c, k in zip(carry, kept)], F.col(text).alias("__whole"))
    rows, found = written(rows, "documents"), None  # a row is the same one in all passes
    for b in range(blocks):  # a pass for each block of items; what a pass found is written
        hits = written(_pass(rows, "__whole", windows_of(b), width, ["__row"]), "contamination")
        found = hits if found is None else found.unionAll(hits)
    merged_rows = found.groupBy("__row").agg(F.first("n_words").alias("n_words"), *(_joined(c) for c in ("hits", "spans")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.drop("__whole").join(merged_rows, "__row").select(*[F.col(k).alias(c) for c, k in zip(carry, kept)], "n_words", "hits", "spans", "items")


def _joined(name: str):
    """The union of ranges from several passes."""
    merge = "aggregate(array_sort(flatten(collect_list({0}))), cast(array() as array<struct<start:int,end:int>>), (acc, x) -> CASE WHEN size(acc) > 0 AND x.start <= element_at(acc, -1).end THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))) ELSE concat(acc, array(x)) END)"
    return F.expr(merge.format(name)).alias(name)


def items_digest(items: Sequence[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: For small tables: every window of a document that is as long as an item's is a row.
SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '{_NO_WORD}'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex({_LOWER}, '{_NO_WORD}'), lambda x: x <> '') AS words FROM benchmark),
item AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS k
  FROM (SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
win AS (
  SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS k
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d JOIN (SELECT DISTINCT size FROM item) s ON len(words) >= size)),
hit AS (SELECT doc_id, item_id, i, size FROM win JOIN item USING (size, k)),
words_hit AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n_hit FROM hit, range(0, 10) r(o) WHERE o < size GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY encode(item_id::VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""
