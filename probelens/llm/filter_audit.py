"""What a sequence of filters removes, in every order, from one pass over the texts.

Each document gets a mask of the filters it fails. All but one look at its text alone; the last one fails documents whose whole text
a document with a smaller id has too, found by radix tries:

1. Tasks insert the texts of a batch into a compressed trie. A terminal holds, for each part and label, how many documents
   it has, their smallest id and how many have that id, so copies are one row before anything moves.
2. Rows are dealt by ranges of text. The bounds come from a sample, by prefixes that are lengthened where many texts share
   them; they decide where a text goes, never what is found.
3. Each range, in order of texts, goes through tries of bounded size, cut only between different texts. The smallest id at a terminal
   tells its duplicates; what leaves the task is a count for each part, mask and label.

The orders are then a small table over those counts.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probelens.llm.store import parts_of, small_batches, written

_UPPER = bytes(range(0x41, 0x5B))
_SYMBOLS = b"#$%&*|"


def _repetitive(text: bytes) -> bool:
    words = text.split()  # on ASCII white space
    return 100 * len(set(words)) < 80 * len(words)


def _shouting(text: bytes) -> bool:
    points = len(text.translate(None, bytes(range(0x80, 0xC0))))
    return 100 * (len(text) - len(text.translate(None, _UPPER))) > 10 * points


#: Filters on a text in UTF-8: true if it fails.
FILTERS: dict[str, Callable[[bytes], bool]] = {
    "A": lambda text: len(text.split()) < 100,
    "B": _repetitive,
    "C": _shouting,
    "D": lambda text: len(text.translate(None, _SYMBOLS)) < len(text),
}
DUPLICATE = "E"

#: Texts sampled for each range, and at most; bytes of a trie.
SAMPLED = 16
MOST_SAMPLED = 1 << 14
TRIE_BYTES = 16 << 20
_NO_ID = (1 << 63) - 1

_GROUPS = "groups ARRAY<STRUCT<part: STRING, quality: BOOLEAN, toxic: BOOLEAN, n: BIGINT, least: BIGINT, at_least: BIGINT>>"
_TEXTS = f"range INT, text STRING, {_GROUPS}"
_GROUP_TYPE = pa.list_(pa.struct([("part", pa.string()), ("quality", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64()), ("least", pa.int64()), ("at_least", pa.int64())]))
_COUNTS = "part STRING, mask INT, quality BOOLEAN, toxic BOOLEAN, n BIGINT"


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Terminal(dict):
    """Documents with one text: (part, quality, toxic) to [how many, smallest id, how many have it]."""

    def add(self, group: tuple, n: int, least: int, at_least: int) -> None:
        known = self.get(group)
        if known is None:
            self[group] = [n, least, at_least]
            return
        known[0] += n
        if least == known[1]:
            known[2] += at_least
        elif least < known[1]:
            known[1:] = [least, at_least]


class Trie:
    """A compressed trie of byte strings. A node is [label, terminal or None, children by first byte]."""

    def __init__(self) -> None:
        self.root: list = [b"", None, {}]
        self.size = 0

    def terminal(self, text: bytes) -> Terminal:
        """The terminal of a text, inserted if it is new."""
        node, at = self.root, 0
        while at < len(text):
            child = node[2].get(text[at])
            if child is None:
                child = [text[at:], Terminal(), {}]
                node[2][text[at]] = child
                self.size += len(text) - at
                return child[1]
            if not text.startswith(child[0], at):  # the edge parts here
                label, n = child[0], _common(child[0], text[at : at + len(child[0])])
                child[0] = label[n:]
                child = node[2][text[at]] = [label[:n], None, {label[n]: child}]
            node, at = child, at + len(child[0])
        if node[1] is None:
            node[1] = Terminal()
        return node[1]

    def __iter__(self) -> Iterator[tuple[bytes, Terminal]]:
        """Texts with their terminals."""
        waiting = [(b"", self.root)]
        while waiting:
            above, node = waiting.pop()
            text = above + node[0] if above else node[0]
            if node[1] is not None:
                yield text, node[1]
            waiting += [(text, child) for child in node[2].values()]


def _combined(bounds: list[bytes]):
    """Rows of _TEXTS: each different text of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trie = Trie()
            columns = (batch.column(c).to_pylist() for c in ("text", "part", "quality", "toxic", "id"))
            for text, part, quality, toxic, doc in zip(*columns):
                trie.terminal(text.encode()).add((part, quality, toxic), 1, doc, 1)
            rows = [(bisect_right(bounds, t), t, [dict(zip(("part", "quality", "toxic", "n", "least", "at_least"), (*g, *v))) for g, v in found.items()]) for t, found in trie]
            if rows:
                where, texts, groups = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(groups, _GROUP_TYPE)], names=["range", "text", "groups"])

    return run


def _counted(filters: dict[str, Callable[[bytes], bool]], trie_bytes: int):
    """Counts by mask from rows of _TEXTS that are sorted by text."""

    def traversed(trie: Trie, counts: Counter) -> None:
        for text, found in trie:
            mask = sum(1 << i for i, fails in enumerate(filters.values()) if fails(text))
            least = min(v[1] for v in found.values())
            for group, (n, own, at_own) in found.items():
                first = n if least == _NO_ID else at_own if own == least else 0
                counts[group, mask] += first
                counts[group, mask | 1 << len(filters)] += n - first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, counts = Trie(), None, Counter()
        for batch in batches:
            for text, groups in zip(batch.column("text").to_pylist(), batch.column("groups").to_pylist()):
                if trie.size > trie_bytes and text != last:
                    traversed(trie, counts)
                    trie = Trie()
                last, found = text, trie.terminal(text.encode())
                for g in groups:
                    found.add((g["part"], g["quality"], g["toxic"]), g["n"], g["least"], g["at_least"])
        traversed(trie, counts)
        rows = [(*group, mask, n) for (group, mask), n in counts.items() if n]
        if rows:
            part, quality, toxic, mask, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(mask, pa.int32()), pa.array(quality), pa.array(toxic), pa.array(n)], names=["part", "mask", "quality", "toxic", "n"])

    return run


def text_bounds(texts: DataFrame, ranges: int, first: int = 64) -> list[bytes]:
    """Fewer than `ranges` texts, ascending, that cut the rows of column `text` into ranges of about equal numbers of different texts.

    Prefixes of a bounded sample; those that more than a range's share of it begins with are lengthened fourfold until they
    are whole texts. A bound is as short as tells it from the prefix before.
    """
    n, most = texts.count(), min(SAMPLED * ranges, MOST_SAMPLED)
    if not n or ranges < 2:
        return []
    sample = texts.sample(min(1.0, most / n), seed=7) if n > most else texts
    sample = written(sample.select("text").distinct(), "sample")
    share = max(2, sample.count() // ranges)
    counts: dict[bytes, int] = {}
    some, length = sample, first
    while True:
        prefixes = some.groupBy(F.substring("text", 1, length).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest")).collect()
        heavy = [r["p"] for r in prefixes if r["n"] > share and r["longest"] > length]
        counts |= {r["p"].encode(): r["n"] for r in prefixes if not (r["n"] > share and r["longest"] > length)}
        if not heavy:
            break
        some, length = some.where(F.substring("text", 1, length).isin(heavy)), length * 4
    bounds, before, seen = [], b"", 0
    for prefix, n in sorted(counts.items()):
        if seen >= share and prefix > before:
            bounds.append(prefix[: _common(before, prefix) + 1])
            seen = 0
        seen, before = seen + n, prefix
    return bounds[: ranges - 1]


def failure_masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang",
                  filters: dict[str, Callable[[bytes], bool]] = FILTERS, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(part, mask, quality, toxic, n): documents by the filters they fail: bit i of mask for the i-th filter, the bit after the last
    filter's for duplicates, that is texts that a document with a smaller id has too.

    Null text counts as empty, null part as the empty string. A null id is larger than all others, and several null ids are no
    duplicates of each other; nor are rows that repeat an id. quality and toxic tell whether a row of `labels` with the
    document's id has a 1 there; of several rows one with 1 is enough. Other columns are ignored. No documents give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts_of(spark)
    marks = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")]
    marked = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(*marks).withColumn("salt", F.lit(0).cast("long"))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)))  # spreads null ids
    # the same exchange at every size, and no sort of texts
    labelled = rows.join(marked.hint("shuffle_hash"), ["id", "salt"], "left").select(
        F.coalesce("id", F.lit(_NO_ID)).alias("id"), "text", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")]
    )
    combined = labelled.mapInArrow(_combined(text_bounds(rows.select("text"), parts)), _TEXTS)
    dealt = combined.repartitionById(parts, F.col("range")).sortWithinPartitions("text").select("text", "groups")
    counts = dealt.mapInArrow(_counted(filters, trie_bytes), _COUNTS)
    return counts.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"))


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, bit, earlier): every order of the filters, step by step, with the mask of those before."""
    rows = []
    for order in itertools.permutations(letters):
        for i, letter in enumerate(order):
            rows.append(("".join(order), i + 1, 1 << letters.index(letter), sum(1 << letters.index(x) for x in order[:i])))
    return spark.createDataFrame(rows, "filter_order STRING, step INT, bit INT, earlier INT")


def audit(masks: DataFrame, letters: str = "".join(FILTERS) + DUPLICATE) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and
    step. Zeros included; shapley is what the step's filter removes, summed over all orders."""
    spark = masks.sparkSession
    steps = orders(spark, letters)
    cases = [(1 << i, e) for i in range(len(letters)) for e in range(1 << len(letters)) if not e & 1 << i]
    case = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(e).alias("earlier")) for b, e in cases])).alias("c")
    each = masks.select("part", "mask", "quality", "toxic", "n", case).select("*", "c.bit", "c.earlier")
    tests = {
        "kept": "mask & (bit | earlier) = 0",
        "removed": "mask & bit <> 0 AND mask & earlier = 0",
        "redundant": "mask & bit <> 0 AND mask & earlier <> 0",
        "unique_fails": "mask = bit",
        "good_lost": "quality AND mask & bit <> 0 AND mask & earlier = 0",
        "toxic_lost": "toxic AND mask & bit <> 0 AND mask & earlier = 0",
    }
    sums = each.groupBy("part", "bit", "earlier").agg(*[F.sum(F.when(F.expr(t), F.col("n")).otherwise(0)).alias(c) for c, t in tests.items()])
    out = sums.join(steps, ["bit", "earlier"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley")
    return out.select("part", "filter_order", "step", *tests, shapley)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(failure_masks(documents, labels))


_CLASS = r" \t\n\x0B\f\r"
SQL = rf"""
WITH marked AS (SELECT doc_id, max(quality = 1) AS quality, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[{_CLASS}]+'), lambda x: x <> '') AS words FROM d),
m AS (
  SELECT part, coalesce(quality, false) AS quality, coalesce(toxic, false) AS toxic,
         (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask
  FROM w LEFT JOIN marked USING (doc_id)),
c AS (SELECT part, quality, toxic, mask, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
p AS (
  SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f x ON x.bit NOT IN (a.bit, b.bit) JOIN f y ON y.bit NOT IN (a.bit, b.bit, x.bit)
  JOIN f z ON z.bit NOT IN (a.bit, b.bit, x.bit, y.bit)),
s AS (
  SELECT filter_order, unnest(range(1, 6))::INT AS step, bits FROM p),
t AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM s),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN quality AND mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN toxic AND mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM c CROSS JOIN t GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
