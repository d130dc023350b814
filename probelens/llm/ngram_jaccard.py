"""N-gram Jaccard join: documents whose sets of word shingles have a similarity of at least 0.8, as components.

Two sets of sizes m <= n with that similarity share at least ceil(0.8 n) shingles: a T-occurrence search over the
inverted lists of one set's shingles, T = ceil(0.8 n). The join is exact:

1. Equal sets are one: documents are grouped by a 128-bit digest of their set, the smallest id stands for them.
   The same pass counts shingles in a fixed number of buckets; shingles of crowded buckets are called hot.
2. The frequency of every other shingle among distinct sets is counted (packed, see `keyed`) and returned to its
   documents. A set that finds fewer than T of its shingles elsewhere has no partner and goes no further.
3. Every set's shingles are ranked by frequency, hot ones last. Partners share one of the first n - T + 1 in this
   order (the short lists that remain when the T - 1 longest are set aside). Sets that meet in such a list, or in a
   hot bucket there, are put into one family; families are components of these meetings, never pairs.
4. A family is searched in blocks of bounded size, one task each: DivideSkip over inverted lists of clusters, then
   of a cluster's documents. A set joins the clusters it links with, so the links of a block are a forest.
5. A family of several blocks shares pivots between blocks. If it still has several components, every set
   outside the largest is a query against all blocks.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.llm import graph, keyed
from probelens.llm.store import parts_of, small_batches, written
from probelens.llm.words import SPACES, Words, mix, ranges, slices

WIDTH = 5
#: Similarity in percent.
LEAST = 80
#: How far above twice the mean a bucket of the frequency sketch is crowded.
CROWDED = 1000
#: Shingles in a block, and sets that all blocks of a family share.
BLOCK = 1 << 19
PIVOTS = 4
#: Inverted lists longer than this are probed rather than merged; more ids than this are merged by sorting.
LONG, MANY = 32, 512

_OWNER = np.dtype([("a", "<i8"), ("b", "<i8")])
_HOT_NODE = -(1 << 62)


def need(n: int) -> int:
    """Shingles that a set of n shares at least with a partner that is not larger."""
    return -(-LEAST * n // 100)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of all its words if those are fewer than a shingle has."""
    words = Words(texts, SPACES, lower=True)
    hashes, counts = words.windows(WIDTH)
    ends = np.cumsum(counts)
    for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist())):
        if n:
            yield np.unique(hashes[end - n : end])
        elif words.counts[i]:
            own = words.hashes[words.first[i] : words.first[i] + words.counts[i]]
            yield mix(np.array([sum(int(h) * (2 * j + 3) for j, h in enumerate(own)) & (1 << 64) - 1], np.uint64))
        else:
            yield own_empty


own_empty = np.zeros(0, np.uint64)


def digest(keys: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a, b = mix(keys).sum(dtype=np.uint64), mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


# 1. sets and sketch

_SETS = "doc_id BIGINT, n BIGINT, a BIGINT, b BIGINT, part INT, sketch BINARY"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("sketch", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch, seen = np.zeros(keyed.SKETCH, np.int64), set()
    for batch in slices(batches, "__text"):
        rows = []
        for doc, keys in zip(batch.column("__id").to_pylist(), shingle_sets(batch.column("__text"))):
            a, b = digest(keys)
            rows.append((doc, len(keys), a, b, None, None))
            if (a, b) not in seen and len(keys):  # copies in a task count once
                seen.add((a, b))
                sketch += np.bincount(keyed.bucket_of(keys), minlength=keyed.SKETCH)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SETS_ARROW)], schema=_SETS_ARROW)
    if seen:
        slices_ = keyed.sketch_slices(sketch)
        nulls = {n: pa.nulls(len(slices_), pa.int64()) for n in ("doc_id", "n", "a", "b")}
        yield pa.RecordBatch.from_arrays([*nulls.values(), *slices_.columns], schema=_SETS_ARROW)


# 2. frequencies


def _deal_rare(hot, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded, seen = hot.value, set()
        for batch in slices(batches, "__text"):
            kept, owners = [], []
            for keys in shingle_sets(batch.column("__text")):
                if len(keys) and (name := digest(keys)) not in seen:  # copies in a task are sent once
                    seen.add(name)
                    keys = keys[~crowded[keyed.bucket_of(keys)]]
                    if len(keys):
                        kept.append(keys)
                        owners.append(name)
            if kept:
                yield keyed.deal(np.concatenate(kept), np.array([len(k) for k in kept]), np.array(owners, _OWNER), parts, 4)

    return run


def _frequencies(parts: int):
    """For each set with a shingle that another set has: how many sets have each of its shingles, 255 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in keyed.parts(batches, _OWNER, 4):
            _, entries = np.unique(part.owners, return_index=True)
            entries.sort()  # a set may come from several tasks
            n = part.counts[entries]
            keys = part.keys[np.repeat(part.offsets[entries], n) + ranges(n)]
            _, which, found = np.unique(keys, return_inverse=True, return_counts=True)
            often = np.minimum(found, 255).astype(np.uint8)[which]
            offsets = np.concatenate(([0], np.cumsum(n)))
            keep = np.flatnonzero(np.maximum.reduceat(often, offsets[:-1]) > 1)
            at = np.repeat(offsets[keep], n[keep]) + ranges(n[keep])
            yield from keyed.answers(part.part, part.owners[entries[keep]], n[keep], often[at], parts)

    return run


# 3. survivors, their short lists and families

_SURVIVORS = "id BIGINT, n INT, keys BINARY, short BINARY, hot BINARY"
_SURVIVORS_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("short", pa.binary()), ("hot", pa.binary())])


def ranks(keys: np.ndarray, crowded: np.ndarray, seen: dict, parts: int) -> np.ndarray:
    """How often each shingle occurs (1 to 255), 256 for hot ones."""
    hot = crowded[keyed.bucket_of(keys)]
    out = np.full(len(keys), 256, np.int64)
    out[~hot] = keyed.placed(seen, keys[~hot], parts, 1)
    return out


def _survive(hot, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = hot.value
        for batch in slices(batches, "__text"):
            rows = []
            told = batch.select(["__id", "a", "b", "parts", "counts", "found"]).to_pylist()
            for seen, keys in zip(told, shingle_sets(batch.column("__text"))):
                if digest(keys) != (seen["a"], seen["b"]):
                    continue  # another row of the same id
                rank = ranks(keys, crowded, seen if seen["found"] is not None else {}, parts)
                least = need(len(keys))
                if np.count_nonzero(rank > 1) < least:
                    continue
                order = np.lexsort((keys, rank))[: len(keys) - least + 1]
                short = keys[order[(rank[order] > 1) & (rank[order] < 256)]]
                buckets = np.unique(keyed.bucket_of(keys[order[rank[order] == 256]])).astype("<i4")
                rows.append((seen["__id"], len(keys), keys.tobytes(), short.tobytes(), buckets.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SURVIVORS_ARROW)], schema=_SURVIVORS_ARROW)

    return run


_MEMBER = np.dtype([("id", "<i8"), ("n", "<i8")])


def _deal_short(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x, np.uint64) for x in batch.column("short").to_pylist()]
            if sum(map(len, lists)):
                owners = np.array(list(zip(batch.column("id").to_pylist(), batch.column("n").to_pylist())), _MEMBER)
                yield keyed.deal(np.concatenate(lists), np.array([len(x) for x in lists]), owners, parts)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours by size in an inverted list, as far as their sizes allow a link; a forest of them."""
    for part in keyed.parts(batches, _MEMBER):
        owner = part.owners[part.entry]
        order = np.lexsort((owner["id"], owner["n"], part.keys))
        keys, ids, n = part.keys[order], owner["id"][order], owner["n"][order]
        close = (keys[1:] == keys[:-1]) & (100 * n[:-1] >= LEAST * n[1:]) & (ids[1:] != ids[:-1])
        forest, pairs = graph.Forest(), []
        for a, b in np.unique(np.stack((ids[:-1][close], ids[1:][close]), axis=1), axis=0).tolist():
            if forest.join(a, b):
                pairs.append((a, b))
        if pairs:
            yield graph.edge_batch(pairs)


def _meet_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets and the hot buckets they have among their short lists; a forest of them."""
    forest, pairs = graph.Forest(), []
    for batch in batches:
        for doc, data in zip(batch.column("id").to_pylist(), batch.column("hot").to_pylist()):
            pairs += [(doc, _HOT_NODE - b) for b in np.frombuffer(data, "<i4").tolist() if forest.join(doc, _HOT_NODE - b)]
        if pairs:
            yield graph.edge_batch(pairs)
            pairs = []


# 4. search in a block


def divide_skip(lists: list[array], least: int) -> list[tuple[int, int]]:
    """(id, count) of the ids in at least `least` of the sorted lists.

    Lists longer than LONG, at most least - 1 of them, are set aside. The others are merged by a heap, or by one
    sort where they hold many ids; an id found there often enough is looked up in the long lists by binary
    search, longest last, as long as it can still reach the count.
    """
    if len(lists) < least:
        return []
    lists = sorted(lists, key=len)
    cut = len(lists)
    while cut > 0 and len(lists) - cut < least - 1 and len(lists[cut - 1]) > LONG:
        cut -= 1
    long, out = lists[cut:], []
    if sum(map(len, lists[:cut])) > MANY:
        ids, counts = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in lists[:cut]]), return_counts=True)
        for k, other in enumerate(long):
            able = counts + (len(long) - k) >= least
            ids, counts, among = ids[able], counts[able], np.frombuffer(other, np.int32)
            at = np.minimum(np.searchsorted(among, ids), len(among) - 1)
            counts += among[at] == ids
        able = counts >= least
        return list(zip(ids[able].tolist(), counts[able].tolist()))
    for x, run in groupby(heapq.merge(*lists[:cut])):
        count = sum(1 for _ in run)
        for k, other in enumerate(long):
            if count + len(long) - k < least:
                break
            at = bisect_left(other, x)
            count += at < len(other) and other[at] == x
        if count >= least:
            out.append((x, count))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b)) if len(a) else 0


def linked(both: int, m: int, n: int) -> bool:
    return 100 * both >= LEAST * (m + n - both)


class Cluster:
    """Linked sets of a block; their inverted lists are built when they are first asked for."""

    def __init__(self) -> None:
        self.members: list[int] = []
        self.recent: list[int] = []
        self.lists: dict[int, array] = {}
        self.listed = 0


class Block:
    """Sets of a block, in an order of sizes, and the clusters they form. Shingles in only one set are dropped:
    they count in a set's size alone."""

    def __init__(self, names: list[int], keys: list[np.ndarray]):
        self.names, self.sizes = names, [len(k) for k in keys]
        values, which, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        dense = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[which]
        ends = np.cumsum(self.sizes)
        self.keys = [(k := dense[e - n : e])[k >= 0] for n, e in zip(self.sizes, ends)]
        self.lists: dict[int, array] = {}
        self.clusters: list[Cluster] = []

    def search(self, cluster: Cluster, x: int) -> int | None:
        """A member that x links with."""
        keys, n = self.keys[x], self.sizes[x]
        for m in cluster.recent:
            if linked(overlap(self.keys[m], keys), self.sizes[m], n):
                cluster.recent.remove(m)
                cluster.recent.insert(0, m)
                return m
        for m in cluster.members[cluster.listed :]:
            for k in self.keys[m].tolist():
                cluster.lists.setdefault(k, array("i")).append(m)
        cluster.listed = len(cluster.members)
        for m, both in divide_skip([cluster.lists[k] for k in keys.tolist() if k in cluster.lists], need(n)):
            if linked(both, self.sizes[m], n):
                cluster.recent = [m, *cluster.recent[:3]]
                return m
        return None

    def found(self, x: int, skip=lambda c: False) -> Iterator[tuple[int, int]]:
        """Clusters that x links with, and a member it links with in each."""
        lists = [self.lists[k] for k in self.keys[x].tolist() if k in self.lists]
        for c, _ in sorted(divide_skip(lists, need(self.sizes[x])), key=lambda pair: -pair[1]):
            if not skip(c) and (m := self.search(self.clusters[c], x)) is not None:
                yield c, m

    def add(self, x: int, c: int | None) -> int:
        """Put x into cluster c, or into one of its own."""
        if c is None:
            c = len(self.clusters)
            self.clusters.append(Cluster())
        cluster = self.clusters[c]
        cluster.members.append(x)
        if len(cluster.recent) < 4:
            cluster.recent.append(x)
        for k in self.keys[x].tolist():
            having = self.lists.setdefault(k, array("i"))
            if not having or having[-1] < c:
                having.append(c)
            elif having[bisect_left(having, c)] != c:
                insort(having, c)
        return c


def links_inside(names: list[int], keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest of links whose components are those of all links between the sets, which ascend in size."""
    block, forest, out = Block(names, keys), graph.Forest(), []
    for x in range(len(names)):
        home = None
        same = lambda c: home is not None and forest.find(c) == forest.find(home)
        for c, m in block.found(x, same):
            out.append((names[m], names[x]))
            if home is None:
                home = c
            else:
                forest.join(home, c)
        block.add(x, home)
    return out


def links_across(names: list[int], keys: list[np.ndarray], classes: list[int], queries: list[bool]) -> list[tuple[int, int]]:
    """Links of query sets with the other sets, where their classes differ; one for each class met."""
    block, of_class, out = Block(names, keys), {}, []
    for x, (c, query) in enumerate(zip(classes, queries)):
        if not query:
            of_class[c] = block.add(x, of_class.get(c))
    for x, (c, query) in enumerate(zip(classes, queries)):
        if query:
            own = of_class.get(c)
            out += [(names[m], names[x]) for _, m in block.found(x, lambda k, own=own: k == own)]
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[list[dict]]:
    """Rows of each group from rows sorted by group."""
    rows = (dict(zip(b.schema.names, r)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for _, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield list(group)


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches, ("family", "block")):
        if len(group) > 1 and (pairs := links_inside([r["id"] for r in group], [np.frombuffer(r["keys"], np.uint64) for r in group])):
            yield graph.edge_batch(pairs)


def _search_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches, ("family", "block", "chunk")):
        pairs = links_across([r["id"] for r in group], [np.frombuffer(r["keys"], np.uint64) for r in group], [r["root"] for r in group], [r["query"] for r in group])
        if pairs:
            yield graph.edge_batch(pairs)


def _links(survivors: DataFrame, families: DataFrame) -> DataFrame:
    """Components of all links between the survivors: (node, root)."""
    members = written(survivors.select("id", "n").join(families.withColumnRenamed("node", "id").withColumnRenamed("root", "family"), "id"), "members")
    picks = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id"))["id"].alias(f"p{k}") for k in range(PIVOTS)]
    sizes = members.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).alias("blocks"), *picks)
    placed = members.join(sizes.select("family", "blocks"), "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = placed.select("id", "family", "blocks", "block")
    large = sizes.where("blocks > 1").select("family", "blocks", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("id"))
    shared = large.select("id", "family", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    rows = survivors.select("id", "n", "keys").join(placed.unionAll(shared).distinct(), "id")
    ordered = rows.repartition(parts_of(survivors.sparkSession), "family", "block").sortWithinPartitions("family", "block", "n", "id")
    links = written(ordered.mapInArrow(_search_blocks, graph.EDGES), "links")
    found = graph.components(links)
    if sizes.where("blocks > 1").isEmpty():
        return found
    known = placed.where("blocks > 1").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = known.join(members.select("id", "n"), "id")
    classes = known.groupBy("family", "root").agg(F.sum("n").alias("size"))
    largest = classes.groupBy("family").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.sum("size").alias("all"), F.max("size").alias("most"))
    open_ = largest.where("all > most").withColumn("chunks", F.ceil((F.col("all") - F.col("most")) / F.lit(BLOCK)))
    rest = written(known.join(open_, "family"), "open")
    if rest.isEmpty():
        return found
    each = lambda to: F.explode(F.sequence(F.lit(0).cast("long"), F.col(to) - 1))
    indexed = rest.select("id", "family", "root", "block", each("chunks").alias("chunk"), F.lit(False).alias("query"))
    asked = rest.where("root <> main").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")))
    asked = asked.select("id", "family", "root", each("blocks").alias("block"), "chunk", F.lit(True).alias("query"))
    rows = survivors.select("id", "n", "keys").join(indexed.unionByName(asked), "id")
    ordered = rows.repartition(parts_of(survivors.sparkSession), "family", "block", "chunk").sortWithinPartitions("family", "block", "chunk", "n", "id")
    more = written(ordered.mapInArrow(_search_across, graph.EDGES), "links")
    return graph.components(links.unionAll(more))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Sets are of lower-cased (A-Z) five-word shingles; a text of fewer words is one shingle, a null or blank one is
    empty and linked with nothing. Sets link at a similarity of 0.8; component_id is the smallest id that links
    lead to, the row's own included. Equal sets are always linked. A row without id gets the component of its
    set, or null if it links with no row that has one. Rows that repeat an id are one document. Repeated rows give repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts_of(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    scanned = written(texts.mapInArrow(_sets, _SETS), "sets")
    sets = scanned.where("part IS NULL").select("doc_id", "n", "a", "b")
    hot = spark.sparkContext.broadcast(keyed.crowded(scanned.where("part IS NOT NULL"), CROWDED)[0])
    reps = sets.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"))
    dealt = texts.select("__text").mapInArrow(_deal_rare(hot, parts), keyed.SCHEMA)
    sent = keyed.by_part(dealt, parts).mapInArrow(_frequencies(parts), keyed.ANSWERS)
    told = reps.where("rep IS NOT NULL").join(keyed.gathered(sent, parts, _OWNER), ["a", "b"], "left").withColumnRenamed("rep", "__id")
    survivors = written(texts.join(told, "__id").mapInArrow(_survive(hot, parts), _SURVIVORS), "survivors")
    short = survivors.select("id", "n", "short").mapInArrow(_deal_short(parts), keyed.SCHEMA)
    meetings = keyed.by_part(short, parts).mapInArrow(_meet, graph.EDGES)
    hot_meetings = survivors.select("id", "hot").mapInArrow(_meet_hot, graph.EDGES)
    families = graph.components(meetings.unionAll(hot_meetings)).where(F.col("node") > _HOT_NODE)
    roots = _links(survivors, families)
    classes = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("a", "b", F.coalesce("root", "rep").alias("root"))
    found = sets.join(classes, ["a", "b"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("root"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
