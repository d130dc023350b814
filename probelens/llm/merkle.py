"""A hash tree over a dataset, and the proof of every row, by a butterfly exchange.

Rows of a source ascend by id and become leaves; runs of FANOUT nodes become one until one is left. Leaves are dealt to blocks of
FANOUT ** levels, aligned with the tree, so a block hashes its own subtree. Then blocks swap subtree roots: in round r, the blocks
whose numbers differ in digit r alone (base FANOUT) send each other the roots of the subtrees that they know, and each hashes the
common ancestor itself. So every block gets the siblings of all its ancestors on the way up, and no pass leads down. Where the last
subtree is not full, its blocks also stand in for those it lacks. The roots of sources make the upper tree by the same rounds.

A block is one row of packed hashes; the exchange moves one hash of 64 characters per block and partner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probelens.llm.store import parts_of, small_batches, written

FANOUT = 16
#: Levels of the tree inside a block.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 of the columns' values, each with its length in bytes before it; `-` for null."""
    encoded = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*encoded).cast("binary"), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """All columns, `rank` (from 0, in `order` within the group; equal rows in any order) and `members` of the group.

    Rows are dealt by ranges of group and order and written once; a partition's rows of a group follow those of the partitions before, so only
    counts by partition and group are summed up. Null values come first and make a group of their own.
    """
    parts = parts_of(rows.sparkSession)
    dealt = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    placed = written(dealt.withColumn("__row", F.monotonically_increasing_id()), label).withColumn("__task", F.shiftright("__row", 33))
    counts = placed.groupBy(*group, "__task").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(own.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__task").alias("__t"), (F.col("__first") - before).alias("__shift"), F.sum("__n").over(own).alias("members"))
    same = F.col("__task") == F.col("__t")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return placed.join(starts, same).select(*rows.columns, (F.col("__row") - F.col("__shift")).alias("rank"), "members")


def levels_of(members: Column) -> Column:
    """How often runs are hashed until one node is left."""
    out = F.lit(0)
    for level in range(1, 16):
        out = F.when(members > F.lit(FANOUT ** (level - 1)), F.lit(level)).otherwise(out)
    return out


_BLOCK = "owner STRING, block BIGINT, members BIGINT, node STRING, leaves BINARY"


def _subtree(leaves: list[str], levels: int) -> list[list[str]]:
    """Nodes of each level above some leaves."""
    out = [leaves]
    for _ in range(levels):
        out.append([_digest("".join(out[-1][i : i + FANOUT])) for i in range(0, len(out[-1]), FANOUT)])
    return out


def _levels(n: int) -> int:
    return next(k for k in range(16) if FANOUT**k >= n)


def _pack(levels: int):
    """One row for a block: the root of its subtree, and its leaves."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        leaves, members = rows.column("leaf").to_pylist(), rows.column("members")[0].as_py()
        node = _subtree(leaves, min(levels, _levels(members)))[-1][0]
        first = [rows.column(c)[:1] for c in ("owner", "block", "members")]
        return pa.table([*first, pa.array([node]), pa.array([bytes.fromhex("".join(leaves))])], names=["owner", "block", "members", "node", "leaves"])

    return run


def butterfly(nodes: DataFrame, rounds: int, payload: Sequence[str] = ()) -> DataFrame:
    """Swaps roots until all nodes of an owner know its top. nodes: owner, number (from 0, gapless), count (of the owner's
    nodes), node (a root's hash), `payload`. Adds siblings: an array of the other nodes of each level's run joined, left to right, with the own
    position and the joined ones before it.

    An owner takes part in as many rounds as it has levels. Each round is one exchange on (owner, ancestor, low digits).
    """
    known = nodes.withColumn("siblings", F.array().cast("array<struct<before: string, after: string>>"))
    for r in range(rounds):
        span = FANOUT**r
        number, count = F.col("number"), F.col("count")
        subtree, low = F.floor(number / span).cast("long"), F.pmod(number, F.lit(span))
        width = F.least(F.lit(span), count - subtree * span)  # blocks of this subtree: fewer in the last one
        lone = (count <= span) | (F.floor(subtree / FANOUT) * FANOUT * span + span >= count)  # no partners
        slots = F.when(lone, F.array(low)).otherwise(F.sequence(low, F.lit(span - 1).cast("long"), width))
        sent = known.select("*", subtree.alias("subtree"), low.alias("low"), (count > span).alias("active"), F.explode(slots).alias("slot"))
        own = F.when(F.col("slot") == F.col("low"), F.struct("number", "count", "siblings", *payload))
        message = F.struct(F.col("subtree").alias("subtree"), "node", own.alias("own"))
        # an owner that is done keeps to itself
        met = sent.groupBy("owner", F.floor(F.col("subtree") / FANOUT).alias("ancestor"), "slot", "active").agg(F.sort_array(F.collect_list(message)).alias("all"))
        each = met.select("owner", "active", "all", F.explode(F.filter("all", lambda x: x["own"].isNotNull())).alias("me"))
        before = F.array_join(F.transform(F.filter("all", lambda x: x["subtree"] < F.col("me.subtree")), lambda x: x["node"]), "")
        after = F.array_join(F.transform(F.filter("all", lambda x: x["subtree"] > F.col("me.subtree")), lambda x: x["node"]), "")
        step = F.struct(before.alias("before"), after.alias("after"))
        node = F.sha2(F.concat(before, F.col("me.node"), after).cast("binary"), 256)
        known = each.select(
            "owner", "me.own.number", "me.own.count", F.when(F.col("active"), node).otherwise(F.col("me.node")).alias("node"), *[f"me.own.{c}" for c in payload],
            F.when(F.col("active"), F.concat("me.own.siblings", F.array(step))).otherwise(F.col("me.own.siblings")).alias("siblings"),
        )
    return known


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", source: str = "source", claimed: dict[str, Column] | None = None,
             proofs: bool = True, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified and, with `proofs`, proof: for
    each level from the leaf up the hashes before and after it in its run, joined.

    Leaves hash `fields` in order. Per source they ascend by id, null first, then by leaf; runs of FANOUT become nodes, a shorter last run
    too, until one is left. Sources ascend bytewise, null first, and their subroots make the root likewise. proof_sha256 hashes all siblings.
    folded_root is what the leaf of the `claimed` values (columns by field; the document's own where not given) folds to with the proof,
    and verified whether it is the root. A block has FANOUT ** `levels` leaves. Repeated rows are leaves of their own. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    leaf = leaf_hash([F.col(f) for f in fields])
    claim = leaf_hash([(claimed or {}).get(f, F.col(f)) for f in fields])
    rows = docs.select(F.col(source).cast("string").alias("owner"), F.col(doc_id).alias("id"), leaf.alias("leaf"), claim.alias("claim"))
    rows = rows.withColumn("claim", F.when(F.col("claim") != F.col("leaf"), F.col("claim")))
    leaves = ranked(rows, ["owner"], ["id", "leaf"], "leaves").withColumn("block", F.floor(F.col("rank") / FANOUT**levels))
    blocks = written(leaves.groupBy("owner", "block").applyInArrow(_pack(levels), _BLOCK), "blocks")
    nodes = blocks.select("owner", F.col("block").alias("number"), F.ceil(F.col("members") / FANOUT**levels).alias("count"), "node")
    deepest = nodes.agg(F.max(levels_of(F.col("count"))).alias("n"), F.count_if(F.col("number") == 0).alias("sources")).first()
    lower = written(butterfly(nodes, deepest["n"] or 0), "lower")
    tops = ranked(lower.where("number = 0").select(F.col("owner").alias("of"), "node"), [], ["of"], "tops")
    upper = butterfly(tops.select(F.lit("").alias("owner"), F.col("rank").alias("number"), F.col("members").alias("count"), "node", "of", F.col("node").alias("subroot")),
                      _levels(deepest["sources"]), ["of", "subroot"])
    upper = upper.select("of", "subroot", F.col("node").alias("root"), F.col("siblings").alias("above"))
    known = lower.alias("l").join(upper.alias("u"), F.expr("l.owner <=> u.of")).select(F.col("l.owner").alias("o"), F.col("number").alias("b"), F.concat("siblings", "above").alias("path"), "subroot", "root")
    own = blocks.join(known, F.expr("owner <=> o AND block = b")).select("owner", "block", "leaves", "path", "subroot", "root")
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, source STRING, leaf STRING, subroot STRING, root STRING, proof_sha256 STRING, folded_root STRING, verified BOOLEAN"
    schema += ", proof ARRAY<STRUCT<before: STRING, after: STRING>>" if proofs else ""
    members = leaves.select("owner", "block", "id", "claim", "rank", "members")
    return members.groupBy("owner", "block").cogroup(own.groupBy("owner", "block")).applyInArrow(_prove(proofs, levels), schema)


def fold(leaf: str, proof: list[dict]) -> str:
    """The root that a leaf and its proof lead to."""
    for step in proof:
        leaf = _digest(step["before"] + leaf + step["after"])
    return leaf


def _prove(proofs: bool, local: int):
    step_type = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def run(members: pa.Table, own: pa.Table) -> pa.Table:
        members = members.sort_by("rank")
        block = own.to_pylist()[0]
        packed = block["leaves"].hex()
        leaves = [packed[i : i + 64] for i in range(0, len(packed), 64)]
        levels = _subtree(leaves, min(local, _levels(members.column("members")[0].as_py())))[:-1]
        above = "".join(s["before"] + s["after"] for s in block["path"]).encode()
        tops: dict[str, str] = {}
        out: dict[str, list] = {n: [] for n in ("proof_sha256", "folded_root", *(["proof"] if proofs else []))}
        for i, (leaf, claim) in enumerate(zip(leaves, members.column("claim").to_pylist())):
            proof, at = [], i
            for nodes in levels:
                low = at - at % FANOUT
                proof.append({"before": "".join(nodes[low:at]), "after": "".join(nodes[at + 1 : low + FANOUT])})
                at //= FANOUT
            digest = hashlib.sha256("".join(s["before"] + s["after"] for s in proof).encode())
            digest.update(above)
            top = fold(claim or leaf, proof)
            if top not in tops:
                tops[top] = fold(top, block["path"])
            out["proof_sha256"].append(digest.hexdigest())
            out["folded_root"].append(tops[top])
            if proofs:
                out["proof"].append(proof + block["path"])
        n, root = len(leaves), block["root"]
        columns = [members.column("id"), members.column("owner"), pa.array(leaves), pa.array([block["subroot"]] * n), pa.array([root] * n),
                   pa.array(out["proof_sha256"]), pa.array(out["folded_root"]), pa.array([f == root for f in out["folded_root"]])]
        names = ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        if proofs:
            columns, names = [*columns, pa.array(out["proof"], step_type)], [*names, "proof"]
        return pa.table(columns, names=names)

    return run


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(tampered, F.translate("text", _ALPHABET, _ALPHABET.lower())).otherwise(F.col("text"))
    return manifest(documents, claimed={"text": text}, proofs=False).drop("source")


def _sql(levels: int = 6) -> str:
    """The query for DuckDB: the levels of both trees one after the other, each kept as it is where one node is left."""
    def field(c: str, value: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c, text if c == "text" else c) for c in FIELDS) + ")"

    # CRC-32 by its polynomial: a step for each bit, a character joins at the first of its eight
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"
    lower = f"translate(text, '{_ALPHABET}', '{_ALPHABET.lower()}')"
    out = [
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN ({crc}) % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS claim FROM documents)",
        "a0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, doc_id, claim FROM leaves)",
    ]
    for k in range(levels):
        out.append(f"n{k} AS (SELECT source, i, h, count(*) OVER (PARTITION BY source) AS n FROM a{k})")
        out.append(
            f"a{k + 1} AS (SELECT source, i // {FANOUT} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM n{k} WHERE n > 1 GROUP BY source, i // {FANOUT} "
            f"UNION ALL SELECT source, i, h FROM n{k} WHERE n = 1)"
        )
    out.append(f"b0 AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, h FROM a{levels})")
    for k in range(levels):
        out.append(f"m{k} AS (SELECT i, h, count(*) OVER () AS n FROM b{k})")
        out.append(f"b{k + 1} AS (SELECT i // {FANOUT} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM m{k} WHERE n > 1 GROUP BY i // {FANOUT} UNION ALL SELECT i, h FROM m{k} WHERE n = 1)")
    # siblings of every node: the nodes of its run before and after it, empty where one node is left
    for k in range(levels):
        for name, of, key in (("s", f"n{k}", "source, "), ("u", f"m{k}", "")):
            run = f"OVER (PARTITION BY {key}i // {FANOUT} ORDER BY i ROWS BETWEEN "
            out.append(
                f"{name}{k} AS (SELECT {key}i, n > 1 AS deeper, coalesce(string_agg(h, '') {run}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS x, "
                f"coalesce(string_agg(h, '') {run}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS y FROM {of})"
            )
    previous = "SELECT z.*, b0.i AS j, '' AS proof, claim AS f FROM a0 z JOIN b0 ON z.source IS NOT DISTINCT FROM b0.source"
    for name, at, on in (("s", "i", "t.source IS NOT DISTINCT FROM p.source AND "), ("u", "j", "")):
        for k in range(levels):
            label = f"p{name}{k}"
            out.append(f"{label} AS MATERIALIZED ({previous})")
            previous = (
                f"SELECT p.* REPLACE (CASE WHEN deeper THEN p.{at} // {FANOUT} ELSE p.{at} END AS {at}, CASE WHEN deeper THEN proof || x || y ELSE proof END AS proof, "
                f"CASE WHEN deeper THEN sha256(x || f || y) ELSE f END AS f) FROM {label} p JOIN {name}{k} t ON {on}t.i = p.{at}"
            )
    out.append(f"done AS ({previous})")
    return (
        "WITH " + ",\n".join(out) + f"\nSELECT doc_id, done.h AS leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified\n"
        f"FROM done JOIN a{levels} s ON s.source IS NOT DISTINCT FROM done.source CROSS JOIN b{levels} r"
    )


SQL = _sql()
