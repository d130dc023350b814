"""Suffix-array dedup, filter audit and hash trees against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from probelens.llm import filter_audit, merkle, suffix_dedup
from probelens.llm import suffix_array as suffix_arrays
from probelens.llm.queries import ORACLES, QUERIES
from probelens.llm.suffix_array import permuted_prefixes, suffix_array
from common import documents, empty, odd_rows, prose
from oracle_check import connect, difference, spark_bag, sql_bag

SF = "/root/testdata/sf0.001"


# ---- suffix arrays


@pytest.mark.parametrize("symbols", [1, 2, 3, 257, 100_000])
def test_suffix_array_equals_sorting(symbols):
    rng = np.random.default_rng(symbols)
    words = [rng.integers(0, symbols, rng.integers(1, 12)) for _ in range(6)]
    for n in (0, 1, 2, 3, 17, 60):
        drawn = rng.integers(0, symbols, n)
        joined = np.concatenate([words[i] for i in rng.integers(0, 6, max(n, 1))])
        for text in (drawn, joined, np.sort(joined)[::-1], np.tile(joined[:5], 12), np.concatenate([np.sort(p)[::-1] for p in np.array_split(joined, 5)] * 2)):
            plain = text.tolist()
            order = suffix_array(text)
            assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
            common, before = permuted_prefixes(np.asarray(text, np.int64), order)
            for i, j in zip(order[1:], order[:-1]):
                same = next((k for k in range(len(plain)) if max(i, j) + k >= len(plain) or plain[i + k] != plain[j + k]), 0)
                assert (before[i], common[i]) == (j, same)


def test_suffix_array_of_long_runs_and_many_buckets():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.full(3000, 7), rng.integers(0, 5000, 30_000), np.full(3000, 9), np.tile(rng.integers(0, 9, 3), 2000)])
    order, n = suffix_array(text), len(text)
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = np.arange(n), -1
    assert sorted(order.tolist()) == list(range(n))
    a, b = order[:-1], order[1:]
    assert np.all((text[a] < text[b]) | ((text[a] == text[b]) & (rank[a + 1] < rank[b + 1])))


def test_two_sweeps_sort_near_copies(monkeypatch):
    sweeps, induced, rng = [], suffix_arrays.induced, np.random.default_rng(3)
    monkeypatch.setattr(suffix_arrays, "induced", lambda *a: sweeps.append(1) or induced(*a))
    base, texts = rng.integers(1, 20, 300), []
    for k in range(40):
        texts += [base[k % 7 : 300 - k], [0]]
    text = np.concatenate(texts)
    order = suffix_arrays.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert len(sweeps) == 2  # the string of names needs none, however deep its repeats are


# ---- substring dedup by suffix arrays


def removed(texts: list[bytes], width: int) -> list[list[bool]]:
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        covered = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                covered[i : i + width] = [True] * width
        out.append(covered)
    return out


def expected_cut(text: bytes, covered: list[bool]) -> tuple:
    runs = [(k, list(g)) for k, g in itertools.groupby(range(len(text)), key=covered.__getitem__)]
    spans = [(g[0], g[-1] + 1) for k, g in runs if k]
    return len(text), sum(covered), bytes(b for b, c in zip(text, covered) if not c), spans


def family(n: int, seed: int) -> list[str]:
    rng, base, out = random.Random(seed), prose(seed, 150).split(), []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{i}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("width", "chunk"), [(200, 1 << 20), (64, 3000), (48, 500)])
def test_repeated_bytes_equal_brute_force(spark, width, chunk):
    rows = [(i, t) for i, t in enumerate(family(40, 5) + [prose(i, 60) for i in range(30)])]
    rows += [(100 + i, t) for i, (_, t, *_) in enumerate(odd_rows()) if t is None or len(t) < 20_000]
    rows += [(300, "ab" * 400), (301, "é" * 150 + "x"), (302, "\0" * 300), (303, prose(9, 40) + "\0" + prose(9, 40)), (304, prose(5, 150)[3:] + "é")]
    found = suffix_dedup.without_repeats(documents(spark, rows), width=width, carry=("doc_id", "n_words", "found"), chunk_bytes=chunk).collect()
    texts = [(t or "").encode() for _, t in rows]
    want = {i: expected_cut(t, c) for (i, _), t, c in zip(rows, texts, removed(texts, width))}
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_bytes, r.n_removed, bytes(r.kept), [(s.start, s.end) for s in r.removed]) == want[r.doc_id]
        assert (r.n_words, r.found) == ("x", "x")


def test_frequent_strings_change_nothing(spark, monkeypatch):
    rows = list(enumerate(family(60, 3) + family(20, 4)))
    plain = {r.doc_id: r for r in suffix_dedup.without_repeats(documents(spark, rows)).collect()}
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 5)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
    assert {r.doc_id: r for r in suffix_dedup.without_repeats(documents(spark, rows)).collect()} == plain
    assert sum(r.n_removed for r in plain.values()) > 10_000


def test_repeated_bytes_of_odd_tables(spark):
    assert suffix_dedup.without_repeats(empty(spark)).collect() == []
    rows = [(1, prose(1, 80)), (1, prose(1, 80)), (None, prose(2, 80)), (None, None), (2, "short"), (3, "short")]
    found = suffix_dedup.without_repeats(documents(spark, rows), carry=("doc_id",)).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in found)
    n, m = len(prose(1, 80)), len(prose(2, 80))
    assert got == Counter({(1, n, n): 2, (None, m, 0): 1, (None, 0, 0): 1, (2, 5, 0): 1, (3, 5, 0): 1})
    with pytest.raises(ValueError, match="kept"):
        suffix_dedup.without_repeats(documents(spark, rows), carry=("doc_id", "kept"))
    with pytest.raises(ValueError, match="width"):
        suffix_dedup.without_repeats(documents(spark, rows), width=10)


def test_op11_equals_brute_force(spark):
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    texts = [(t or "").encode() for t in table["text"]]
    want = {}
    for i, t, c in zip(table["doc_id"], texts, removed(texts, 200)):
        n, gone, kept, spans = expected_cut(t, c)
        want[i] = (n, gone, len(spans), hashlib.sha256(kept).hexdigest())
    found = QUERIES["op11_suffix_dedup"](spark, SF)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == want


# ---- filter audit


def masks_of(rows, labels) -> Counter:
    spaced = re.compile(r"[^\x20\x09-\x0D]+")
    quality, toxic = ({i for i, *marks in labels if marks[k] == 1} for k in (0, 1))
    out = Counter()
    for i, text, part in rows:
        t = text or ""
        words = spaced.findall(t)
        mask = (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t))
        smaller = any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in rows)
        out[part or "", mask + 16 * smaller, i is not None and i in quality, i is not None and i in toxic] += 1
    return out


def audited(masks: Counter) -> Counter:
    out = Counter()
    for part in {k[0] for k in masks}:
        removed_by = Counter()
        rows = []
        for order in itertools.permutations("ABCDE"):
            for step in range(5):
                bit, earlier = 1 << "ABCDE".index(order[step]), sum(1 << "ABCDE".index(x) for x in order[:step])
                c = Counter()
                for (p, mask, q, t), n in masks.items():
                    if p != part:
                        continue
                    gone = bool(mask & bit) and not mask & earlier
                    c.update(kept=n * (not mask & (bit | earlier)), removed=n * gone, redundant=n * (bool(mask & bit) and not gone), unique=n * (mask == bit), good=n * (gone and q), toxic=n * (gone and t))
                removed_by[bit] += c["removed"]
                rows.append((part, "".join(order), step + 1, c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"], bit))
        out.update((*r[:-1], removed_by[r[-1]]) for r in rows)
    return out


def audit_rows():
    many = " ".join(f"w{i}" for i in range(150))
    rows = [(i, t, "en") for i, t, *_ in odd_rows()]
    rows += [(20 + i, many + " x" * (i % 3), ("en", "de", None, "")[i % 4]) for i in range(24)]
    rows += [(60, "A" * 50 + " b", "fr"), (61, "5 % off & more", "fr"), (62, "É" * 9 + "A", "fr"), (63, "a\x1cb c d", "fr"), (64, "$" + many, "en"), (70, many + "é", "de"), (71, many + "é", "de"), (72, many + "è", "de")]
    labels = [(20, 1, 0), (21, 0, 1), (22, 1, 1), (22, None, 0), (23, None, None), (None, 1, 1), (64, 1, 0), (999, 1, 1), (1, 1, 0), (1, 0, 0)]
    return rows, labels


@pytest.mark.parametrize("trie_bytes", [1 << 24, 200])
def test_failure_masks_and_audit_equal_brute_force(spark, trie_bytes):
    rows, labels = audit_rows()
    docs = documents(spark, [(i, t, p) for i, t, p in rows])
    marks = spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")
    masks = filter_audit.failure_masks(docs.repartition(3), marks, trie_bytes=trie_bytes)
    want = masks_of(rows, labels)
    assert Counter({tuple(r)[:4]: r.n for r in masks.collect()}) == want
    found = filter_audit.audit(masks)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert Counter(tuple(r) for r in found.collect()) == audited(want)


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    assert filter_audit.audit(filter_audit.failure_masks(empty(spark), none)).collect() == []
    one = filter_audit.audit(filter_audit.failure_masks(documents(spark, [(1, None, None)]), none)).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}


def test_tries_hold_every_text():
    rng, trie, seen = random.Random(3), filter_audit.Trie(), Counter()
    for i in range(3000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12)))
        trie.terminal(text).add(("p",), 1, i, 1)
        seen[text] += 1
    assert {t: sum(v[0] for v in found.values()) for t, found in trie} == dict(seen)


def test_bounds_lengthen_prefixes_that_many_texts_share(spark):
    texts = [prose(1, 100) + f" {i}" for i in range(200)] + [prose(i, 20) for i in range(50)]
    bounds = filter_audit.text_bounds(spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(2), 8)
    assert bounds == sorted(set(bounds)) and 3 < len(bounds) < 8
    sizes = Counter(filter_audit.bisect_right(bounds, t.encode()) for t in texts)
    assert max(sizes.values()) < 100
    assert filter_audit.text_bounds(spark.createDataFrame([], "text STRING"), 8) == []


# ---- hash trees


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        low = at - at % 16
        out.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + 16])))
        at //= 16
    return out


def expected_manifest(rows, claims=None) -> Counter:
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((r[0], leaf_of([r[0], r[3], r[2], r[4], r[1]]), (claims or {}).get(r[0])) for r in rows if r[3] == s), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = own, tree([x[1] for x in own])
    top = tree([trees[s][1][-1][0] for s in sources])
    out = Counter()
    for k, s in enumerate(sources):
        own, levels = trees[s]
        for at, (doc, leaf, claim) in enumerate(own):
            proof = path(levels, at) + path(top, k)
            folded = claim or leaf
            for before, after in proof:
                folded = sha(before + folded + after)
            out[doc, s, leaf, levels[-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), folded, folded == top[-1][0], tuple(proof)] += 1
    return out


def manifest_bag(found) -> Counter:
    return Counter((*tuple(r)[:-1], tuple((s.before, s.after) for s in r.proof)) for r in found.collect())


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_manifest_equals_brute_force(spark, levels):
    sizes = {None: 5, "": 1, "a": 17, "b": 256, "ä": 273, "z": 16, **{f"s{i}": 2 for i in range(14)}}
    ids = itertools.count()
    rows = [(next(ids) * 7 % 997, f"T {s} {i}", "en", s, i) for s, n in sizes.items() for i in range(n)]
    rows += [(None, None, None, "a", None), (5000, "é", None, "b", 1), (5000, "é", None, "b", 1), (5000, "other", None, "b", 2)]
    docs = documents(spark, rows).repartition(5)
    found = merkle.manifest(docs, levels=levels)
    assert found.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    assert manifest_bag(found) == expected_manifest(rows)
    assert merkle.fold(found.first().leaf, [s.asDict() for s in found.first().proof]) == found.first().root


def test_manifest_of_many_blocks(spark):
    rows = [(i, str(i), "en", "hot", i) for i in range(4400)] + [(9000 + i, "x", "en", f"c{i % 3}", 0) for i in range(40)]
    found = merkle.manifest(documents(spark, rows), levels=1)  # 275 blocks: three rounds, the last subtrees not full
    assert manifest_bag(found) == expected_manifest(rows)


def test_tampered_rows_are_told(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}", i) for i in range(100)]
    text = F.when(F.col("doc_id") % 10 == 3, F.lower("text")).otherwise(F.col("text"))
    claims = {i: leaf_of([i, f"s{i % 3}", "en", i, f"text {i}"]) for i in range(100) if i % 10 == 3}
    found = merkle.manifest(documents(spark, rows), claimed={"text": text})
    assert manifest_bag(found) == expected_manifest(rows, claims)
    assert {r.doc_id for r in found.where("NOT verified").collect()} == set(claims)


def test_manifest_of_odd_tables(spark):
    assert merkle.manifest(empty(spark)).collect() == []
    one = merkle.manifest(documents(spark, [(1, None, None, None, None)])).first()
    assert (one.leaf, one.leaf, one.proof, one.verified) == (one.subroot, one.root, [], True)
    odd = [(i, t, "en", "src0", 0) for i, t, *_ in odd_rows()]
    assert manifest_bag(merkle.manifest(documents(spark, odd))) == expected_manifest(odd)


@pytest.mark.parametrize("name", ["op5_decontaminate", "op8_substring_dedup", "op11_suffix_dedup", "op12_filter_audit", "op13_merkle_manifest"])
def test_queries_equal_sql(spark, name):
    assert difference(spark_bag(QUERIES[name](spark, SF)), sql_bag(connect(SF), ORACLES[name])) is None
