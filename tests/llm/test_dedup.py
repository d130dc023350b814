"""Near copies, repeated passages and benchmark passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from array import array

import numpy as np
import pyarrow as pa
import pytest
from common import SPACED, documents, empty, low, odd_rows, prose

from probelens.llm import decontaminate, keyed, ngram_jaccard, substring_dedup
from probelens.llm.words import SPACES, Words


def test_words_and_windows_of_a_batch():
    texts = [None, "", " a bc\td", "d bc a", "bc d a bc d", "É é x"]
    words = Words(pa.array(texts), SPACES, lower=True)
    spelled = [words.buf[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends)]
    assert spelled == [w for t in texts for w in SPACED.findall(t or "")] and words.counts.tolist() == [0, 0, 3, 3, 5, 2]
    by_word = {}
    assert all(by_word.setdefault(w, h) == h for w, h in zip(spelled, words.hashes.tolist())) and len(set(by_word.values())) == len(by_word)
    hashes, counts = words.windows(2)
    pairs = [tuple(w[i : i + 2]) for t in texts for w in [SPACED.findall(t or "")] for i in range(len(w) - 1)]
    assert counts.tolist() == [0, 0, 2, 2, 4, 1] and len({*zip(pairs, hashes.tolist())}) == len(set(pairs)) == len(set(hashes.tolist()))


def test_dealt_keys_come_back_to_their_owners():
    rng = np.random.default_rng(1)
    keys, owners = rng.integers(0, 1 << 63, 50, dtype=np.uint64), np.array([5, 3, 9])
    batch = keyed.deal(keys, np.array([20, 0, 30]), owners, 4, 7)
    seen = {}
    for part in keyed.parts(iter([batch]), np.dtype("<i8"), 7):
        for k, e in zip(part.keys.tolist(), part.entry.tolist()):
            seen.setdefault(int(part.owners[e]), []).append(k)
    mask = (1 << 56) - 1
    assert {k: sorted(v) for k, v in seen.items()} == {5: sorted(int(k) & mask for k in keys[:20]), 9: sorted(int(k) & mask for k in keys[20:])}


def shingles(text):
    w = SPACED.findall(low(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_components(rows):
    sets, parent = [(d, shingles(t)) for d, t in rows], {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets)


def edited(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(50))
    return " ".join(words)


@pytest.mark.parametrize("crowded,block", [(1000, 1 << 19), (2, 300)])
def test_components_equal_brute_force(spark, monkeypatch, crowded, block):
    """With small limits every shingle of a large group is hot, and families take several blocks and queries across."""
    monkeypatch.setattr(ngram_jaccard, "CROWDED", crowded)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    rng, rows = random.Random(7), []
    for g in range(6):
        base = prose(100 + g, 60)
        rows += [(len(rows) + k, edited(base, rng, rng.choice([0, 1, 1, 2, 3]))) for k in range([25, 9, 4, 2, 2, 1][g])]
    passage = prose(999, 40)
    rows += [(200 + k, prose(500 + k, 30 + 10 * k) + " " + passage) for k in range(12)]
    rows += [(300, "a b"), (301, "A b"), (302, "a b c"), (303, "")]
    found = ngram_jaccard.near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(tuple, found)) == brute_components(rows)


def test_near_duplicates_of_odd_rows(spark):
    found = ngram_jaccard.near_duplicates(documents(spark, odd_rows())).collect()
    assert len(found) == len(odd_rows())
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add((r.n_shingles > 0, r.component_id))
    assert by_id[1] == by_id[2] == by_id[8] == {(True, 1)} and by_id[3] == {(False, 3)} and by_id[5] == {(False, 5)}
    assert by_id[6] == by_id[7] == {(True, 6)} and by_id[None] == {(True, 1), (False, None)}
    assert ngram_jaccard.near_duplicates(empty(spark)).isEmpty()


@pytest.mark.parametrize("many", [10_000, 0])
def test_divide_skip_counts(monkeypatch, many):
    monkeypatch.setattr(ngram_jaccard, "MANY", many)
    rng = random.Random(3)
    lists = [array("i", sorted(rng.sample(range(300), n))) for n in (3, 10, 40, 120, 200, 250, 290)]
    for least in range(1, 8):
        counted = {x: sum(x in s for s in map(set, lists)) for x in range(300)}
        assert dict(ngram_jaccard.divide_skip(lists, least)) == {x: n for x, n in counted.items() if n >= least}


def brute_repeats(rows, width=50):
    first, out = {}, []
    for d, t in rows:
        w = SPACED.findall(t or "")
        for i in range(len(w) - width + 1):
            first[tuple(w[i : i + width])] = min(d, first.get(tuple(w[i : i + width]), d))
    for d, t in rows:
        w, drop = SPACED.findall(t or ""), set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                drop |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in drop)
        out.append((d, len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("frequent", [1000, 1])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    passage, rows = prose(1, 70), []
    for i in range(30):
        own = prose(10 + i, 20 + i)
        rows.append((i, [own, own + " " + passage, passage + "\n" + own, passage, own + " " + passage[:200], passage + " " + own + " " + passage][i % 6]))
    rows += [(100, rows[3][1]), (101, None), (102, " "), (103, prose(5, 49)), (104, prose(5, 50)), (105, prose(5, 50))]
    found = substring_dedup.without_repeats(documents(spark, rows)).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found)
    assert got == brute_repeats(rows)
    assert all(r.n_removed == sum(x.end - x.start for x in r.removed) for r in found)


def test_repeats_of_odd_rows(spark):
    found = substring_dedup.without_repeats(documents(spark, odd_rows()), carry=["doc_id", "found"]).collect()
    assert len(found) == len(odd_rows()) and found[0].found == "x"
    removed = sorted((str(r.doc_id), r.n_removed) for r in found if r.n_removed)
    assert removed == [("2", 120), ("2", 120), ("8", 120), ("None", 120)]
    assert substring_dedup.without_repeats(empty(spark)).isEmpty()


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(rows, items, width=10):
    windows = {}
    for item, t in items:
        w = ALNUM.findall(low(t))
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for d, t in rows:
        w, hit, who = ALNUM.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    who |= found
        out.append((str(d), len(w), len(hit), tuple(sorted(who))))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_contamination_equals_brute_force(spark, block_bytes):
    items = [(1, prose(1, 14)), (2, "Short item, three-words!"), (3, None), (4, " ,. "), (10, prose(1, 14)), (11, prose(2, 10)), (12, "é")]
    rows = [(1, prose(9, 20) + ". " + prose(1, 14).upper() + " end"), (2, "xshort item three words"), (3, "(short)\nITEM three words; short item three words"),
            (4, prose(2, 9)), (5, None), (6, ""), (7, prose(2, 10) + prose(2, 10)), (8, "É é ée"), (9, " ".join(prose(1, 14).split()[3:13]))]
    benchmark = spark.createDataFrame([(*x, "z") for x in items], "item_id BIGINT, text STRING, item STRING")
    found = decontaminate.contamination(documents(spark, rows), benchmark, block_bytes=block_bytes).collect()
    got = sorted((str(r.doc_id), r.n_words, sum(h.end - h.start for h in r.hits), tuple(r["items"])) for r in found)
    assert got == brute_contamination(rows, items)
    texts = dict(rows)
    for r in found:  # spans are of the original text
        for h, s in zip(r.hits, r.spans):
            assert ALNUM.findall(low(texts[r.doc_id][s.start : s.end])) == ALNUM.findall(low(texts[r.doc_id]))[h.start : h.end]


def test_contamination_of_odd_rows(spark):
    benchmark = spark.createDataFrame([(1, prose(1, 12)), (None, "one")], "item_id BIGINT, text STRING")
    found = decontaminate.contamination(documents(spark, odd_rows()), benchmark).collect()
    assert len(found) == len(odd_rows()) and {r.doc_id for r in found if r.hits} == {1, 2, 6, 7, 8, None}
    assert all(not r.hits for r in decontaminate.contamination(documents(spark, odd_rows()), benchmark.limit(0)).collect())
    assert decontaminate.contamination(empty(spark), benchmark).isEmpty()


def test_contamination_of_odd_rows_in_several_passes(spark):
    benchmark = spark.createDataFrame([(1, prose(1, 12)), (None, "one"), (3, "other text of a repeated id"), (4, prose(2, 10))], "item_id BIGINT, text STRING")
    docs = documents(spark, [*odd_rows(), (30, "one two"), (30, "two one"), (30, "one two")])  # texts of one id, with as many words
    row = lambda r: (str(r.doc_id), r.n_words, [tuple(x) for x in r.hits], [tuple(x) for x in r.spans], r["items"])
    passes = [sorted(map(row, decontaminate.contamination(docs, benchmark, block_bytes=n).collect())) for n in (1 << 20, 20)]
    assert passes[0] == passes[1] and len(passes[1]) == len(odd_rows()) + 3
