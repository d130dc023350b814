"""Toxicity, language identification and language-model scores: held-out quality and exact parts."""

from __future__ import annotations

import collections
import math
import random
import time
import zlib

import numpy as np
from common import SPACED, documents, empty, low, odd_rows, prose
from pyspark.sql import functions as F

from probelens.llm import language_id, lm_scoring, toxicity

LANGUAGES = {"aa": ("an", "the", "on", "ing"), "bb": ("sch", "ung", "der", "ich"), "cc": ("que", "ción", "los", "ñe")}


def labelled(spark, n=240):
    return documents(spark, [(i, prose(i, 3 + i % 40, LANGUAGES[k]), k) for i in range(n) for k in [sorted(LANGUAGES)[i % 3]]])


def test_languages_of_held_out_texts(spark):
    docs = labelled(spark)
    model = language_id.fit(docs.where("doc_id % 4 <> 2"), "doc_id", "text", "lang", rows_per_language=60)
    found = language_id.identify(docs.where("doc_id % 4 = 2"), model, carry=["doc_id", "lang"]).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found) and all(0 <= r.score <= 1 for r in found)
    again = language_id.fit(docs.where("doc_id % 4 <> 2"), "doc_id", "text", "lang", rows_per_language=60)
    assert np.array_equal(model.table, again.table)


def test_language_of_odd_rows(spark):
    model = language_id.fit(labelled(spark), "doc_id", "text", "lang")
    found = language_id.identify(documents(spark, [*odd_rows(), (50, "123 ... %%")]), model).collect()
    assert len(found) == len(odd_rows()) + 1
    for r in found:
        assert (r.lang_pred == "und") == (r.doc_id in (3, 4, 5, 50) or r.doc_id is None and r.lang_pred == "und") and (r.lang_pred != "und" or r.score == 0 and r.rejected)
    assert language_id.fit(empty(spark), "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in language_id.identify(labelled(spark, 9), None).collect()} == {"und"}


def toxic_table(spark, n=600):
    rng, rows, labels = random.Random(5), [], []
    for i in range(n):
        words = prose(i, 20 + i % 60).split()
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["blorg", "grumphe"]) + rng.choice(["", "an", "ti"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0), "x"))
    return documents(spark, rows), spark.createDataFrame([*labels, (0, 1, 1, "x"), (None, 1, 1, "x"), (5, 1, None, "x"), (10_000, 0, 1, "x")], "doc_id BIGINT, quality INT, toxic INT, text STRING")


def test_toxic_words_of_held_out_texts(spark):
    docs, labels = toxic_table(spark)
    rest = F.col("doc_id") % 5
    model = toxicity.fit(docs, labels, rest.isin(1, 2, 3), rest == 4)
    found = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id % 5 = 0"), model).collect()}
    right = sum((s >= 0.5) == (d % 4 == 0) for d, s in found.items())
    assert right >= 0.97 * len(found) and all(0 <= s <= 1 for s in found.values())
    odd = toxicity.score(documents(spark, odd_rows()), model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r.score <= 1 for r in odd)
    assert all(r.score < 0.5 for r in odd if r.doc_id in (3, 4, 5))
    assert toxicity.fit(docs, labels.where("toxic = 0"), rest.isin(1, 2, 3), rest == 4) is None
    assert toxicity.fit(empty(spark), labels, rest.isin(1, 2, 3), rest == 4) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_counts_come_from_8000_rows_of_a_class(spark):
    labels = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic"))
    assert 7800 < toxicity.sample(labels, "doc_id", "toxic", toxicity.COUNTED_ROWS, 1).count() < 8200


def test_the_shared_order_smooths_what_a_class_has_not_seen():
    import pyarrow as pa

    model = toxicity.count(pa.table({"word": pa.array([b"bad", b"word", b"wording"]), "toxic": [9, 1, 0], "ordinary": [0, 9, 9]}))
    buf = np.frombuffer(b"bad word badly", np.uint8)
    bad, word, badly = model.differences(toxicity.Spelling(buf, np.array([0, 4, 9]), np.array([3, 8, 14])))
    assert bad > badly > 0 > word


def base_scores(rows, train):
    tokens = {d: [*SPACED.findall(low(t)), None] for d, t in rows}
    c = collections.Counter(w for d, ws in tokens.items() if train(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for d, ws in tokens.items()}


def test_base_scores_equal_brute_force_and_the_model_is_better(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEADS", 500)  # most words are no heads
    rng = random.Random(2)
    pairs = {w: [rng.choice(prose(1, 40).split()) for _ in range(3)] for w in prose(1, 40).split()}

    def text(seed):
        r, out = random.Random(seed), [sorted(pairs)[seed % len(pairs)]]
        for _ in range(60):
            out.append(r.choice(pairs.get(out[-1], sorted(pairs))))
        return " ".join(out) + f" rare{seed % 90} Only{seed}"

    rows = [(i, text(i)) for i in range(300)] + [(400, None), (401, ""), (402, " \n")]
    train = lambda d: zlib.crc32(str(d).encode()) % 5 != 1
    found = lm_scoring.score(documents(spark, rows), ~language_id.held_out("doc_id", 5, 1)).collect()
    expected = base_scores(rows, train)
    for r in found:
        n_tokens, n_known, total, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in found if not train(r.doc_id) and r.n_tokens > 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_and_word_probabilities_sum_to_one():
    counts = lm_scoring.Counts(np.sort(np.random.default_rng(1).integers(0, 1 << 62, 50, dtype=np.uint64)), np.arange(1, 51), 2000, 300, 20)
    model = lm_scoring.Model(counts)
    model.by_class += np.random.default_rng(2).normal(size=model.by_class.shape).astype(np.float32)
    ids = np.arange(lm_scoring.TOKENS)
    before = np.tile([3, 4, 5], (len(ids), 1))
    assert math.isclose(np.exp(model.log_probability(ids, before)).sum(), 1, rel_tol=1e-4)


def plain_step(model, ids, before, seen):
    """A step of `descend` feature by feature, with all errors sorted and added up in full."""
    features = np.ascontiguousarray(model.features(before)).reshape(lm_scoring.FEATURES, -1)
    for k, (weights, squares) in enumerate(zip(model.weights, seen)):
        node = ids // lm_scoring.BRANCHES ** (model.depth - k)
        inner = lm_scoring.mix(features ^ (node.astype(np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)) if k else features
        at = ((inner >> np.uint64(32)) % np.uint64(len(weights))).astype(np.int64)
        z = model.bias[k][node] + sum(weights[rows] for rows in at)
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        error = np.exp(z)
        error[np.arange(len(ids)), ids // lm_scoring.BRANCHES ** (model.depth - k - 1) % lm_scoring.BRANCHES] -= 1
        for rows in at:
            order = np.argsort(rows, kind="stable")
            own = rows[order]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            gradient, row = np.add.reduceat(error[order], first, axis=0), own[first]
            squares[row] += (gradient**2).mean(axis=1)
            weights[row] -= lm_scoring.RATE * gradient / np.sqrt(squares[row] + 1e-3)[:, None]


def test_a_step_equals_the_plain_one_in_less_time():
    rng, heads = np.random.default_rng(4), 20_000
    counts = lm_scoring.Counts(np.arange(heads, dtype=np.uint64) * np.uint64(7919), np.arange(heads, 0, -1) // 100 + 1, 1 << 22, 2 * heads, 20)
    ids = np.minimum(rng.zipf(1.3, (12, 4, lm_scoring.BATCH)), heads + 1)  # a few frequent words and many rare ones
    made, took = [], []
    for step in (lm_scoring.Model.descend, plain_step):
        model, times = lm_scoring.Model(counts), []
        seen = [np.zeros(len(w), np.float32) for w in model.weights]
        for some in ids:
            began = time.process_time()
            step(model, some[0], some[1:].T, seen)
            times.append(time.process_time() - began)
        made.append(model.weights)
        took.append(min(times))
    assert all(np.abs(w).max() > 0.1 and np.allclose(w, v, atol=1e-4) for w, v in zip(*made))
    assert took[0] < 0.7 * took[1]


def test_scores_beyond_single_precision():
    counts = lm_scoring.Counts(np.arange(50, dtype=np.uint64), np.arange(1, 51), 2000, 300, 20)
    model = lm_scoring.Model(counts)
    model.by_class += np.random.default_rng(3).normal(size=model.by_class.shape).astype(np.float32) * 60
    found = model.log_probability(np.arange(lm_scoring.TOKENS), np.tile([3, 4, 5], (lm_scoring.TOKENS, 1)))
    assert np.isfinite(found).all() and math.isclose(np.exp(found).sum(), 1, rel_tol=1e-3)


def test_every_training_token_is_in_a_block():
    import types

    import pyarrow as pa

    counts = lm_scoring.Counts(np.arange(50, dtype=np.uint64), np.arange(1, 51), 2000, 300, 20)
    texts = [prose(i, 1 + i * 37 % 300) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], names=["__hash", "__text"])
    blocks = [x for b in lm_scoring._blocks(types.SimpleNamespace(value=counts))(iter([batch])) for x in b.column("ids").to_pylist()]
    width = len(blocks[0]) // (min(len(texts[0].split()) + 1, lm_scoring.BLOCK) + 3)
    assert sum(len(x) // width - 3 for x in blocks) == sum(len(t.split()) + 1 for t in texts)


def test_vocabulary_and_weights_grow_with_the_training_tokens():
    def counts_of(heads, tokens):
        return lm_scoring.Counts(np.arange(heads, dtype=np.uint64) * np.uint64(7919), np.arange(heads, 0, -1), tokens, 2 * heads, 20)

    few, many = counts_of(50, 2000), counts_of(5000, 100_000_000)
    ids = many.of(many.keys)[2]
    assert len(set(ids.tolist())) == 5000 and lm_scoring.UNKNOWN not in ids  # each head is a word of its own
    small, large = lm_scoring.Model(few), lm_scoring.Model(many)
    assert large.by_class.size >= 4 * small.by_class.size and sum(w.size for w in large.by_word) >= 8 * sum(w.size for w in small.by_word)
    for w in large.weights:
        w += np.random.default_rng(3).normal(size=w.shape).astype(np.float32)
    every = np.arange(lm_scoring.BRANCHES**large.depth)
    assert math.isclose(np.exp(large.log_probability(every, np.tile([4000, 3, 5], (len(every), 1)))).sum(), 1, rel_tol=1e-3)
    least = lambda n: n / (lm_scoring.HEADS * lm_scoring.growth(n, lm_scoring.HEADS_FROM))
    assert least(1 << 30) < (1 << 30) / lm_scoring.HEADS / 8


def test_scores_of_odd_rows(spark):
    found = lm_scoring.score(documents(spark, odd_rows()), F.col("doc_id") % 2 == 1).collect()
    assert len(found) == len(odd_rows()) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    untrained = lm_scoring.score(documents(spark, odd_rows()), F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in untrained} == {(0, 0)}
    assert lm_scoring.score(empty(spark), F.lit(True)).isEmpty()
