"""Packing: an exact round trip, and tokens against the tokenizer itself."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from common import documents, empty, odd_rows, prose
from tokenizers import Tokenizer

from probelens.llm import packing

PATH = packing.word_bpe()


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


TEXTS = [
    "It's they'll we'd I'm you've 'S x's''t", "Über ÀÉÎ ß İ ǅ ﬁ é x y\x85z\x1cw", "<|endoftext|> a<|startoftext|>b", "1234 5a6 ٣٤ ² ½ _a_ --- ... 🙂🙂 中文", " a​b",
    "token = \"2abc\" #*$%&|<> a,b.c", "ΑΣ Σ ΣΑΣ", "é" * 50, "", " \t ", prose(4, 300),
]


@pytest.mark.parametrize("remembered", [400_000, 3])
def test_ids_are_the_tokenizers(whole, remembered):
    ids = packing.WordIds(PATH, remembered)
    for text in TEXTS * 2:
        assert ids.encode(text).tolist() == whole(text), text


def check(found, rows, whole, size):
    """Every id of every document lies in one piece; sequences have no gaps and fit."""
    expected = sorted((str(d), tuple(whole(t) + [1])) for d, t in rows)
    docs, sequences = {}, {}
    for r in found:
        docs.setdefault(str(r.doc_id), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for place in sequences.values():
        place.sort()
        assert place[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(place, place[1:])) and sum(place[-1]) <= size
    once = [x for x in expected if [e[0] for e in expected].count(x[0]) == 1]
    for doc, ids in once:
        pieces, at = sorted(docs[doc], key=lambda r: r.start), 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in found) == sum(len(ids) for _, ids in expected)
    return len(sequences)


def test_round_trip_with_little_padding(spark, whole):
    rows = [(i, prose(i, 5 + i * 7 % 400)) for i in range(300)]
    found = packing.pack(documents(spark, rows).repartition(5), PATH, size=256, open_windows=8).collect()
    n = check(found, rows, whole, 256)
    assert n * 256 <= 1.05 * sum(r.length for r in found)


def test_odd_rows(spark, whole):
    found = packing.pack(documents(spark, odd_rows()), PATH).collect()
    check(found, odd_rows(), whole, packing.WINDOW)
    assert packing.pack(empty(spark), PATH).isEmpty()


def test_literals_of_added_tokens_are_these_tokens(spark):
    plain = Tokenizer.from_file(PATH)
    unmodified = lambda text: plain.encode(text or "", add_special_tokens=False).ids
    assert unmodified("hello <|endoftext|> b")[1] == plain.token_to_id("<|endoftext|>")
    texts = [*TEXTS, "hello <|endoftext|> b", "a<|ENDOFTEXT|>b <|startoftext|>", "<|endoftext|", "<|endoftext|><|endoftext|>"]
    ids = packing.WordIds(PATH, added=True)
    for text in texts * 2:
        assert ids.encode(text).tolist() == unmodified(text), text
    rows = list(enumerate(texts))
    check(packing.pack(documents(spark, rows), PATH).collect(), rows, unmodified, packing.WINDOW)


def test_at_most_so_many_windows_are_open():
    windows = packing.Windows(10, 2)
    assert windows.place(6, ("a",)) == [] and windows.place(5, ("b",)) == []
    assert windows.place(4, ("c",)) == [(0, 0, ("a",)), (0, 6, ("c",))]  # full at once
    assert windows.place(7, ("d",)) == [] and windows.place(8, ("e",)) == [(2, 0, ("d",))]  # the fullest
    assert [w for _, w in windows.free] == [3, 1]
