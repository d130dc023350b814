"""Packing: documents cut and placed into sequences of a fixed number of tokens, with bounded space.

Each task keeps at most `open_windows` windows open. A document's full windows are emitted at once; what is left
over goes into the open window it fits best. If it fits into none and no more may be opened, the fullest is emitted.
Windows still open at the end of a task are merged afterwards in groups of bounded size, largest first, each
into the fullest that takes it. Only descriptions of pieces are kept: tokens are checksummed where they are made.

The first step is written to the shared folder, so that both later uses see the same windows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from probelens.llm.store import parts_of, small_batches, written
from probelens.llm.words import SPACES, Words, ranges, slices

WINDOW = 2048
OPEN_WINDOWS = 64
END_ID = 1
#: Open windows that are merged in one group.
MERGED = 4096
#: Words whose ids a task remembers.
REMEMBERED = 1_000_000


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others
    in order from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of a word BPE whose words never span white space. Words of plain Latin text are looked up, or encoded
    once by the model alone and remembered; a text with any other character is encoded whole. With `added`, literals of added tokens give
    these tokens' ids, as by the tokenizer's defaults, and a text that may hold one is encoded whole; else they are text.
    Remembered words are told apart by 64 bits of hash."""

    #: The vocabulary's own split of a word. A word of letters alone is one piece.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    #: Composed letters whose lower case is one letter, ASCII, and plain white space.
    OTHER = re.compile("[^\t-\r -~¡-įı-ɏ]")

    def __init__(self, path: str, remembered: int = REMEMBERED, added: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.literals = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.model, self.remembered = self.tokenizer.model, remembered
        self.characters = _byte_characters()
        self.forget()

    def forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes of words, ascending, and where their ids are
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Ids of words in lower case, each encoded once, by the model alone."""
        tokenize, pieces_of, characters = self.model.tokenize, self.PIECES.findall, self.characters
        ids: list[int] = []
        ends = [0]
        for word in words:
            for piece in (word,) if word.isalpha() else pieces_of(word):
                bytewise = piece if piece.isascii() else piece.encode().decode("latin-1").translate(characters)
                ids += [t.id for t in tokenize(bytewise)]
            ends.append(len(ids))
        bounds = np.array(ends, np.int64)
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known)
        self.known, self.place = known[order], np.concatenate((self.place, np.arange(len(self.starts), len(known))))[order]
        self.starts, self.lengths = np.concatenate((self.starts, len(self.pool) + bounds[:-1])), np.concatenate((self.lengths, np.diff(bounds)))
        self.pool = np.concatenate((self.pool, np.array(ids, np.int32)))

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. Each different word is looked up once, by its hash; those that no text before had are learnt together."""
        if len(self.known) > self.remembered:
            self.forget()
        lower = [t.lower() for t in texts]
        whole = [bool(self.OTHER.search(t)) or any(x in low for x in self.literals) for t, low in zip(texts, lower)]
        words = Words(pa.array(["" if w else low for w, low in zip(whole, lower)], pa.large_string()), SPACES)
        distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)] != distinct
        if new.any():
            data = words.buf.tobytes()
            spans = zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())
            self.learn([data[a:b].decode() for a, b in spans], distinct[new])
        if len(distinct):
            which = self.place[np.searchsorted(self.known, distinct)][which]
        for text, alone, at, n in zip(texts, whole, words.first.tolist(), words.counts.tolist()):
            if alone:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                continue
            own = which[at : at + n]
            lengths = self.lengths[own]
            yield self.pool[np.repeat(self.starts[own], lengths) + ranges(lengths)]

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path, added=True)
    return _ENCODERS[path]


class Windows:
    """A bounded number of open windows, ordered by free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[tuple[int, int]] = []
        self.pieces: dict[int, list[tuple]] = {}
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, length: int, piece: tuple) -> list[tuple[int, int, tuple]]:
        """Put a piece into the window it fits best; what had to be emitted for it: (window, offset, piece)."""
        out = []
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                out = self.close(self.free.pop(0)[1])
            free, window = self.size, self.new()
            self.pieces[window] = []
        self.pieces[window].append((self.size - free, piece))
        if free > length:
            insort(self.free, (free - length, window))
        else:
            out += self.close(window)
        return out

    def close(self, window: int) -> list[tuple[int, int, tuple]]:
        return [(window, offset, piece) for offset, piece in self.pieces.pop(window)]


_PIECES = "start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, window BIGINT, offset BIGINT, open BOOLEAN"
_TYPES = (pa.int64(),) * 6 + (pa.bool_(),)
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


def _place(path: str, size: int, most: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, windows = encoder(path), Windows(size, most)
        base, schema = TaskContext.get().partitionId() << 32, None
        rows: list[tuple] = []

        def emit(placed: list[tuple[int, int, tuple]], is_open: bool) -> None:
            rows.extend((*p, base + w, offset, is_open) for w, offset, p in placed)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*schema.types[:-1], *_TYPES))], names=[*schema.names[:-1], *_NAMES])

        for batch in slices(batches, "__text"):
            schema = batch.schema
            *carried, texts = (c.to_pylist() for c in batch.columns)
            for *own, found in zip(*carried, ids_of.encode_many([t or "" for t in texts])):
                ids = np.append(found, end_id).astype("<u4")
                total = len(ids)
                for start in range(0, total, size):
                    some = ids[start : start + size]
                    piece = (*own, start, len(some), zlib.crc32(some.tobytes()), total)
                    emit([(windows.new(), 0, piece)] if len(some) == size else windows.place(len(some), piece), False)
            if len(rows) > 5000:
                yield flush()
        for _, window in list(windows.free):
            emit(windows.close(window), True)
        if rows:
            yield flush()

    return run


def _merge(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for group, used, window in zip(*(batch.column(n).to_pylist() for n in ("group", "used", "window"))):
                groups.setdefault(group, []).append((used, window))
        out = []
        for members in groups.values():
            free: list[tuple[int, int]] = []
            for used, window in sorted(members, reverse=True):
                at = bisect_left(free, (used, -(1 << 63)))
                room, into = free.pop(at) if at < len(free) else (size, window)
                out.append((window, into, size - room))
                if room > used:
                    insort(free, (room - used, into))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["window", "into", "shift"])

    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", carry: Sequence[str] = ("doc_id",), size: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: the `carry` columns, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document is its ids followed by `end_id`; a null or empty text is that id alone. Pieces of a sequence have no
    gap between them; what is missing to `size` at its end is padding. Documents longer than a window are cut at its
    multiples. Ids are those of the tokenizer's defaults, so the literal of an added token is that token. Repeated rows are packed each for itself; other columns are ignored. No documents give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*carry, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [_PIECES])
    placed = written(rows.mapInArrow(_place(tokenizer, size, open_windows, end_id), schema), "pieces")
    left = placed.where("open").groupBy("window").agg(F.sum("length").alias("used"))
    groups = -(-left.count() // MERGED) or 1
    grouped = left.withColumn("group", F.pmod(F.xxhash64("window"), F.lit(groups))).repartition(min(groups, parts_of(spark)), "group")
    merged = grouped.mapInArrow(_merge(size), "window BIGINT, into BIGINT, shift BIGINT")
    out = [*carry, "start", "length", "ids_crc32", "doc_tokens"]
    closed = placed.where("NOT open").select(*out, F.col("window").alias("sequence_id"), "offset")
    moved = placed.where("open").join(merged, "window").select(*out, F.col("into").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return closed.unionAll(moved)


def word_bpe() -> str:
    """The place of the public word vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe())
