"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as larger (L) or smaller (S) than their successor. Leftmost smaller substrings are sorted and
named; where names repeat, the string of names, a third as long, is sorted by prefix doubling. The sorted leftmost smaller
suffixes induce all L suffixes in one ascending sweep, those induce all S suffixes in one descending sweep. A sweep takes
neighbouring buckets together, so that its steps are array operations: what a group of buckets induces in itself
is found by repetition, and a group that needs many is halved, down to one bucket, which grows at its end.
"""

from __future__ import annotations

import numpy as np

#: A sweep takes buckets together until they hold so many suffixes.
_GROUP = 1 << 10
#: Buckets with longer chains among themselves are taken in two halves.
_REPEATS = 100


def _groups(counts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of buckets with about _GROUP members each; a larger bucket is alone."""
    ends = np.cumsum(counts)
    out, low = [], 0
    while low < len(counts):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + _GROUP, side="right")))
        out.append((low, high))
        low = high
    return out


def induced(text: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, n_symbols: int) -> np.ndarray:
    """All positions that are `wanted`, in order, from the ordered `seeds`, which are not.

    A wanted position's symbol is not below its successor's; within a bucket wanted positions precede seeds.
    """
    members = np.bincount(text[wanted], minlength=n_symbols)
    begin = np.concatenate(([0], np.cumsum(members)))
    out, head = np.empty(int(begin[-1]), np.int32), begin[:-1].copy()
    seeds = seeds[seeds > 0]
    seeds = seeds[wanted[seeds - 1]]
    seed_at = np.concatenate(([0], np.cumsum(np.bincount(text[seeds], minlength=n_symbols))))

    def before(rows: np.ndarray) -> np.ndarray:
        previous = rows[rows > 0] - 1
        return previous[wanted[previous]]

    def place(rows: np.ndarray) -> None:
        symbols = text[rows]
        order = _order(symbols, n_symbols)
        symbols = symbols[order]
        first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        n = np.diff(np.append(first, len(rows)))
        which = symbols[first]
        out[np.repeat(head[which] - first, n) + np.arange(len(rows))] = rows[order]
        head[which] += n

    groups = _groups(members + np.diff(seed_at))[::-1]
    while groups:
        low, high = groups.pop()
        at, ending = int(begin[low]), seeds[seed_at[low] : seed_at[high]]
        if high - low == 1:  # a run of one symbol: each step appends what the last one induced
            later, end = [], int(head[low])
            while at < end:
                previous = before(out[at:end])
                inside = text[previous] == low
                later.append(previous[~inside])
                same = previous[inside]
                at, end = end, end + len(same)
                out[at:end] = same
            later.append(ending - 1)
            later = np.concatenate(later)
        else:
            filled = head[low:high] - begin[low:high]
            placed = out[np.repeat(begin[low:high] - np.cumsum(filled) + filled, filled) + np.arange(int(filled.sum()))]
            ordered, n, tries = _sorted_by(text, [placed, ending], low, high), -1, 0
            while n != len(ordered) and tries < _REPEATS:  # a repetition adds the members whose successor the last one added
                n, tries = len(ordered), tries + 1
                previous = before(ordered)
                ordered = _sorted_by(text, [placed, previous[text[previous] < high], ending], low, high)
            if n != len(ordered):
                middle = (low + high) // 2
                groups += [(middle, high), (low, middle)]
                continue
            later = previous[text[previous] >= high]
            own = ordered[wanted[ordered]]
            out[at : at + len(own)] = own
        if len(later):
            place(later)
    return out


def _sorted_by(text: np.ndarray, rows: list[np.ndarray], low: int, high: int) -> np.ndarray:
    joined = np.concatenate(rows)
    return joined[_order(text[joined] - low, high - low)]


def _order(symbols: np.ndarray, n: int) -> np.ndarray:
    """A stable order of symbols below n; few of them are sorted by radix."""
    return np.argsort(symbols.astype(np.uint16) if n <= 1 << 16 else symbols, kind="stable")


def _smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor; the last one counts as larger than the empty suffix."""
    n = len(text)
    differs = np.flatnonzero(np.concatenate((text[1:] != text[:-1], [True])))
    at = np.repeat(differs, np.diff(differs, prepend=-1))
    following = np.append(text[1:], text.dtype.type(-1))
    return (text < following)[at]


def _names(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost smaller substrings, each with the first symbol of the next one.

    A substring that another one continues is the larger of the two, so what ends is filled with the largest value;
    the last one ends with the text, which is smaller than everything.
    """
    ends = np.append(starts[1:] + 1, np.int32(len(text)))
    largest = int(text.max()) + 1
    padded = np.concatenate((text + 1, np.zeros(1, text.dtype)))  # 0: the end of the text
    ends[-1] += 1
    width = max(1, 62 // int(largest + 1).bit_length())
    scale = np.int64(largest + 2)
    names, live, offset, taken = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0, 1
    while len(live):
        key = np.zeros(len(live), np.int64)
        for k in range(offset, offset + width):
            at = starts[live] + k
            inside = at < ends[live]
            key = key * scale + np.where(inside, padded[np.minimum(at, len(text))], largest + 1)
        order = np.lexsort((key, names[live]))
        rows, value = names[live][order], key[order]
        changed = np.concatenate(([True], (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])))
        # names keep room for all members below them, so refined names stay between their neighbours'
        group = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        base = np.repeat(group, np.diff(np.append(group, len(rows))))
        refined = rows + (np.maximum.accumulate(np.where(changed, np.arange(len(rows)), 0)) - base)
        names[live[order]] = refined
        offset += width
        several = np.bincount(np.cumsum(changed) - 1) > 1
        again = np.zeros(len(live), bool)
        again[order] = several[np.cumsum(changed) - 1]
        live = live[again & (starts[live] + offset <= ends[live])]  # what ends here is told from what goes on by one more look
    used = np.zeros(len(starts) + 1, bool)
    used[names] = True
    return (np.cumsum(used)[names] - 1).astype(np.int32), int(used.sum())


def by_doubling(text: np.ndarray) -> np.ndarray:
    """The suffix array of a string of names: ranks by the first symbols, then by twice as many in each round, among those not yet told apart."""
    n, bits = len(text), int(text.max()).bit_length() + 1
    width = max(1, 62 // bits)
    padded = np.concatenate((text.astype(np.int64) + 1, np.zeros(width, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = key << bits | padded[k : n + k]
    order, places, rank = np.arange(n), np.arange(n), np.full(n + 1, -1, np.int64)  # the last: the end of the text
    while len(places):
        by = np.argsort(key)
        rows, key = order[places][by], key[by]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        order[places], rank[rows] = rows, np.maximum.accumulate(np.where(first, places, 0))
        places = places[~(first & np.append(first[1:], True))]
        rows = order[places]
        key = rank[rows] * (n + 1) + rank[np.minimum(rows + width, n)] + 1
        width *= 2
    return order.astype(np.int32)


def suffix_array(text: np.ndarray, n_symbols: int | None = None) -> np.ndarray:
    """Positions of all suffixes of a string of fewer than 2**31 symbols from 0, in ascending order; a suffix precedes its continuations."""
    text = text.astype(np.int32)
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    n_symbols = int(text.max()) + 1 if n_symbols is None else n_symbols
    small = _smaller(text)
    starts = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(starts):
        names, distinct = _names(text, starts)
        order = np.argsort(names) if distinct == len(starts) else by_doubling(names)
        seeds = starts[order]
    else:
        seeds = starts
    # the end of the text is the smallest suffix of all: its predecessor comes first in its bucket
    large = _with_end(text, ~small, seeds, n_symbols)
    falling = induced(n_symbols - 1 - text, small, large[::-1], n_symbols)
    both = np.concatenate((large, falling[::-1]))
    return both[np.argsort(text[both], kind="stable")]


def _with_end(text: np.ndarray, large: np.ndarray, seeds: np.ndarray, n_symbols: int) -> np.ndarray:
    """`induced` for a text that ends with a symbol smaller than all others."""
    ended = np.append(text + 1, np.int32(0))
    return induced(ended, np.append(large, False), np.concatenate((np.array([len(text)], np.int32), seeds)), n_symbols + 1)


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the common prefix of its suffix and the one before it in order, and that one's position
    (-1 for none).

    Where a suffix and its neighbour are preceded by the same symbol, the value is one less than that of the position
    before; only the others are compared, a word of several symbols at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    position = np.arange(n, dtype=np.int32)
    same = (before > 0) & (position > 0)
    same[same] = text[position[same] - 1] == text[before[same] - 1]
    heads = np.flatnonzero(~same)
    length = np.zeros(n, np.int32)
    live = heads[before[heads] >= 0].astype(np.int32)
    other = before[live]
    bits = int(text.max() if n else 0).bit_length() + 1
    each = 64 // bits  # symbols in a word; 0 ends the text
    padded = np.concatenate((text.astype(np.uint64) + np.uint64(1), np.zeros(each, np.uint64)))
    words = np.zeros(n, np.uint64)
    for k in range(each):
        words |= padded[k : n + k] << np.uint64(bits * (each - 1 - k))
    done = 0
    while len(live):
        inside = np.maximum(live, other) < n - done
        if not inside.all():
            length[live[~inside]] = done
            live, other = live[inside], other[inside]
        differs = words[live + done] ^ words[other + done]
        equal = differs == 0
        ended = np.flatnonzero(~equal)
        at, differs = live[ended], differs[ended]
        same_symbols = np.zeros(len(at), np.int32)
        for k in range(each):
            same_symbols += differs < np.uint64(1 << (bits * (each - 1 - k)))
        length[at] = done + same_symbols
        live, other = live[equal], other[equal]
        done += each
    head = np.maximum.accumulate(np.where(same, 0, position))
    return np.where(same, length[head] - (position - head), length), before
