"""Polynomial rolling hashes over batches of documents, and the anchors that cut them into segments.

A batch is one array of 64-bit symbols (hashed words, or bytes sent through a table) with the bounds
of its documents. Hashes are sums of symbol times odd base to a power, modulo 2**64, so the hash of
any stretch is one subtraction and one product of prefix sums.

A *segment* is a run of neighbouring windows of one document with the same anchor: the least hash of
the K-symbol grams inside the window. The anchor depends on the window's content alone, so equal
windows lie in segments of equal anchors, and a window can only repeat if its anchor does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
# a segment of periodic text is cut after so many windows; no window is lost by the cut
LONGEST_RUN = 2_048
# bytes of text hashed at a time: the arrays of one piece stay near the CPU caches
PIECE_BYTES = 500_000
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of every value (a 64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A fixed 64-bit value for every byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n, kept for the next batch."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols) + 1)[0][: len(symbols)], out=sums[1:])
    return sums


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] for arrays of starts and ends."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of `width` symbols."""
    n = max(len(sums) - width, 0)
    return (sums[width:] - sums[:n]) * powers(len(sums))[1][:n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours, by running minima from both ends of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def text_pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds of the rows in them) of an Arrow text column; null: empty."""
    column = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, words before each document).

    Words are runs of bytes other than space and the controls 9 to 13, within one document.
    """
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.append(False, inside)
    after = np.append(inside, False)
    starts = np.flatnonzero(after & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~after))
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit value per word, from all its bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = prefix_sums(BYTE_VALUES[data])
    return mix(stretch_hash(sums, starts, ends) + (ends - starts).astype(np.uint64))


class Segments:
    """Segments of a batch: document index, start in the document, windows, anchor, digest, twice."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, width: int, gram: int):
        n = len(symbols) - width + 1
        if n <= 0:
            self.doc = self.start = self.count = np.zeros(0, np.int64)
            self.anchor = self.digest = np.zeros(0, np.uint64)
            self.twice = np.zeros(0, bool)
            return
        sums = prefix_sums(symbols)
        grams = mix(window_hash(sums, gram))
        least = sliding_min(grams, width - gram + 1)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
        inside = np.arange(n) + width <= bounds[doc + 1]
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new & inside)
        ends = np.cumsum(inside)
        count = ends[np.append(first, n)[1:] - 1] - ends[first] + 1
        if len(count) and count.max() > LONGEST_RUN:
            pieces = -(-count // LONGEST_RUN)
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = np.repeat(first, pieces) + step * LONGEST_RUN
            count = np.minimum(np.repeat(count, pieces) - step * LONGEST_RUN, LONGEST_RUN)
        self.count, self.doc, self.anchor = count, doc[first], least[first]
        self.start = first - bounds[self.doc]
        self.digest = mix(stretch_hash(sums, first, first + count - 1 + width)
                          + count.astype(np.uint64))
        # a segment can hold one window twice only if it holds its anchor twice: look for two equal
        # neighbours among the grams that are the least of some window
        reach = width - gram + 1
        none = np.zeros(reach - 1, np.uint64)
        greatest = ~sliding_min(~np.concatenate((none, least, none)), reach)
        chosen = np.flatnonzero(grams == greatest)
        again = np.append(0, np.cumsum(grams[chosen][1:] == grams[chosen][:-1]))
        low = np.searchsorted(chosen, first)
        high = np.searchsorted(chosen, first + count + reach - 1)
        self.twice = again[np.maximum(high - 1, 0)] > again[np.minimum(low, len(again) - 1)]
