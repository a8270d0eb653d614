"""Token ids of texts by a tokenizer library, chunk by chunk, each distinct chunk encoded once.

A chunk is a stretch of text that the tokenizer cannot join with its neighbours, so the ids of a text
are those of its chunks in order. Where chunks may be cut depends on the tokenizer; the two kinds
below are for BPE tokenizers whose words are runs of letters, of digits, or of other characters.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np

from . import rolling

#: Distinct chunks kept per worker and ids of them: the first ones met, common words among them. Others
#: are encoded each time; forgetting all at the bound made common words be encoded again and again.
KEPT_CHUNKS, KEPT_IDS = 2_000_000, 8_000_000
#: Chunks with more ids are encoded each time.
LONGEST_KEPT = 64
#: Bytes of text whose chunks are told apart at a time.
PIECE_BYTES = 1_000_000
# bytes after a space that may open white space of another kind: no cut there
_OPEN = np.zeros(256, bool)
_OPEN[:33] = True
_OPEN[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
# marks that follow words; not those of contractions or of special tokens
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?#%&*$")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _marks_after_letters(data: np.ndarray) -> np.ndarray:
    """Places of marks right after a letter of ASCII or of Latin-1 (C3 and a byte that is no sign)."""
    if len(data) < 2:
        return np.zeros(len(data), bool)
    out = np.zeros(len(data), bool)
    letter = _LETTER[data[:-1]]
    letter[1:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    out[1:] = _MARK[data[1:]] & letter
    return out


def cut_spaces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, chunks before each document) for tokenizers that keep white space: a chunk opens
    with the last space before a word, whatever stands before it, or with the marks after a word."""
    opens = _marks_after_letters(data)
    if len(data):
        opens[:-1] |= (data[:-1] == 32) & ~_OPEN[data[1:]]
    # a document's last space has no word of its own after it
    last = bounds[1:][np.diff(bounds) > 0] - 1
    opens[last] &= data[last] != 32
    opens[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(opens)
    return starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, bounds)


def cut_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for tokenizers that drop white space: words, cut before the marks after them."""
    starts, ends, _ = rolling.words_of(data, bounds)
    marks = _marks_after_letters(data)
    marks[starts] = False
    marks = np.flatnonzero(marks)
    # every mark after a letter lies inside a word, unless a document begins with it
    starts = np.sort(np.concatenate((starts, marks)))
    ends = np.sort(np.concatenate((ends, marks)))
    return starts, ends, np.searchsorted(starts, bounds)


class ChunkEncoder:
    """Ids of the chunks of a batch; remembers what it has encoded.

    What is kept is 64-bit hashes of chunks in order, and where their ids stand in one array: some 30
    bytes a chunk, looked up for a whole piece at once.
    folds: the tokenizer lower-cases, so ASCII case is folded before chunks are told apart.
    """

    def __init__(self, tokenizer_path: str, folds: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.folds = folds
        # a bare word goes to the library's model at once: nothing in it is normalised or split
        self.bare = re.compile(rb"[a-z]+" if folds else rb" ?[A-Za-z]+")
        self.keys, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.size, self.flat, self.used = np.zeros(0, np.uint8), np.zeros(1_000, np.uint32), 0

    def _encode(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all names in order, number of ids of each)."""
        out: list[list[int]] = [[]] * len(names)
        rest = []
        bare, tokenize = self.bare.fullmatch, self.model.tokenize
        for i, name in enumerate(names):
            if bare(name):
                out[i] = [t.id for t in tokenize(name.decode().replace(" ", "Ġ"))]
            else:
                rest.append(i)
        fresh = self.tokenizer.encode_batch_fast(
            [names[i].decode() for i in rest], add_special_tokens=False)
        for i, e in zip(rest, fresh):
            out[i] = e.ids
        size = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(itertools.chain.from_iterable(out), np.uint32, int(size.sum())), size

    def _keep(self, keys: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Remember chunks, given by their hashes in order, as far as there is room."""
        few = np.flatnonzero(size <= LONGEST_KEPT)[: max(KEPT_CHUNKS - len(self.keys), 0)]
        few = few[: np.searchsorted(np.cumsum(size[few]), KEPT_IDS - self.used, side="right")]
        if not len(few):
            return
        count = size[few]
        at = np.searchsorted(self.keys, keys[few])
        self.keys = np.insert(self.keys, at, keys[few])
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(count) - count)
        self.size = np.insert(self.size, at, count)
        before, self.used = self.used, self.used + int(count.sum())
        if self.used > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(self.used, np.uint32))
        self.flat[before: self.used] = ids[_places(begin[few], count)]

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, number of ids of each chunk)."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = data.tobytes()
        if self.folds and b"<|" not in raw:  # folding must not turn text into a special token
            data = _LOWER[data]
            raw = data.tobytes()
        keys, where, which = _distinct(rolling.word_hashes(data, starts, ends))
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        begin, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        held = at[known]
        size[known] = self.size[held]
        flat = self.flat[_places(self.begin[held], size[known])]
        begin[known] = np.cumsum(size[known]) - size[known]
        new = np.flatnonzero(~known)
        if len(new):
            ids, own = self._encode([raw[a:b] for a, b in zip(
                starts[where[new]].tolist(), ends[where[new]].tolist())])
            first = np.cumsum(own) - own
            begin[new], size[new] = first + len(flat), own
            flat = np.append(flat, ids)
            self._keep(keys[new], first, own, ids)
        count = size[which]
        return flat[_places(begin[which], count)], count


def _places(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every stretch, `count` of each, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, a place of each, which of them each value is); any place will do, which
    spares the stable sort of np.unique."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.ones(len(values), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(first) - 1
    return ordered[first], order[first], which


@functools.lru_cache(maxsize=2)
def encoder(tokenizer_path: str, folds: bool = False) -> ChunkEncoder:
    """One per worker process, so that tasks share what was encoded."""
    return ChunkEncoder(tokenizer_path, folds)
