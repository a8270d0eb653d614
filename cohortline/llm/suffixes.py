"""Suffix dedup of byte strings with a run-length index of the repetitive part of a corpus.

Each block of doubtful segments becomes one text. Its Burrows-Wheeler transform is kept as runs, with
the suffix positions sampled at the run ends, and the common extension of every two sampled
neighbours. Matching statistics of the text against the rest of the block are streamed from these
samples alone: a position that opens no run has its predecessor's match, one byte shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, rolling

WIDTH = 400
GRAM = 128
# bytes of segment text that one index covers
BLOCK = 1_000_000
# an anchor with more text than this is compared by counted window hashes, spread over tasks
HEAVY = 8_000_000


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by rank doubling from packed 7-symbol keys; settled suffixes leave the sort.

    symbols: integers from 0 to 511.
    """
    n = len(symbols)
    padded = np.zeros(n + 7, np.int64)
    padded[:n] = symbols.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | padded[j: j + n]
    rank, open_, width = np.zeros(n, np.int64), np.arange(n), 7
    while True:
        order = np.argsort(key)
        key, at = key[order], open_[order]
        old = rank[at]
        index = np.arange(len(at))
        new_key, new_old = np.ones(len(at), bool), np.ones(len(at), bool)
        new_key[1:], new_old[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        lead = np.maximum.accumulate(np.where(new_key, index, 0))
        rank[at] = old + lead - np.maximum.accumulate(np.where(new_old, index, 0))
        tied = ~new_key
        tied[:-1] |= ~new_key[1:]
        open_ = at[tied]
        if not len(open_):
            break
        after = open_ + width
        key = rank[open_] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        width *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class RunIndex:
    """Run-compressed transform of `parts` joined by separators, with samples at the run ends."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts])
        text = np.zeros(int(sizes.sum()) + len(parts), np.int16)
        self.begin = np.cumsum([0, *(sizes + 1)])[:-1]
        body = np.ones(len(text), bool)
        body[self.begin + sizes] = False
        text[body] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + 1
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1], -1)
        # a part's first byte opens a run of its own: no match runs on over a separator
        starts = np.zeros(len(text), bool)
        starts[self.begin] = True
        opens = np.ones(len(text), bool)
        opens[1:] = (before[1:] != before[:-1]) | starts[order[1:]] | starts[order[:-1]]
        self.heads = np.flatnonzero(opens)
        self.letters = before[self.heads]
        self.upper, self.lower = order[self.heads[1:] - 1], order[self.heads[1:]]
        self.size = len(text)
        self.left = np.repeat(self.begin + sizes, sizes + 1) - np.arange(len(text))
        values = rolling.mix(text.astype(np.int64).view(np.uint64) + np.uint64(1))
        self.common = self._extension(rolling.prefix_sums(values), self.upper, self.lower)

    def _extension(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common stretch from a and from b within their parts, by bisection."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.left[a], self.left[b])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (rolling.stretch_hash(sums, a, a + mid) == rolling.stretch_hash(sums, b, b + mid))
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def matching_statistics(self) -> np.ndarray:
        """Longest match of every position with any other position of the text."""
        best = np.zeros(self.size, np.int64)
        at = np.arange(self.size)
        for sampled in (self.upper, self.lower):
            known = np.full(self.size, -1, np.int64)
            known[sampled] = self.common
            last = np.maximum.accumulate(np.where(known >= 0, at, 0))
            best = np.maximum(best, np.maximum(known[last], 0) - (at - last))
        return best


def _runs(marks: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _match_block(width: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        index = RunIndex(block["body"].tolist())
        length = index.matching_statistics()
        runs = [_runs(length[a: a + n - width + 1] >= width)
                for a, n in zip(index.begin, block["body"].map(len))]
        out = pd.DataFrame({"anchor": block["anchor"], "digest": block["digest"], "runs": runs})
        return out[out["runs"].map(bool)]
    return run


def indexed_windows(docs: DataFrame, kinds: DataFrame, width: int) -> DataFrame:
    """Compare windows by matching statistics, one run-length index per block of anchors."""
    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("kinds").to_pylist()
            for row, end, data, bounds in rolling.text_pieces(batch.column("text")):
                raw = data.tobytes()
                found = [(k["anchor"], k["digest"], raw[x: x + k["count"] + width - 1])
                         for i, own in enumerate(lists[row:end]) for k in own
                         for x in [int(bounds[i]) + k["start"]]]
                if found:
                    anchor, digest, body = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()),
                         pa.array(body, pa.binary())], names=["anchor", "digest", "body"])

    size = kinds.agg(F.sum(F.col("count") + width - 1)).first()[0] or 0
    blocks = size // BLOCK + 1
    texts = repeats.at_documents(docs, kinds).mapInArrow(
        bodies, "anchor long, digest long, body binary")
    return texts.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block")).applyInPandas(
        _match_block(width), "anchor long, digest long, runs array<struct<a:int,b:int>>")


def compare(docs: DataFrame, kinds: DataFrame, width: int, heavy: int = HEAVY) -> DataFrame:
    """Index blocks of bounded size; anchors beyond the bound go by counted hashes, exactly too."""
    kinds = repeats.stored(kinds, "doubtful")
    light = indexed_windows(docs, kinds.filter(F.col("size") <= heavy), width)
    beyond = kinds.filter(F.col("size") > heavy)
    if beyond.isEmpty():
        return light
    return light.unionByName(repeats.counted_windows(docs, beyond, "byte", width))


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          width: int = WIDTH, heavy: int = HEAVY) -> DataFrame:
    """Remove every byte covered by a `width`-byte string that also starts anywhere else.

    Returns (doc_id, n_bytes, n_removed, spans, kept): spans are the maximal removed byte ranges,
    kept the remaining bytes, concatenated (binary: a cut may split a character).

    Null and empty texts have no bytes. Texts shorter than `width` keep all. Null ids stay null;
    repeated rows are copies of each other. An empty table gives an empty frame. Other columns are
    not read. Matches never cross documents and are judged on the input.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    spans = repeats.repeated_stretches(
        rows, "byte", width, max(1, width * GRAM // WIDTH),
        lambda d, kinds: compare(d, kinds, width, heavy))
    return rows.join(spans, repeats.KEY, "left").select("doc_id", "text", "spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, "
              "spans array<struct<a:int,b:int>>, kept binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        lists = batch.column("spans").to_pylist()
        for row, end, data, bounds in rolling.text_pieces(batch.column("text")):
            raw = data.tobytes()
            out = []
            for i in range(end - row):
                lo, hi = int(bounds[i]), int(bounds[i + 1])
                gone = repeats.merged([(s["a"], s["b"]) for s in lists[row + i] or ()])
                edges = [0, *(x for s in gone for x in s), hi - lo]
                kept = b"".join(raw[lo + a: lo + b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((hi - lo, hi - lo - len(kept),
                            [{"a": a, "b": b} for a, b in gone], kept))
            n, removed, spans, kept = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, end - row), pa.array(n, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def query(docs: DataFrame) -> DataFrame:
    return remove_repeated_bytes(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
