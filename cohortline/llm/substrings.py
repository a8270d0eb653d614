"""Substring dedup: Rabin-Karp hashes of every fixed-length word window that may repeat, counted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, rolling

WIDTH = 35
GRAM = 6


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          width: int = WIDTH) -> DataFrame:
    """Remove every word covered by a `width`-word window that also starts anywhere else.

    Returns (doc_id, n_words, n_removed, spans, kept): spans are the removed word ranges [a, b),
    maximal, and kept is the rest joined by one space. Words are runs of characters other than space
    and the controls 9 to 13, unchanged.

    Null and empty texts have no words and keep "". Texts shorter than a window keep all words.
    Null ids stay null; repeated rows are copies of each other, so their windows repeat. An empty
    table gives an empty frame. Other columns are not read. Windows are judged on the input.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    gram = min(GRAM, width)
    spans = repeats.repeated_stretches(
        rows, "word", width, gram,
        lambda d, kinds: repeats.counted_windows(d, kinds, "word", width))
    return rows.join(spans, repeats.KEY, "left").select("doc_id", "text", "spans").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, "
              "spans array<struct<a:int,b:int>>, kept string")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        lists = batch.column("spans").to_pylist()
        for row, end, data, bounds in rolling.text_pieces(batch.column("text")):
            starts, ends, first = rolling.words_of(data, bounds)
            raw = data.tobytes()
            out = []
            for i in range(end - row):
                lo, hi = int(first[i]), int(first[i + 1])
                gone = repeats.merged([(s["a"], s["b"]) for s in lists[row + i] or ()])
                words, at = [], 0
                for a, b in [*gone, (hi - lo, hi - lo)]:
                    words += [raw[x:y] for x, y in zip(
                        starts[lo + at: lo + a].tolist(), ends[lo + at: lo + a].tolist())]
                    at = b
                out.append((hi - lo, sum(b - a for a, b in gone),
                            [{"a": a, "b": b} for a, b in gone], b" ".join(words)))
            n, removed, spans, kept = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, end - row), pa.array(n, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(spans, kind),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"])


def query(docs: DataFrame) -> DataFrame:
    return remove_repeated_words(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
