"""Stretches of fixed length that repeat anywhere in a corpus, exactly, without pairing documents.

Both operators on repeats (word windows, byte strings) share this frame:

1. every document is cut into segments (see `rolling`), one small row each;
2. anchors are counted; a segment whose anchor occurs once holds no repeated window;
3. equal segments are collapsed to one kind; all windows of a kind met twice are repeated;
4. only kinds that share an anchor with another kind have their windows compared, one
   representative of each kind, by the operator's own index;
5. the marked windows return to the documents by key, and the text is cut there.

Hot keys: anchors and kinds are counted with map-side partial sums, the joins on them are plain
sort-merge joins that AQE may split, and a passage that a third of all rows share is one kind.
Documents are keyed by (doc_id, hash of text): null and repeated ids are allowed, and repeated rows
count as copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .tables import stored

KEY = ["did", "th"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, did, th, text): did and th are never null."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("did"),
        F.xxhash64(F.col(text_col)).alias("th"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def symbols_of(data: np.ndarray, bounds: np.ndarray, unit: str):
    """(symbols, bounds in symbols) of a piece of texts."""
    if unit == "byte":
        return rolling.BYTE_VALUES[data], bounds
    starts, ends, first = rolling.words_of(data, bounds)
    return rolling.word_hashes(data, starts, ends), first


def _segment_batches(unit: str, width: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(k).to_numpy() for k in KEY)
            for row, _, data, bounds in rolling.text_pieces(batch.column("text")):
                found = rolling.Segments(*symbols_of(data, bounds, unit), width, gram)
                at = found.doc + row
                yield pa.RecordBatch.from_arrays([
                    pa.array(did[at]), pa.array(th[at]),
                    pa.array(found.start.astype(np.int32)), pa.array(found.count.astype(np.int32)),
                    pa.array(found.anchor.view(np.int64)), pa.array(found.digest.view(np.int64)),
                    pa.array(found.twice)],
                    names=[*KEY, "start", "count", "anchor", "digest", "twice"])
    return run


def segments(docs: DataFrame, unit: str, width: int, gram: int) -> DataFrame:
    return docs.select(*KEY, "text").mapInArrow(
        _segment_batches(unit, width, gram),
        "did long, th long, start int, count int, anchor long, digest long, twice boolean")


def repeated_stretches(docs: DataFrame, unit: str, width: int, gram: int,
                       compare: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(did, th, spans): all runs of symbols covered by a window that also starts elsewhere.

    `compare(docs, kinds)` gets the representatives (anchor, digest, did, th, start, count, bytes)
    and returns (anchor, digest, runs): windows of the representative found elsewhere, as
    [from, to) ranges counted from its first window.
    """
    rows = stored(segments(docs, unit, width, gram), "segments")
    met = (rows.groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("any_twice"))
           .filter((F.col("n") > 1) | F.col("any_twice")).select("anchor"))
    live = stored(rows.join(met, "anchor", "left_semi"), "live")
    kinds = stored(
        live.groupBy("anchor", "digest").agg(
            F.count("*").alias("copies"), F.max("twice").alias("twice"),
            F.min(F.struct(*KEY, "start", "count")).alias("at")), "kinds")
    variety = kinds.groupBy("anchor").agg(
        F.count("*").alias("n"), F.sum(F.col("at.count") + width - 1).alias("size"))
    doubtful = kinds.join(variety, "anchor").filter((F.col("n") > 1) | F.col("twice"))
    runs = compare(docs, doubtful.select("anchor", "digest", "at.*", "size"))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("count").alias("b")))
    marked = (
        live.join(kinds.select("anchor", "digest", "copies"), ["anchor", "digest"])
        .join(runs, ["anchor", "digest"], "left")
        .withColumn("runs", F.when(F.col("copies") > 1, whole).otherwise(F.col("runs")))
        .select(*KEY, "start", F.explode("runs").alias("run")))
    return marked.groupBy(*KEY).agg(F.collect_set(F.struct(
        (F.col("start") + F.col("run.a")).alias("a"),
        (F.col("start") + F.col("run.b") + (width - 1)).alias("b"))).alias("spans"))


def at_documents(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Documents that hold representatives, each with the list of them."""
    lists = kinds.groupBy(*KEY).agg(F.collect_list(
        F.struct("anchor", "digest", "start", "count")).alias("kinds"))
    return docs.select("doc_id", *KEY, "text").join(lists, KEY)


def counted_windows(docs: DataFrame, kinds: DataFrame, unit: str, width: int) -> DataFrame:
    """Compare windows by their rolling hashes, counted in Spark under their anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("kinds").to_pylist()
            for row, end, data, bounds in rolling.text_pieces(batch.column("text")):
                symbols, first = symbols_of(data, bounds, unit)
                sums = rolling.prefix_sums(symbols)
                found = [(k["anchor"], k["digest"], int(first[i]) + k["start"], k["count"])
                         for i, own in enumerate(lists[row:end]) for k in own]
                if not found:
                    continue
                anchor, digest, start, count = (np.array(x, np.int64) for x in zip(*found))
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                begin = np.repeat(start, count) + step
                value = rolling.mix(rolling.stretch_hash(sums, begin, begin + width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(anchor, count)), pa.array(np.repeat(digest, count)),
                     pa.array(step.astype(np.int32)), pa.array(value.view(np.int64))],
                    names=["anchor", "digest", "step", "value"])

    windows = stored(at_documents(docs, kinds).mapInArrow(
        run, "anchor long, digest long, step int, value long"), "windows")
    twice = (windows.groupBy("anchor", "value").agg(F.count("*").alias("n"))
             .filter("n > 1").select("anchor", "value"))
    return (windows.join(twice, ["anchor", "value"], "left_semi")
            .groupBy("anchor", "digest")
            .agg(F.collect_set(F.struct(F.col("step").alias("a"), (F.col("step") + 1).alias("b")))
                 .alias("runs")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal intervals of a set of overlapping ones."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
