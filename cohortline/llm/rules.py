"""Quality rules: counts that fail a text outright, then a log-likelihood ratio of hashed n-grams.

Words and word pairs are hashed to buckets. Two multinomials are counted over them: one over every
document (raw), one over the trusted documents (target). A text's score is the mean over its n-grams
of log p(target) - log p(raw); one fixed threshold decides every document.

The number of buckets follows the counted n-grams, so that a bucket holds as many at any size of the
corpus and the threshold keeps its meaning. Nothing of that size reaches the driver or a broadcast:
1. Documents are dealt to chunks. The distinct buckets of a chunk go, with their counts, to slices of
   neighbouring buckets.
2. A slice sums its buckets over all chunks and answers each chunk with the sums it asked about.
3. Chunks, one compressed row each, meet their answers in a join and are scored.

The occurrence that is being scored is taken out of the counts it stands in: out of raw, and for a
trusted document out of target as well. So a document does not vouch for itself.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .tables import stored

#: N-grams per bucket, at any size of the corpus.
LOAD = 8
#: Neighbouring buckets that are summed together.
SLICE = 1 << 19
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 4_000_000
#: Effort of compressing the texts of a chunk, which are most of what is shuffled.
LEVEL = 5
#: Weight of the uniform prior, in counts per bucket.
PRIOR = 0.5
#: Scores below this are rejected.
THRESHOLD = -0.5
MIN_WORDS = 10
REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
# trusted ids of this many rows at most are broadcast (8 bytes each); beyond, they are joined
BROADCAST_IDS = 2_000_000
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def ngram_buckets(words: np.ndarray, first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, document of each) of all words and of all pairs of neighbours in a document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = rolling.mix(words[:-1] * rolling.BASE + words[1:])
    inside = doc[1:] == doc[:-1]
    value = np.concatenate((words, pairs[inside]))
    return ((rolling.mix(value) % np.uint64(buckets)).astype(np.int64),
            np.concatenate((doc, doc[1:][inside])))


def log_ratio(raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int, buckets: int) -> np.ndarray:
    """log p(target) - log p(raw) of buckets with these counts, out of n_raw and n_target n-grams."""
    return (np.log((target + PRIOR) / (n_target + PRIOR * buckets))
            - np.log((raw + PRIOR) / (n_raw + PRIOR * buckets)))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw = target = size = 0
    for batch in batches:
        trusted = np.asarray(batch.column("_trusted").to_pylist(), bool)
        for row, end, data, bounds in rolling.text_pieces(batch.column("_text")):
            grams = np.maximum(2 * np.diff(rolling.words_of(data, bounds)[2]) - 1, 0)
            raw += int(grams.sum())
            target += int(grams[trusted[row:end]].sum())
            size += len(data)
    yield pa.RecordBatch.from_arrays([pa.array([n]) for n in (raw, target, size)],
                                     names=["raw", "target", "size"])


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 up, compressed by their bytes of equal weight."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T
    return struct.pack("<BQ", kind.itemsize, len(values)) + pa.compress(
        planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", data)
    planes = pa.decompress(data[9:], width * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(
        f"<u{width}").ravel().astype(np.int64)


def _dealt(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(chunk, its rows): neighbouring rows of a partition, until a chunk is full.

    Chunks depend on the rows alone, not on how they come in batches.
    """
    key, held, size = TaskContext.get().partitionId() << 33, [], 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy().astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = int(sizes[begin - 1]) if begin else 0
            end = int(np.searchsorted(sizes, before + chunk_bytes - size)) + 1
            held.append(batch.slice(begin, end - begin))
            if end > batch.num_rows:  # the chunk goes on in the next batch
                size += int(sizes[-1]) - before
                break
            yield key, held
            key, held, size, begin = key + 1, [], 0, end
    if held:
        yield key, held


def _chunks(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _dealt(batches, chunk_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema,
                                   options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
                for batch in held:
                    out.write_batch(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["chunk", "docs"])
    return run


def _pieces(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[tuple]:
    """(rows, bytes, bounds, word starts, word ends, first words, words, buckets, document of each)."""
    for batch in batches:
        for row, end, data, bounds in rolling.text_pieces(batch.column("_text")):
            starts, ends, first = rolling.words_of(data, bounds)
            words = rolling.word_hashes(data, starts, ends)
            yield (batch.slice(row, end - row), data, bounds, starts, ends, first, words,
                   *ngram_buckets(words, first, buckets))


def _trusted(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("_trusted").to_numpy(zero_copy_only=False)


def _asked(buckets: int, slice_size: int, chunk_bytes: int):
    """Distinct buckets of each chunk with their counts, one row per slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, held in _dealt(batches, chunk_bytes):
            marked = [np.zeros(0, np.int64)]
            for rows, *_, bucket, doc in _pieces(held, buckets):
                marked.append(2 * bucket + _trusted(rows)[doc])
            key = np.sort(np.concatenate(marked))
            start = np.flatnonzero(np.diff(key >> 1, prepend=-1))
            if not len(start):
                continue
            place, raw = key[start] >> 1, np.diff(np.append(start, len(key)))
            target = np.add.reduceat(key & 1, start)
            cut = np.append(np.flatnonzero(np.diff(place // slice_size, prepend=-1)), len(place))
            parts = list(zip(cut[:-1], cut[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(parts)), pa.array(place[cut[:-1]] // slice_size),
                 pa.array([pack(np.diff(place[a:b] % slice_size, prepend=0)) for a, b in parts]),
                 pa.array([pack(raw[a:b]) for a, b in parts]),
                 pa.array([pack(target[a:b]) for a, b in parts])],
                names=["chunk", "slice", "steps", "raw", "target"])
    return run


def _answered(slice_size: int):
    def run(asked: pa.Table) -> pa.Table:
        places = [np.cumsum(unpack(x)) for x in asked.column("steps").to_pylist()]
        out = {}
        for name in ("raw", "target"):
            sums = np.zeros(slice_size, np.int64)
            for place, counts in zip(places, asked.column(name).to_pylist()):
                sums[place] += unpack(counts)
            out[name] = pa.array([pack(sums[place]) for place in places], pa.binary())
        return pa.table({"chunk": asked.column("chunk"), "slice": asked.column("slice"), **out})
    return run


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[bounds])


def _repeated_words(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Words per document inside windows of `width` words that the document holds twice or more."""
    n = len(words) - width + 1
    docs = len(first) - 1
    if n <= 0:
        return np.zeros(docs, np.int64)
    doc = np.repeat(np.arange(docs), np.diff(first))
    value = rolling.mix(rolling.window_hash(rolling.prefix_sums(words), width))
    value += rolling.mix((doc[:n] + 1).astype(np.uint64) * rolling.BASE)
    inside = np.flatnonzero(doc[:n] == doc[width - 1:])
    order = inside[np.argsort(value[inside])]
    same = value[order][1:] == value[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, order[twice], 1)
    np.add.at(change, order[twice] + width, -1)
    return _per_doc(np.cumsum(change)[:-1] > 0, first)


def _repeated_lines(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines per document that hold a word and equal an earlier line of the document."""
    docs = len(bounds) - 1
    breaks = np.flatnonzero(data == 10)
    some = np.flatnonzero(np.diff(bounds) > 0)
    begin = np.sort(np.concatenate((bounds[:-1][some], breaks + 1)))
    # a break that ends its document opens no line with a word
    doc = np.searchsorted(bounds, begin, side="right") - 1
    begin, doc = begin[doc < docs], doc[doc < docs]
    stop = np.minimum(np.append(begin[1:], len(data)), bounds[doc + 1])
    ended = (stop > begin) & (data[np.maximum(stop - 1, 0)] == 10) if len(data) else stop > begin
    stop = stop - ended
    held = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, doc = begin[held], stop[held], doc[held]
    if not len(begin):
        return np.zeros(docs, np.int64)
    value = rolling.stretch_hash(rolling.prefix_sums(rolling.BYTE_VALUES[data]), begin, stop)
    frame = pd.DataFrame({"doc": doc, "value": value, "size": stop - begin})
    return np.bincount(doc[frame.duplicated().to_numpy()], minlength=docs).astype(np.int64)


def _ratios(sums: list[dict], place: np.ndarray, n_raw: int, n_target: int, buckets: int) -> np.ndarray:
    """Log ratios of the distinct buckets of a chunk for documents that are not, and that are trusted."""
    sums = sorted(sums or [], key=lambda x: x["slice"])
    raw, target = (np.concatenate([np.zeros(0, np.int64), *(unpack(x[k]) for x in sums)])
                   for k in ("raw", "target"))
    if len(raw) != len(place):  # a task that ran again met other rows
        raise RuntimeError("the documents came in another order when they were read again; store them first")
    return np.stack([log_ratio(raw - 1, target, n_raw, n_target, buckets),
                     log_ratio(raw - 1, np.maximum(target - 1, 0), n_raw, n_target, buckets)])


def _judge(n_raw: int, n_target: int, buckets: int, carry: list[str]):
    def chunk(docs: bytes, sums: pa.Scalar) -> Iterator[pa.RecordBatch]:
        if n_target:
            place = np.unique(np.concatenate([p[-2] for p in _pieces(pa.ipc.open_stream(docs), buckets)]))
            ratio = _ratios(sums.as_py(), place, n_raw, n_target, buckets)
        for rows, data, bounds, starts, ends, first, words, bucket, doc in _pieces(
                pa.ipc.open_stream(docs), buckets):
            n = len(bounds) - 1
            total = np.zeros(n)
            if n_target:
                order = np.argsort(bucket)  # neighbours are found near each other
                found = np.empty(len(bucket))
                found[order] = ratio[_trusted(rows)[doc[order]].astype(int), np.searchsorted(place, bucket[order])]
                total = np.bincount(doc, weights=found, minlength=n)
            grams = np.bincount(doc, minlength=n)
            letters = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
            sizes = letters[ends] - letters[starts]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(k) for k in carry),
                 pa.array(np.diff(first).astype(np.int64)), pa.array(_per_doc(sizes, first)),
                 pa.array(_per_doc(SYMBOL[data], bounds)),
                 pa.array(_repeated_lines(data, bounds, starts)),
                 pa.array(_repeated_words(words, first, REPEAT_WINDOW)),
                 pa.array(np.round(total / np.maximum(grams, 1), 9))],
                names=[*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sums in zip(batch.column("docs"), batch.column("sums")):
                yield from chunk(docs.as_py(), sums)
    return run


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", load: int = LOAD, threshold: float = THRESHOLD,
                  carry: list[str] | None = None, slice_size: int = SLICE,
                  chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept).

    trusted: a frame whose first column holds the ids of trusted documents. carry: columns of docs
    to pass along instead of doc_id, so that a filter needs no join back; the text, if among them, is
    held once. load: n-grams per bucket.

    Null and empty texts have no words: they fail. Null ids are scored as any row and are never
    trusted. Repeated rows count each time and get equal verdicts. With no trusted text all scores
    are 0 and only the base rules decide. An empty table gives an empty frame. Columns outside carry
    are not read; carried names must differ from the result's own. docs is read three times and must
    give the same rows in each partition; where it does not, the job fails.
    """
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("_id")).filter(
        "_id is not null").distinct().withColumn("_trusted", F.lit(True))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    passed = [c for c in carry if c != text_col] if carry else ["_id"]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), *(c for c in passed if c != "_id"),
                       F.col(text_col).alias("_text"))
    passed = passed + ["_text"] * bool(carry and text_col in carry)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in passed)
    rows = (rows.join(F.broadcast(ids) if few else ids, "_id", "left")
            .withColumn("_trusted", F.col("_trusted").isNotNull()))
    if not few:  # rows out of a shuffled join have no fixed order
        rows = stored(rows, "rows")
    n_raw, n_target, size = (n or 0 for n in (
        rows.select("_text", "_trusted").mapInArrow(_totals, "raw long, target long, size long")
        .agg(F.sum("raw"), F.sum("target"), F.sum("size")).first()))
    buckets = max(1, math.ceil(n_raw / load))
    packed = rows.mapInArrow(_chunks(chunk_bytes), "chunk long, docs binary")
    if n_target:
        asked = rows.select("_text", "_trusted").mapInArrow(
            _asked(buckets, slice_size, chunk_bytes),
            "chunk long, slice long, steps binary, raw binary, target binary")
        answers = asked.groupBy("slice").applyInArrow(
            _answered(slice_size), "chunk long, slice long, raw binary, target binary")
        # a task gets few chunks, as each is one row of megabytes
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_bytes))
        sums = (answers.repartition(parts, "chunk").groupBy("chunk")
                .agg(F.collect_list(F.struct("slice", "raw", "target")).alias("sums")))
        packed = packed.repartition(parts, "chunk").join(sums.hint("merge"), "chunk", "left")
    else:
        packed = packed.withColumn("sums", F.lit(None))
    judged = packed.select("docs", "sums").mapInArrow(
        _judge(n_raw, n_target, buckets, passed),
        f"{kinds}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, score double")
    judged = judged.withColumnsRenamed({"_text": text_col} if carry else {"_id": "doc_id"})
    return judged.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return labels.filter("quality = 1 and toxic = 0").select("doc_id")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_rules(docs, trusted_ids(labels))
