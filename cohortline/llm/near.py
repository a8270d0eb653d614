"""Near-duplicate documents by min-max hashing: both ends of every permutation are kept.

1. Every text becomes a set of hashed word shingles, and the least and the greatest hash under each
   permutation; documents of equal sets become one class.
2. The signature is cut into bands. Classes that share a band value share a bucket; the least class
   of a bucket is its pivot.
3. Every class is compared with its pivots on full sets. What remains of it is a difference: a bit
   for each shingle of the pivot, and the shingles the pivot lacks.
4. Classes that a pivot gathers but that are not linked yet are compared with the rest of its group
   on full sets rebuilt from the differences, in blocks of bounded size. So every two classes of a
   bucket are linked, known to be connected, or refuted exactly. Already connected members
   are not compared with each other, so large groups of copies cost little more than their members.
5. Links give components, by least label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .graphs import least_reachable
from .tables import sized, stored

SHINGLE = 4
PERCENT = 80
#: Permutations; each gives two signature values, its least and its greatest hash.
PERMUTATIONS = 64
#: Signature values in a band. 32 bands of 4 miss a pair of similarity 0.8 once in 20 million.
ROWS = 4
# classes in a block of an exact comparison
BLOCK = 512
# keys of this many documents at most are broadcast (16 bytes each); beyond, they are joined
BROADCAST_KEYS = 500_000
LAST = 2**63 - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): distinct hashed shingles of each document, ascending.

    A document of fewer words than `size` has its whole word sequence as one shingle.
    """
    data = LOWER[data]
    starts, ends, first = rolling.words_of(data, bounds)
    sums = rolling.prefix_sums(rolling.word_hashes(data, starts, ends))
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    doc = np.repeat(np.arange(len(words)), count)
    begin = first[:-1][doc] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum(begin + size, first[1:][doc])
    value = rolling.mix(rolling.stretch_hash(sums, begin, end) + (end - begin).astype(np.uint64))
    order = np.argsort(value)
    order = order[np.argsort(doc[order], kind="stable")]
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.append(0, np.cumsum(np.bincount(doc[new], minlength=len(words))))


def signatures(values: np.ndarray, bounds: np.ndarray, permutations: int) -> np.ndarray:
    """One row per document with shingles: least and greatest value under each permutation."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), 2 * permutations), np.uint64)
    if len(starts):
        seeds = rolling.mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * rolling.BASE)
        for k in range(permutations):
            moved = values * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1]
            out[:, 2 * k] = np.minimum.reduceat(moved, starts)
            out[:, 2 * k + 1] = np.maximum.reduceat(moved, starts)
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of `rows` neighbouring signature values, marked with the band's place."""
    parts = signature.reshape(len(signature), -1, rows)
    seeds = rolling.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    places = np.arange(parts.shape[1], dtype=np.uint64) * rolling.BASE
    return rolling.mix((rolling.mix(parts) * seeds).sum(2, dtype=np.uint64) + places)


def _profiles(shingle: int, permutations: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = 2 * permutations // rows
        for batch in batches:
            for row, end, data, bounds in rolling.text_pieces(batch.column("text")):
                values, edges = shingle_sets(data, bounds, shingle)
                size = np.diff(edges)
                some = size > 0
                digest = np.zeros((2, end - row), np.uint64)
                if some.any():
                    digest[0, some] = np.add.reduceat(rolling.mix(values), edges[:-1][some])
                    digest[1, some] = np.bitwise_xor.reduceat(
                        rolling.mix(values * rolling.BASE), edges[:-1][some])
                found = bands(signatures(values, edges, permutations), rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(row, end - row) for k in ("doc_id", "did", "th")),
                     pa.array(size.astype(np.int64)), pa.array(digest[0].view(np.int64)),
                     pa.array(digest[1].view(np.int64)),
                     pa.ListArray.from_arrays(
                         pa.array(np.append(0, np.cumsum(some * per)).astype(np.int32)),
                         pa.array(found.ravel().view(np.int64)))],
                    names=["doc_id", "did", "th", "n", "d1", "d2", "bands"])
    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in rolling.text_pieces(batch.column("text")):
                values, edges = shingle_sets(data, bounds, shingle)
                raw, ends = values.tobytes(), edges * 8
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(row, end - row) for k in ("did", "th")),
                     pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())],
                    names=["did", "th", "shingles"])
    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared shingles of class and pivot; the class as bits over the pivot's set and the rest."""
    for batch in batches:
        shared, bits, rest = [], [], []
        for own, other in zip(batch.column("own"), batch.column("other")):
            mine = np.frombuffer(own.as_buffer(), np.uint64)
            pivot = np.frombuffer(other.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(pivot, mine), len(pivot) - 1)
            held = pivot[at] == mine
            marks = np.zeros(len(pivot), bool)
            marks[at[held]] = True
            shared.append(int(held.sum()))
            bits.append(np.packbits(marks).tobytes())
            rest.append(mine[~held].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("c"), batch.column("p"), batch.column("n"), batch.column("pivot_n"),
             pa.array(shared, pa.int64()), pa.array(bits, pa.binary()), pa.array(rest, pa.binary())],
            names=["c", "p", "n", "pivot_n", "shared", "bits", "rest"])


def _overlaps(bits: list[bytes], rest: list[bytes]) -> np.ndarray:
    """Exact sizes of the intersections of all members of a block, from their differences."""
    total = np.zeros((len(bits), len(bits)), np.float64)
    marks = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
    extra = np.concatenate([np.frombuffer(r, np.uint64) for r in rest])
    owner = np.repeat(np.arange(len(rest)), [len(r) // 8 for r in rest])
    names, column, met = np.unique(extra, return_inverse=True, return_counts=True)
    common = met > 1
    place = np.cumsum(common) - 1
    keep = common[column]
    owner, column = owner[keep], place[column[keep]]
    for at in range(0, marks.shape[1], 512):
        part = np.unpackbits(marks[:, at: at + 512], axis=1).astype(np.float32)
        total += part @ part.T
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    edges = np.searchsorted(column, np.arange(0, int(common.sum()) + 4096, 4096))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        part = np.zeros((len(bits), 4096), np.float32)
        part[owner[a:b], column[a:b] - 4096 * k] = 1
        total += part @ part.T
    return total


def _block_links(percent: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        shared = _overlaps(block["bits"].tolist(), block["rest"].tolist())
        n = block["n"].to_numpy(np.float64)
        linked = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
        # a chain of labels is enough: a link adds nothing once its ends are connected
        label = block.groupby(["label_did", "label_th"]).ngroup().to_numpy()
        linked &= label[:, None] != label[None, :]
        parent = list(range(int(label.max()) + 1))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        ends = []
        for a, b in np.argwhere(np.triu(linked)):
            x, y = top(label[a]), top(label[b])
            if x != y:
                parent[x] = y
                ends.append((a, b))
        ends = np.array(ends, np.int64).reshape(-1, 2)
        did, th = block["did"].to_numpy(), block["th"].to_numpy()
        return pd.DataFrame({"a_did": did[ends[:, 0]], "a_th": th[ends[:, 0]],
                             "b_did": did[ends[:, 1]], "b_th": th[ends[:, 1]]})
    return run


def _rest_links(diffs: DataFrame, labels: DataFrame, percent: int, block: int) -> DataFrame:
    """Links across the components that one pivot gathers, every cross pair settled exactly."""
    named = (diffs.join(labels, diffs["c"] == labels["node"], "left")
             .withColumn("label", F.coalesce("label", "c")).drop("node")
             .join(labels.withColumnRenamed("label", "home"), F.col("p") == F.col("node"), "left")
             .withColumn("home", F.coalesce("home", "p")).drop("node")
             .withColumn("out", F.col("label") != F.col("home")))
    sizes = named.groupBy("p").agg(
        F.count_if("out").alias("n_out"), F.count_if(~F.col("out")).alias("n_in"))
    outs, ins = (F.ceil(F.col(k) / block).cast("int") for k in ("n_out", "n_in"))
    dealt = (named.join(sizes.filter("n_out > 0"), "p")
             .withColumn("outs", outs).withColumn("ins", ins)
             .withColumn("own", F.pmod(F.xxhash64("c"), F.when(F.col("out"), F.col("outs"))
                                       .otherwise(F.greatest("ins", F.lit(1)))).cast("int")))

    def cells(n: F.Column, make) -> F.Column:
        return F.transform(F.sequence(F.lit(0), n - 1), make)

    def cell(a: F.Column, b: F.Column, kind: str) -> F.Column:
        return F.struct(a.alias("i"), b.alias("j"), F.lit(kind).alias("kind"))

    own, none = F.col("own"), F.array().cast("array<struct<i:int,j:int,kind:string>>")
    among = cells(F.col("outs"), lambda k: cell(F.least(k, own), F.greatest(k, own), "out"))
    across = F.when(F.col("ins") > 0, cells(F.col("ins"), lambda k: cell(own, k, "in"))).otherwise(none)
    inward = cells(F.col("outs"), lambda k: cell(k, own, "in"))
    rows = dealt.withColumn("cell", F.explode(
        F.when(F.col("out"), F.concat(among, across)).otherwise(inward)))
    found = (
        rows.select("p", "cell", "c.*", "n", F.col("label.did").alias("label_did"),
                    F.col("label.th").alias("label_th"), "bits", "rest")
        .groupBy("p", "cell").applyInPandas(
            _block_links(percent), "a_did long, a_th long, b_did long, b_th long"))

    def end(x: str) -> F.Column:
        return F.struct(F.col(f"{x}_did").alias("did"), F.col(f"{x}_th").alias("th")).alias(x)

    return found.select(end("a"), end("b"))


def near_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, percent: int = PERCENT,
                    permutations: int = PERMUTATIONS, rows: int = ROWS,
                    block: int = BLOCK) -> DataFrame:
    """(doc_id, did, th, n_shingles, component_id, kept), one row per input row.

    did and th key the row: its id, or the greatest long for null, and the xxhash64 of its text.

    Words are lower-cased (A-Z) runs of characters other than space and the controls 9 to 13. Two
    documents are linked if 100 * shared >= percent * union of their distinct shingles.

    Null and empty texts have no shingles and are linked with nothing. Repeated rows and equal sets
    are linked by definition. Null ids stay null: such a row belongs to its component, whose id is
    the least id that is not null; it is kept only if the whole component has null ids. Rows that
    repeat the least id are all kept, as nothing tells them apart. Empty table: empty frame. Other
    columns are not read.
    """
    text = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("did"),
        F.xxhash64(F.col(text_col)).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    profiles = stored(text.mapInArrow(
        _profiles(shingle, permutations, rows),
        "doc_id long, did long, th long, n long, d1 long, d2 long, bands array<long>"), "profiles")
    same = ["n", "d1", "d2"]
    classes = profiles.filter("n > 0").groupBy(*same).agg(
        F.min(F.struct("did", "th")).alias("c"), F.min("bands").alias("bands"))
    classes = stored(classes, "classes")
    links = _links(text, classes, shingle, percent, block)
    labels = least_reachable(links)
    known = (classes.join(labels, F.col("c") == F.col("node"), "left")
             .select(*same, F.coalesce("label", "c")["did"].alias("least")))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("did"))
    return (profiles.select("doc_id", "did", "th", *same).join(known, same, "left")
            .select("doc_id", "did", "th", F.col("n").alias("n_shingles"),
                    F.when(component < LAST, component).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _links(text: DataFrame, classes: DataFrame, shingle: int, percent: int, block: int) -> DataFrame:
    """Links between classes, enough to connect all that are linked."""
    members = classes.select("c", "n", F.explode("bands").alias("band"))
    shared = (members.groupBy("band").agg(F.count("*").alias("met"), F.min("c").alias("p"))
              .filter("met > 1").select("band", "p"))
    pairs = stored(members.join(shared, "band").select("c", "n", "p").distinct(), "pairs")
    keys = pairs.select("c.*").distinct()
    keys = sized(stored(keys, "keys"), BROADCAST_KEYS)
    sets = stored(
        text.select("did", "th", "text").join(keys, ["did", "th"], "left_semi")
        .mapInArrow(_sets(shingle), "did long, th long, shingles binary")
        .select(F.struct("did", "th").alias("c"), "shingles"), "sets")
    # rows that repeat id and text give the same set again; one of each will do
    sets = sets.groupBy("c").agg(F.min("shingles").alias("shingles"))
    pivots = sets.select(F.col("c").alias("p"), F.col("shingles").alias("other"))
    size = (F.length("other") / 8).cast("long")
    diffs = stored(
        pairs.filter("c <> p").join(sets.withColumnRenamed("shingles", "own"), "c")
        .join(pivots, "p").withColumn("pivot_n", size)
        .select("c", "p", "n", "pivot_n", "own", "other")
        .mapInArrow(_differences, "c struct<did:bigint,th:bigint>, p struct<did:bigint,th:bigint>, "
                    "n long, pivot_n long, shared long, bits binary, rest binary"), "differences")
    linked = F.expr(f"100 * shared >= {percent} * (n + pivot_n - shared)")
    first = diffs.filter(linked).select(F.col("c").alias("a"), F.col("p").alias("b"))
    labels = least_reachable(first)
    return first.unionByName(stored(_rest_links(diffs, labels, percent, block), "links"))


def query(docs: DataFrame) -> DataFrame:
    return near_members(docs).drop("did", "th")
