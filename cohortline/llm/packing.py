"""Packing of tokenised documents by a grouping genetic algorithm on islands.

Pieces are dealt to shards of bounded size. Each shard is solved on several islands that start from
different orders; after an epoch every island passes its elite to the next one of the ring, and goes
on from both. A crossover injects whole well-filled bins of one parent into the other, drops the bins
that then hold a piece twice, and best-fits the pieces this displaces. What lies in bins that stay
badly filled is pooled over all shards and packed again, until one shard holds it.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, rolling
from .tables import stored

CAPACITY = 4096
END_ID = 1
#: Pieces in a shard, islands per shard, chromosomes on an island, generations between migrations.
SHARD = 2_000
ISLANDS = 2
POPULATION = 4
GENERATIONS = 8
ELITE = 1
#: Where pooling alone no longer helps, shards may grow to this many times their size.
GROWTH = 8
#: Space that closed bins may waste, against all lengths, where the last sequence has less of it to spare.
#: Bins that would waste more are dissolved and packed again with those of other shards.
WASTE = 0.0002
#: Times the generations that the last shard gets, as all other bins are closed by then.
LAST = 12


class Bins:
    """A chromosome: bins of piece numbers, with the free space of each in order."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []
        self.free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(self.bins))

    def best_fit(self, pieces: list[int]) -> Bins:
        """Put every piece where it leaves the least space, opening bins as needed."""
        for i in pieces:
            size = self.sizes[i]
            at = bisect.bisect_left(self.free, (size, -1))
            if at < len(self.free):
                space, k = self.free.pop(at)
                self.bins[k].append(i)
            else:
                space, k = self.capacity, len(self.bins)
                self.bins.append([i])
            bisect.insort(self.free, (space - size, k))
        return self

    def fitness(self) -> float:
        """Mean squared filling: fewer and fuller bins score higher."""
        used = [1 - space / self.capacity for space, _ in self.free]
        return sum(u * u for u in used) / max(len(used), 1)

    def fullest(self, share: float) -> list[list[int]]:
        return [self.bins[k] for _, k in self.free[: int(len(self.free) * share)]]


def crossover(a: Bins, b: Bins, share: float) -> Bins:
    """The fullest bins of b, the bins of a that share no piece with them, the rest best-fitted."""
    injected = b.fullest(share)
    taken = {i for group in injected for i in group}
    whole = [group for group in a.bins if taken.isdisjoint(group)]
    displaced = [i for group in a.bins if not taken.isdisjoint(group) for i in group if i not in taken]
    displaced.sort(key=lambda i: -a.sizes[i])
    return Bins(a.sizes, a.capacity, [list(g) for g in injected + whole]).best_fit(displaced)


def mutate(a: Bins, rng: random.Random) -> Bins:
    """Dissolve the emptiest bins and a few others, and best-fit their pieces in a loose order."""
    worst = {k for _, k in a.free[-2:]} | {rng.randrange(len(a.bins)) for _ in range(3)}
    loose = [i for k in worst for i in a.bins[k]]
    loose.sort(key=lambda i: -a.sizes[i] * rng.uniform(0.8, 1))
    return Bins(a.sizes, a.capacity,
                [list(g) for k, g in enumerate(a.bins) if k not in worst]).best_fit(loose)


def evolve(sizes: list[int], capacity: int, seed: int, guests: list[list[list[int]]],
           generations: int = GENERATIONS) -> list[Bins]:
    """One epoch of an island; the best first. Ends early once no packing can have fewer bins."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    people = [Bins(sizes, capacity, [list(g) for g in bins]) for bins in guests]
    while len(people) < POPULATION:
        loose = 1 if not people and not seed else rng.uniform(0.7, 1)
        people.append(Bins(sizes, capacity).best_fit(
            sorted(order, key=lambda i: -sizes[i] * rng.uniform(loose, 1))))
    people.sort(key=Bins.fitness, reverse=True)
    for _ in range(generations):
        if len(people[0].bins) <= least:
            break
        a, b = rng.sample(people, 2)
        child = crossover(a, b, rng.uniform(0.2, 0.6))
        people.append(mutate(child, rng))
        people.append(child)
        people.sort(key=Bins.fitness, reverse=True)
        del people[POPULATION:]
    return people


def _epoch(capacity: int, generations: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for seed, sizes, guests in zip(frame["seed"], frame["sizes"], frame["guests"]):
                sizes = [int(s) for s in sizes]
                found = evolve(sizes, capacity, int(seed), [_groups(g) for g in guests], generations)[:ELITE]
                out.append(([_labels(f.bins, len(sizes)) for f in found], found[0].fitness()))
            yield pd.DataFrame({"shard": frame["shard"], "island": frame["island"],
                                "elite": [e for e, _ in out], "fitness": [f for _, f in out]})
    return run


def _labels(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, group in enumerate(bins):
        for i in group:
            out[i] = k
    return out


def _groups(labels) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(max(labels, default=-1)) + 1)]
    for i, k in enumerate(labels):
        out[k].append(i)
    return out


def _pack_level(pieces: DataFrame, shards: int, capacity: int, tasks: int) -> DataFrame:
    """(uid, length, shard, bin, fill, offset) of one round over (uid, length)."""
    problems = stored(
        pieces.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(shards)), F.lit(shards)))
        .groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items")),
        "shards")
    islands = problems.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        F.col("items.length").alias("sizes"))
    schema = "shard long, island int, elite array<array<int>>, fitness double"
    seed = (F.col("shard") * ISLANDS + F.col("island")).alias("seed")
    none = F.array().cast("array<array<int>>").alias("guests")
    generations = GENERATIONS * (LAST if shards == 1 else 1)
    # dealt to tasks by number, as shards cost about the same
    first = stored(
        islands.select("shard", "island", seed, "sizes", none).repartition(tasks, "shard", "island")
        .mapInPandas(_epoch(capacity, generations), schema), "epoch")
    moved = first.select(
        "shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("visitors"))
    second = (islands.join(first, ["shard", "island"]).join(moved, ["shard", "island"])
              .select("shard", "island", (seed + 1_000_003).alias("seed"), "sizes",
                      F.concat("elite", "visitors").alias("guests"))
              .mapInPandas(_epoch(capacity, generations), schema))
    best = second.groupBy("shard").agg(F.max_by(
        F.get("elite", F.lit(0)), F.struct("fitness", "island")).alias("bins"))
    placed = problems.join(best, "shard").select(
        "shard", F.explode(F.arrays_zip("items", "bins")).alias("x")).select(
        "shard", "x.items.uid", "x.items.length", F.col("x.bins").alias("bin"))
    per_bin = placed.groupBy("shard", "bin").agg(
        F.sum("length").alias("fill"),
        F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("held"))
    step = F.aggregate(
        "held", F.struct(F.lit(0).cast("long").alias("at"),
                         F.array().cast("array<struct<uid:bigint,length:bigint,at:bigint>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["length"]).alias("at"),
            F.array_append(a["out"], F.struct(x["uid"], x["length"], a["at"].alias("at"))).alias("out")))
    return per_bin.select("shard", "bin", "fill", F.explode(step["out"]).alias("x")).select(
        "x.uid", "x.length", "shard", "bin", "fill", F.col("x.at").alias("offset"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(uid, sequence_id, offset) for (uid, length), lengths from 1 to capacity, uid unique."""
    spark = pieces.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                spark.sparkContext.defaultParallelism)
    full = pieces.filter(F.col("length") == capacity).select(
        "uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    most = shard * GROWTH
    done, rest, level = [full], pieces.filter(F.col("length") < capacity), 0
    total = rest.agg(F.sum("length")).first()[0] or 0
    # the last sequence's spare space costs no sequence if other bins waste it
    budget = max(int(0.9 * (-total % capacity)), int(WASTE * total))
    while True:
        n = rest.count()
        shards = max(-(-n // shard), 1)
        placed = stored(_pack_level(rest, shards, capacity, min(tasks, shards * ISLANDS)), "placed")
        number = (F.lit(level) * 2**56 + F.col("shard") * 2**24 + F.col("bin")).cast("long")
        named = placed.withColumn("sequence_id", number)
        if shards == 1:
            done.append(named.select("uid", "sequence_id", "offset"))
            break
        # bins by their free space, at most one row for each; the fullest are closed within the budget
        bins = placed.filter("offset = 0").groupBy((capacity - F.col("fill")).alias("free")).agg(
            F.count("*").alias("n")).orderBy("free").collect()
        least = -1
        for row in bins:
            if row["free"] * row["n"] > budget:
                break
            budget -= row["free"] * row["n"]
            least = row["free"]
        good = F.col("fill") >= capacity - least
        done.append(named.filter(good).select("uid", "sequence_id", "offset"))
        rest, level = placed.filter(~good).select("uid", "length"), level + 1
        if rest.count() > 0.9 * n:  # pooling alone no longer helps
            if shard >= most:
                done.append(named.filter(~good).select("uid", "sequence_id", "offset"))
                break
            shard *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunks.encoder(path, folds=True)
        for batch in batches:
            for row, end, data, bounds in rolling.text_pieces(batch.column("text"), chunks.PIECE_BYTES):
                starts, ends, first = chunks.cut_words(data, bounds)
                ids, count = encoder.ids(data, starts, ends)
                edges = np.append(0, np.cumsum(count))[first]
                out = []
                for i in range(end - row):
                    own = np.append(ids[edges[i]: edges[i + 1]], np.uint32(end_id)).astype("<u4")
                    out += [(row + i, k, at, len(own[at: at + capacity]),
                             zlib.crc32(own[at: at + capacity].tobytes()))
                            for k, at in enumerate(range(0, len(own), capacity))]
                at, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at)), pa.array(piece.astype(np.int32)),
                     pa.array(start), pa.array(length), pa.array(crc)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
                   shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    tokenizer_path: a tokenizer of the tokenizers library that drops white space, at the same path on
    every node. A document is its ids and then end_id, cut only where it is longer than a sequence.

    Null and empty texts are the end id alone. Null ids stay null and repeated rows are packed each.
    Longer documents give several pieces, the last may be shorter. An empty table gives an empty
    frame. Other columns are not read. Sequence ids are unique, not dense.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = texts.mapInArrow(
        _pieces(tokenizer_path, capacity, end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = stored(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("uid", "length"), capacity, shard), "uid").drop("uid")


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
