"""Benchmark decontamination: SimHash of item-sized windows under a multi-index, checked exactly.

1. Every five-word shingle of every document is looked up among the benchmark's. A window as long as
   an item can only be similar enough if at least that share of its places holds shingles of items of
   its length, so only such windows go on: no similar window is lost.
2. Windows and items get a 64-bit SimHash of their shingles, weighted by how often they occur.
3. The fingerprint is cut into blocks. Two fingerprints within the radius differ by at most
   radius // blocks bits in one block at least, so an index of all block values that near to an
   item's finds every pair within the radius.
4. Pairs within the radius are verified: sum of least weights over sum of greatest weights.

All of it is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import sized, stored

SHINGLE = 5
PERCENT = 80
BITS = 64
BLOCKS = 8
#: Similarity 0.8 differs in 9.7 bits on average, with a deviation of 2.9: 23 is over four beyond.
RADIUS = 23
# benchmark tables of this many rows at most are broadcast (under 64 bytes each); beyond, joined
BROADCAST_ROWS = 1_000_000
SPACES = "[\\x20\\x09-\\x0D]+"


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of `size` lower-cased words, in order, repeats kept; null text: none.

    The hashed words are bound to a lambda variable: the optimizer may copy the expression but never
    the splitting of a text into the loop over its places.
    """
    words = F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), ""),
                        lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")
    return F.get(F.transform(F.array(words), lambda w: F.when(
        F.size(w) >= size,
        F.transform(F.sequence(F.lit(0), F.size(w) - size),
                    lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
    ).otherwise(none)), F.lit(0))


def fingerprint(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """SimHash per key of rows with a column h; `size` names the number of shingles."""
    sums = rows.groupBy(*keys).agg(*(
        F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(BITS)))
    bits = (F.when(2 * F.col(f"b{k}") > F.col(size), F.shiftleft(F.lit(1).cast("long"), k))
            .otherwise(F.lit(0).cast("long")) for k in range(BITS))
    return sums.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("print"))


def _block(k: int, blocks: int) -> Column:
    width = BITS // blocks
    return F.shiftrightunsigned("print", k * width).bitwiseAND(F.lit(2**width - 1))


def _near_masks(width: int, distance: int) -> list[int]:
    return [sum(1 << b for b in chosen)
            for d in range(distance + 1) for chosen in combinations(range(width), d)]


def block_rows(frame: DataFrame, blocks: int, distance: int | None = None) -> DataFrame:
    """One row per block, as (block, value); with a distance, one per value that near."""
    masks = _near_masks(BITS // blocks, distance or 0)
    cells = F.array(*(F.struct(F.lit(k).alias("block"), _block(k, blocks).alias("value"))
                      for k in range(blocks)))
    rows = frame.withColumn("cell", F.explode(cells)).select("*", "cell.*").drop("cell")
    if distance:
        rows = rows.withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).withColumn(
            "value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """Matches, one row per document and item: (doc_id, text_hash, item_id, start_word, n_words,
    similarity, distance), the best window, the first of equals. Clean documents have no row.

    Similarity is the sum of the least over the sum of the greatest weights of five-word shingles,
    the weight of a shingle being its number of occurrences; at least percent / 100.

    Null and empty texts, and texts or items under five words, have no shingle and match nothing.
    Null ids stay null. Repeated rows give one row, as do equal texts under one id. Every text of an
    item is searched, also where several share an id or have none; the best window of an id's texts
    counts. Empty tables give an empty frame. Other columns are not read.
    """
    key = ["did", "th"]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("did"),
        F.xxhash64(F.col(text_col)).alias("th"), shingles(F.col(text_col)).alias("hs"))
    # ik: one text of one item id, never null
    items = stored(
        benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).distinct()
        .select("item_id", F.xxhash64("item_id", "text").alias("ik"), shingles(F.col("text")).alias("hs"))
        .filter(F.size("hs") > 0).withColumn("n", F.size("hs")), "items")
    item_rows = items.select("ik", "n", F.explode("hs").alias("h"))
    known = item_rows.select("h", "n").distinct()

    # outer: no filter on the shingles is inferred, which would make them twice
    hits = (rows.select(*key, F.posexplode_outer("hs").alias("pos", "h")).join(sized(known, BROADCAST_ROWS), "h")
            .groupBy(*key, "n").agg(F.sort_array(F.collect_set("pos")).alias("at")))
    # shared >= percent / (100 + percent) * 2n of the n places of a window
    need = F.ceil(F.col("n") * (2 * percent) / F.lit(100 + percent) - 1e-9).cast("int")
    spans = stored(
        hits.withColumn("need", need).filter(F.size("at") >= F.col("need"))
        .withColumn("span", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("at") - F.col("need")),
            lambda i: F.struct(F.get("at", i).alias("first"),
                               F.get("at", i + F.col("need") - 1).alias("last")))))
        .select(*key, "n", "span.*").filter("last - first < n"), "spans")

    touched = stored(spans.select(*key).distinct(), "touched")
    texts = stored(rows.join(sized(touched, BROADCAST_ROWS), key, "left_semi").groupBy(*key).agg(
        F.first("doc_id").alias("doc_id"), F.first("hs").alias("hs")), "texts")
    windows = (spans.join(texts.select(*key, F.size("hs").alias("size")), key)
               .withColumn("low", F.greatest(F.lit(0), F.col("last") - F.col("n") + 1))
               .withColumn("high", F.least(F.col("first"), F.col("size") - F.col("n")))
               .filter("low <= high")
               .select(*key, "n", F.explode(F.sequence("low", "high")).alias("s")).distinct())
    grams = stored(
        windows.join(texts.select(*key, "hs"), key)
        .select(*key, "n", "s", F.explode(F.slice("hs", F.col("s") + 1, F.col("n"))).alias("h")),
        "grams")
    wkey = [*key, "n", "s"]
    prints = fingerprint(grams, wkey, "n")
    item_prints = fingerprint(item_rows, ["ik", "n"], "n")
    index = stored(block_rows(item_prints, BLOCKS, radius // BLOCKS), "index")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("other")))
    pairs = (block_rows(prints, BLOCKS)
             .join(sized(index.withColumnRenamed("print", "other"), BROADCAST_ROWS), ["n", "block", "value"])
             .select(*wkey, "ik", distance.alias("distance"))
             .filter(F.col("distance") <= radius).distinct())

    weights = grams.groupBy(*wkey, "h").agg(F.count("*").alias("w"))
    item_weights = item_rows.groupBy("ik", "h").agg(F.count("*").alias("v"))
    shared = (weights.join(pairs, wkey).join(sized(item_weights, BROADCAST_ROWS), ["ik", "h"])
              .groupBy(*wkey, "ik", "distance")
              .agg(F.sum(F.least("w", "v")).alias("shared"))
              .withColumn("all", 2 * F.col("n") - F.col("shared"))
              .filter(F.expr(f"100 * shared >= {percent} * all")))
    named = shared.join(sized(items.select("ik", "item_id"), BROADCAST_ROWS), "ik")
    best = named.groupBy(*key, "item_id").agg(F.min(F.struct(
        (-F.col("shared") / F.col("all")).alias("less"), "s", "n", "distance")).alias("x"))
    return best.join(texts.select(*key, "doc_id"), key).select(
        "doc_id", F.col("th").alias("text_hash"), "item_id",
        F.col("x.s").cast("long").alias("start_word"),
        (F.col("x.n") + (SHINGLE - 1)).cast("long").alias("n_words"),
        F.round(-F.col("x.less"), 6).alias("similarity"),
        F.col("x.distance").cast("int").alias("distance"))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).select(
        "doc_id", "item_id", "start_word", "n_words", "similarity")
