"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions alone.

1. Sources share a budget of words by weight, none beyond a bound; the excess is shared again.
2. A source's documents are laid in a hashed order, once more for every repeat. Running sums give the
   demand at which each begins; the mix ends where the source's target is reached.
3. Every source has a weight schedule over training time. Its integral is the source's cumulative
   demand; inverting it turns the demand at which a document begins into a training position.
4. Range-sorting by position interleaves the sources as scheduled.

All running sums are taken over range partitions (`running_sums`), so that a source with a third of all
documents is spread like the rest. Only sizes and keys are shuffled, never texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import sized, stored

#: Weights dealt to the sources in code-point order, repeating; null last.
WEIGHTS = (3, 1, 2)
#: Words of the mix, against all words there are; and of a source or document, against its own.
SHARE, MOST = 1.5, 2
#: Weight of a source over training time, at evenly spaced times, straight between them; dealt to the
#: sources like the weights. Only the shape counts: its integral is the source's target.
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
# sources (a name and a few numbers each) are broadcast up to this many, joined beyond
BROADCAST_SOURCES = 20_000


def _by_source() -> Column:
    return F.col("source").asc_nulls_last()


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13; null: 0."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def running_sums(frame: DataFrame, order: list[Column | str], sums: dict[str, Column | str]) -> DataFrame:
    """The frame with, for each name in sums, the sum of its column over all rows before, by `order`.

    order must tell all rows apart. Each range partition is summed, the sums of partitions are added up
    (one row per partition), then every partition continues from what lies before it.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(frame.repartitionByRange(parts, *order)
                    .withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("_part").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items())).select(
        "_part", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the session's own setting
    return ranged.join(F.broadcast(whole), "_part").select(
        *frame.columns,
        *((F.col(f"_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(k)
          for k, c in sums.items()))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, rank, source_size, offset, target, wanted) from (source, size).

    A target is min(most * size, level * weight), with the one level at which the targets add up to
    `share` of all sizes. Sources are taken in the order in which a rising level fills them: those
    before the first that stays unfilled are full, the others share what is left by weight.
    wanted: the target in whole words. offset: words of the sources before, by code point.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_sums(totals, [_by_source()], {"rank": F.lit(1), "offset": "source_size"})
    turn = F.col("rank") % len(weights) + 1
    ranked = ranked.withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), turn.cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filled = stored(running_sums(
        ranked.withColumn("full_at", F.col("cap") / F.col("weight")), ["full_at", "rank"],
        {"caps": "cap", "weights": "weight"}), "sources")
    whole = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all_weights"))
    room = F.lit(float(share)) * F.col("words") - F.col("caps")
    rest = F.col("all_weights") - F.col("weights")
    asked = filled.join(F.broadcast(whole)).withColumns({"room": room, "rest": rest})
    open_ = asked.filter(F.col("cap") > F.col("weight") * F.col("room") / F.col("rest")).agg(
        F.min_by(F.struct("room", "rest"), F.struct("full_at", "rank")).alias("level"))
    level = F.col("weight") * F.col("level.room") / F.col("level.rest")
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", level))
    # two aggregates of one row each meet every source
    return stored(filled.join(F.broadcast(open_)).withColumn("target", target).select(
        "source", "rank", "source_size", "offset", "target",
        F.floor(F.least(F.col("target") + 0.5, F.floor("cap"))).cast("long").alias("wanted")), "targets")


def position_of(demand: Column, schedule: tuple[float, ...]) -> Column:
    """Training time from 0 to 1 at which a source has met this share (0 to 1) of its demand.

    The weight is straight between evenly spaced times, its integral a parabola in each stretch; the
    inverse solves that parabola in a form that does not cancel.
    """
    if len(schedule) < 2 or min(schedule) <= 0:
        raise ValueError("a schedule takes two positive weights or more")
    step = 1 / (len(schedule) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(schedule, schedule[1:])]
    whole, met, out = math.fsum(areas), 0.0, None
    for k, area in enumerate(areas):
        a, b = schedule[k] / whole, schedule[k + 1] / whole
        past = demand - F.lit(met)
        root = F.sqrt(F.lit(a * a) + past * F.lit(2 * (b - a) / step))
        time = F.lit(k * step) + past * F.lit(2.0) / (F.lit(a) + root)
        met += area / whole
        last = k == len(areas) - 1
        if out is None:
            out = time if last else F.when(demand < F.lit(met), time)
        else:
            out = out.otherwise(time) if last else out.when(demand < F.lit(met), time)
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
          schedules: tuple[tuple[float, ...], ...] = SCHEDULES, seed: int = 0) -> DataFrame:
    """(doc_id, source, digest, copy, size, source_size, target, taken, places), one row per document.

    taken: words the mix takes, repeats counted; the document at which a source meets its target is
    cut there, so a source's taken words are its target, rounded. places: array of (repeat, words,
    position) for every time that words of it are taken, position from 0 to 1.

    Null and empty texts have size 0 and are never taken. A null source is a source, last in order.
    Null ids are documents like others. Repeated rows (same id, source and text) are told apart by
    `copy` and are interchangeable. Ties in the hashed order go by id, digest and copy. An empty table
    gives an empty frame. Texts of any length are sized whole. Other columns are not read.
    """
    keys = ["source", "doc_id", "digest", "size"]
    counted = stored(
        docs.select(F.col(source_col).cast("string").alias("source"),
                    F.col(id_col).cast("long").alias("doc_id"),
                    F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"),
                    word_count(F.col(text_col)).alias("size"))
        .groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    sources = source_targets(
        counted.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    rows = counted.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    name = F.md5(F.concat_ws(":", "doc_id", "digest", "copy", F.lit(str(seed))))
    rows = rows.withColumn("shuffled", F.conv(F.substring(name, 1, 15), 16, 10).cast("long"))
    laid = running_sums(rows, [_by_source(), "shuffled", "doc_id", "digest", "copy"], {"before": "size"})
    few = sized(sources.withColumnRenamed("source", "_source"), BROADCAST_SOURCES)
    laid = laid.join(few, F.col("source").eqNullSafe(F.col("_source")))

    def place(repeat: Column) -> Column:
        begin = repeat * F.col("source_size") + F.col("before") - F.col("offset")
        demand = F.try_divide(begin.cast("double"), F.col("wanted"))
        turn = (F.col("rank") % len(schedules)).cast("int")
        position = F.when(turn == 0, position_of(demand, schedules[0]))
        for k, schedule in enumerate(schedules[1:], 1):
            position = position.when(turn == k, position_of(demand, schedule))
        words = F.greatest(F.least(F.col("wanted") - begin, F.col("size")), F.lit(0).cast("long"))
        return F.struct(repeat.alias("repeat"), words.alias("words"), position.alias("position"))

    places = F.filter(F.array(*(place(F.lit(k).cast("long")) for k in range(math.ceil(most)))),
                      lambda p: p["words"] > 0)
    return stored(laid.withColumn("places", places).select(
        "doc_id", "source", "digest", "copy", "size", "source_size", "target",
        F.aggregate("places", F.lit(0).cast("long"), lambda total, p: total + p["words"]).alias("taken"),
        "places"), "mixed")


def training_stream(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """Rows of docs in training order, each as often as `plan` (from `mixed`) takes it.

    Returns (position, words, row): row is the whole document, of which the first `words` words are
    taken. Range-partitioned and sorted by position. Of repeated rows one stands for all.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    keys = {"_id": F.col(id_col).cast("long"), "_source": F.col(source_col).cast("string"), "_digest": digest}
    rows = docs.select(*(c.alias(k) for k, c in keys.items()), F.struct("*").alias("row"))
    rows = rows.groupBy(*keys).agg(F.first("row").alias("row"))
    taken = plan.select(F.col("doc_id"), "source", "digest", F.explode("places").alias("place"))
    met = taken.join(rows, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
                     & F.col("source").eqNullSafe(F.col("_source")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (met.select("place.position", "place.words", "row")
            .repartitionByRange(parts, "position").sortWithinPartitions("position"))


def query(docs: DataFrame) -> DataFrame:
    """One row per document, range-sorted by the place (in billionths of training) it is first taken."""
    first = F.floor(F.get("places", F.lit(0))["position"] * F.lit(1e9)).cast("long")
    plan = mixed(docs).select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))
    return plan.orderBy(F.col("position").asc_nulls_last(), "doc_id")
