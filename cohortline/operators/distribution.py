"""The tables behind histograms, density curves and box plots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.names import present, pretty_name, require
from cohortline.operators import batches as B
from cohortline.operators.bounded import cut, small
from cohortline.operators.quantiles import quantiles

#: Bandwidths beyond which a kernel adds less than a double's last bit.
REACH = 8.5
#: Share of a whisker limit that rounding may put a value beyond it.
SLACK = 1e-9


def melt_backlog(snapshots: DataFrame, columns: list[str], target: str = "resultado_final",
                 prefix: str = "materias_reprobadas_") -> DataFrame:
    """Long form (target, categoria_rezago, cantidad) of those columns that exist."""
    valid = present(snapshots, columns)
    if not valid:
        raise ValueError("none of the columns exists")
    titles = {c: pretty_name(c, prefix) for c in valid}
    renamed = snapshots.select(
        target, *[F.col(c).cast("double").alias(titles[c]) for c in valid])
    return renamed.unpivot([target], [F.col(f"`{t}`") for t in titles.values()],
                           "categoria_rezago", "cantidad")


def known_values(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, x): the known values as doubles, NaN counting as missing, rows of known groups."""
    rows = df.select(*groups, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("x"))
    return rows.dropna(subset=[*groups, "x"])


def _limits(low: Column, high: Column) -> list[Column]:
    flat = low == high
    return [F.when(flat, low - 0.5).otherwise(low).alias("low"),
            F.when(flat, high + 0.5).otherwise(high).alias("high")]


def histogram(df: DataFrame, value: str, group: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over each group's own range, last bin closed, empty bins included.

    A group with a single value gets a range of one around it. One pass finds the ranges, one
    counts rows per bin on the map side.
    """
    require(df, value, group)
    rows = cut(known_values(df, [group], value))
    limits = small(rows.groupBy(group).agg(*_limits(F.min("x"), F.max("x"))))
    limits = limits.withColumn("width", (F.col("high") - F.col("low")) / bins)

    def edge(i):
        return F.col("low") + i * F.col("width")

    guess = F.least(
        F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins),
        F.lit(bins - 1)).cast("int")
    # the edges decide, as rounding may put a value next to one on the wrong side
    placed = F.when(F.col("x") < edge(F.col("_guess")), F.col("_guess") - 1).when(
        (F.col("x") >= edge(F.col("_guess") + 1)) & (F.col("_guess") < bins - 1), F.col("_guess") + 1
    ).otherwise(F.col("_guess"))
    filled = (
        rows.join(limits, group).withColumn("_guess", guess)
        .groupBy(group, (placed + 1).alias("bin")).agg(F.count("*").alias("n"))
    )
    grid = limits.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return grid.join(filled, [group, "bin"], "left").select(
        group, "bin", edge(F.col("bin") - 1).alias("low"), edge(F.col("bin")).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def column_histograms(df: DataFrame, columns: list[str], bins: int = 20, stored: bool = False) -> DataFrame:
    """(column, bin, low, high, n) of each numeric column, bins as in `histogram`.

    Ranges come from one pass of minima and maxima; in the second every task adds its rows to one
    array of counts per column, which Spark sums. A column without known values has no bins. The
    columns are stored between the passes, unless df comes from storage itself.
    """
    rows = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(c) for c in columns])
    rows = rows if stored else cut(rows)
    ends = rows.agg(*[f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(columns)
                      for k, f in (("low", F.min), ("high", F.max))]).first()
    limits = {}
    for i, c in enumerate(columns):
        low, high = ends[f"low{i}"], ends[f"high{i}"]
        if low is not None:
            limits[c] = (low - 0.5, high + 0.5) if low == high else (low, high)

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {c: np.zeros(bins, np.int64) for c in limits}
        for batch in frames:
            for c, (low, high) in limits.items():
                x = B.doubles(batch, c)
                x = x[~np.isnan(x)]
                width = (high - low) / bins
                place = np.minimum(np.floor((x - low) / (high - low) * bins), bins - 1)
                under = x < low + place * width
                over = ~under & (x >= low + (place + 1) * width) & (place < bins - 1)
                counts[c] += np.bincount((place - under + over).astype(np.int64), minlength=bins)
        yield B.record_batch([(c, n.tolist()) for c, n in counts.items()], [
            pa.field("column", pa.string()), pa.field("counts", pa.list_(pa.int64()))])

    spark = df.sparkSession
    frame = spark.createDataFrame([(c, *x) for c, x in limits.items()], "column string, low double, high double")
    width = (F.col("high") - F.col("low")) / bins
    filled = rows.mapInArrow(fold, "column string, counts array<bigint>").select(
        "column", F.posexplode("counts").alias("at", "n")).groupBy("column", "at").agg(F.sum("n").alias("n"))
    return filled.join(F.broadcast(frame), "column").select(
        "column", (F.col("at") + 1).alias("bin"), (F.col("low") + F.col("at") * width).alias("low"),
        (F.col("low") + (F.col("at") + 1) * width).alias("high"), "n")


def _kernel_sums(group: str, points: int):
    """Each batch adds its values to the grid points within the kernel's reach of their cells."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        fields = None
        for batch in frames:
            fields = fields or [*B.key_fields(batch, [group]), pa.field("masses", pa.list_(pa.float64()))]
            x, width, low, step = (B.doubles(batch, k) for k in ("x", "bandwidth", "low", "step"))
            for key, rows in B.group_slices(batch, [group]):
                value, n = np.unique(x[rows], return_counts=True)
                at = rows[0]
                cell = np.rint((value - low[at]) / step[at])
                masses = held.setdefault(key, np.zeros(points))
                reach = int(min(np.ceil(REACH * width[at] / step[at]), points))
                for offset in range(-reach, reach + 1):
                    point = cell + offset
                    on = (point >= 0) & (point < points)
                    z = (low[at] + point[on] * step[at] - value[on]) / width[at]
                    masses += np.bincount(point[on].astype(np.int64), n[on] * np.exp(-0.5 * z * z), points)
            if len(held) > B.HELD:
                yield B.record_batch([(*k, m.tolist()) for k, m in held.items()], fields)
                held = {}
        if held:
            yield B.record_batch([(*k, m.tolist()) for k, m in held.items()], fields)
    return run


def kde(df: DataFrame, value: str, group: str, cut_width: float = 3.0,
        points: int = 200) -> DataFrame:
    """Gaussian density per group on an even grid, Scott bandwidth, each group normalised alone.

    The grid reaches ``cut_width`` bandwidths beyond the data; 0 ends it at the extremes.
    Groups with fewer than two rows or without spread have no density.  A value meets the grid
    points within the kernel's reach of its cell; a task hands on one array per group.
    """
    require(df, value, group)
    rows = cut(known_values(df, [group], value))
    bandwidth = F.col("sd") * F.pow(F.col("total"), F.lit(-0.2))
    frames = small(
        rows.groupBy(group).agg(
            F.count("*").alias("total"), F.min("x").alias("v_min"), F.max("x").alias("v_max"),
            F.stddev_samp("x").alias("sd"))
        .filter((F.col("total") > 1) & (F.col("v_min") < F.col("v_max")))
        .withColumn("bandwidth", bandwidth)
        .withColumn("low", F.col("v_min") - cut_width * F.col("bandwidth"))
        .withColumn("step", (F.col("v_max") + cut_width * F.col("bandwidth") - F.col("low"))
                    / (points - 1))
        .select(group, "total", "bandwidth", "low", "step", "v_min", "v_max"))
    at = F.col("low") + F.col("point") * F.col("step")
    sums = (
        rows.join(frames.select(group, "bandwidth", "low", "step"), group)
        .mapInArrow(_kernel_sums(group, points), B.key_schema(rows, [group]) + "masses array<double>")
        .select(group, F.posexplode("masses").alias("point", "mass"))
        .groupBy(group, "point").agg(F.sum("mass").alias("mass")))
    scale = F.col("total") * F.col("bandwidth") * math.sqrt(2 * math.pi)
    return sums.join(frames, group).select(
        group, "point", at.alias("x"), (F.col("mass") / scale).alias("density"),
        "total", "v_min", "v_max")


def survival_kde(snapshots: DataFrame, value: str, target: str = "resultado_final") -> DataFrame:
    """Density of a category mean per outcome, over entities that took the category (mean > 0)."""
    require(snapshots, value, target)
    taken = snapshots.filter(F.col(value) > 0)
    return kde(taken, value, target).select(target, "point", "x", "density")


def grade_kde(df: DataFrame, value: str = "pf", group: str = "id_carrera",
              bins: int = 20) -> DataFrame:
    """Density within the data range, also scaled to the counts of a histogram of ``bins`` bins."""
    curve = kde(df, value, group, cut_width=0.0)
    bar_area = F.col("total") * (F.col("v_max") - F.col("v_min")) / bins
    return curve.select(group, "point", "x", "density",
                        (F.col("density") * bar_area).alias("frequency"))


def box_summary(df: DataFrame, value: str, groups: list[str], whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the furthest value within 1.5 IQR of the box, outlier count.

    A value within a billionth of a limit lies inside: means that are equal but for the order of
    their sums then fall on one side.
    """
    require(df, value, *groups)
    rows = cut(known_values(df, groups, value))
    boxes = small(quantiles(rows, groups, "x", [0.25, 0.5, 0.75], stored=True).select(
        *groups, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3")))
    reach = whisker * (F.col("q3") - F.col("q1"))
    v, low, high = F.col("x"), F.col("q1") - reach, F.col("q3") + reach
    inside = (v >= low - SLACK * (1 + F.abs(low))) & (v <= high + SLACK * (1 + F.abs(high)))
    return rows.join(boxes, groups).groupBy(*groups, "q1", "median", "q3").agg(
        F.least(F.min(F.when(inside, v)), F.col("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, v)), F.col("q3")).alias("whisker_high"),
        F.count("*").alias("n"), F.count_if(~inside).alias("n_outliers"))


def backlog_box(snapshots: DataFrame, columns: list[str],
                target: str = "resultado_final") -> DataFrame:
    """Box summary of failed-subject counts per category and outcome."""
    melted = melt_backlog(snapshots, columns, target)
    return box_summary(melted, "cantidad", ["categoria_rezago", target]).drop("n_outliers")
