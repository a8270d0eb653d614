"""One-way ANOVA, chi-square independence, and linear trends with a bootstrap band."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.names import require
from cohortline.functions.tails import chi2_tail, f_tail
from cohortline.operators import batches as B
from cohortline.operators.bounded import cut, small
from cohortline.operators.counting import contingency

SIGNIFICANCE = 0.05
PRIME = 2_147_483_647
#: Rows of one weight matrix, and groups whose sums a task holds at a time.
WEIGHT_ROWS, HELD_GROUPS = 1_000, 200


def anova_statistic(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: F statistic, degrees of freedom, number of groups.

    F is null with fewer than two groups or when all values are equal, and infinite when the
    groups differ but none varies inside.
    """
    require(df, value, group)
    x = F.col(value).cast("double")
    groups = small(
        df.filter(F.col(group).isNotNull() & x.isNotNull())
        .groupBy(group)
        .agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"),
             F.min(x).alias("low"), F.max(x).alias("high"))
    )
    grand = groups.agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))).scalar()
    sums = groups.withColumn("offset", F.col("mean") - grand).agg(
        F.sum(F.col("n") * F.pow("offset", F.lit(2))).alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.count("*").alias("n_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"),
        (F.min("low") == F.max("high")).alias("all_equal"),
    )
    df_between = F.col("n_groups") - 1
    df_within = F.col("n_values") - F.col("n_groups")
    ratio = F.try_divide(F.col("between") / F.nullif(df_between, F.lit(0)),
                         F.try_divide(F.col("within"), df_within))
    f_stat = (
        F.when((df_between < 1) | (df_within < 1) | F.col("all_equal"), None)
        .when(F.col("within") == 0, F.lit(float("inf")))
        .otherwise(ratio)
    )
    return sums.select(
        f_stat.cast("double").alias("f_stat"), df_between.alias("df_between"),
        df_within.alias("df_within"), "n_groups", "n_values")


def verdict(df: DataFrame) -> DataFrame:
    """``significant``: p below 0.05; an undefined p is not significant."""
    return df.withColumn(
        "significant", F.coalesce(F.col("p_value") < SIGNIFICANCE, F.lit(False)))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """ANOVA with its p-value and verdict."""
    result = anova_statistic(df, value, group)
    return verdict(result.withColumn("p_value", f_tail("f_stat", "df_between", "df_within")))


def _margins(cells: DataFrame, row: str, column: str) -> DataFrame:
    rows = cells.groupBy(row).agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy(column).agg(F.sum("n").alias("col_n"))
    total = cells.agg(F.sum("n")).scalar()
    return (
        cells.join(rows, row).join(columns, column)
        .withColumn("total", total)
        .withColumn("expected", F.col("row_n") * F.col("col_n").cast("double") / F.col("total"))
    )


def chi_square_statistic(df: DataFrame, row: str, column: str) -> DataFrame:
    """One row: chi-square statistic, degrees of freedom, table size.

    Pairs that never occur add their expected count, which is the total minus the expected
    counts of the pairs that do; no pair table is spelled out.  A 2x2 table gets the Yates
    correction.  A table with one row or one column gives 0.
    """
    require(df, row, column)
    cells = small(contingency(df, row, column))
    margins = _margins(cells, row, column)
    r = cells.agg(F.countDistinct(row)).scalar()
    c = cells.agg(F.countDistinct(column)).scalar()
    sums = margins.agg(
        F.count("*").alias("n_cells"),
        F.sum(F.pow(F.col("n") - F.col("expected"), F.lit(2)) / F.col("expected")).alias("observed_part"),
        F.sum("expected").alias("expected_part"),
        F.max("total").alias("total"),
        F.max(F.abs(F.col("n") - F.col("expected"))).alias("gap"),
    ).withColumns({"n_rows": r, "n_columns": c})
    inverse_rows = cells.groupBy(row).agg(F.sum("n").alias("m")).agg(F.sum(1 / F.col("m"))).scalar()
    inverse_columns = (
        cells.groupBy(column).agg(F.sum("n").alias("m")).agg(F.sum(1 / F.col("m"))).scalar())
    dof = (F.col("n_rows") - 1) * (F.col("n_columns") - 1)
    missing = F.when(F.col("n_cells") == F.col("n_rows") * F.col("n_columns"), 0.0).otherwise(
        F.col("total") - F.col("expected_part"))
    corrected = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    chi2 = (
        F.when(F.col("n_cells") == 0, None)
        .when(dof == 0, 0.0)
        .when(dof == 1, corrected * corrected * F.col("total") * inverse_rows * inverse_columns)
        .otherwise(F.col("observed_part") + missing)
    )
    return sums.select(
        chi2.cast("double").alias("chi2"),
        F.when(F.col("n_cells") > 0, dof).alias("dof"),
        "n_rows", "n_columns", F.col("total").alias("n_values"))


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square test with its p-value and verdict."""
    result = chi_square_statistic(df, row, column)
    return verdict(result.withColumn("p_value", chi2_tail("chi2", "dof")))


def expected_counts(df: DataFrame, row: str, column: str) -> DataFrame:
    """Observed and expected count of every (row level, column level) pair, also unobserved ones.

    This is the full table a test works on, so its size is rows x columns by definition: the two
    margins, one row per level each, are paired in full.
    """
    cells = small(contingency(df, row, column))
    rows = cells.groupBy(row).agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy(column).agg(F.sum("n").alias("col_n"))
    total = cells.agg(F.sum("n")).scalar()
    grid = rows.crossJoin(columns).withColumn("total", total)
    return grid.join(cells, [row, column], "left").select(
        row, column, F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        (F.col("row_n") * F.col("col_n").cast("double") / F.col("total")).alias("expected"))


def student_profiles(history: DataFrame, group: str = "id_carrera",
                     entity: str = "alumno_carrera_hash") -> DataFrame:
    """Mean grade and attendance per (group, entity); nulls are skipped, null keys dropped."""
    return (
        history.filter(F.col(group).isNotNull() & F.col(entity).isNotNull())
        .groupBy(group, entity)
        .agg(F.avg("pf").alias("promedio_calificacion"), F.avg("pa").alias("promedio_asistencia"))
    )


def linear_trend(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x per group, over the rows that have both."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).cast("long").alias("n"),
    )


def _poisson_steps() -> list[float]:
    """Cumulative Poisson(1) probabilities up to the resolution of the draws."""
    steps, term, total, k = [], math.exp(-1), 0.0, 0
    while term * PRIME > 0.5:
        total += term
        steps.append(total)
        k += 1
        term /= k
    return steps


def _replicate_moments(group: str, replicates: int):
    """Weight matrix times moment matrix of each batch: (group, replicate) sums, one per task."""
    steps = [math.ceil(step * PRIME) for step in _poisson_steps()]
    numbers = np.arange(1, replicates + 1)
    names = ["n", "sx", "sy", "sxx", "sxy"]

    def rows(held: dict[tuple, np.ndarray], fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
        for key, sums in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(key) * replicates, fields[0].type), pa.array(numbers.astype(np.int32)),
                 *map(pa.array, sums.T.copy())], names=[group, "replicate", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        fields: list[pa.Field] = []
        for batch in batches:
            fields = B.key_fields(batch, [group])
            a, b = (batch.column(k).to_numpy() for k in ("a", "b"))
            dx, dy = (B.doubles(batch, k) for k in ("dx", "dy"))
            for key, place in B.group_slices(batch, [group]):
                sums = held.setdefault(key, np.zeros((replicates, 5)))
                for at in range(0, len(place), WEIGHT_ROWS):
                    own = place[at: at + WEIGHT_ROWS]
                    draw = (a[own, None] * numbers + b[own, None]) % PRIME
                    weight = np.zeros(draw.shape)
                    for step in steps:
                        weight += draw >= step
                    x, y = dx[own], dy[own]
                    sums += weight.T @ np.column_stack([np.ones(len(own)), x, y, x * x, x * y])
            if len(held) > HELD_GROUPS:
                yield from rows(held, fields)
                held = {}
        yield from rows(held, fields)
    return run


def _band(group: str, points: int, tails: list[float]):
    """Quantiles of a group's lines at evenly spaced x; a group has `replicates` lines."""
    def run(lines: pa.Table) -> pa.Table:
        slope, base, x_mid, y_mid, low, high = (
            lines.column(k).to_numpy() for k in ("slope", "base", "x_mid", "y_mid", "x_min", "x_max"))
        at = low[0] + np.arange(points) * ((high[0] - low[0]) / (points - 1))
        known = ~np.isnan(slope)
        q = np.full((2, points), np.nan)
        if known.any():
            y = y_mid[known, None] + base[known, None] + slope[known, None] * (at - x_mid[known, None])
            q = np.quantile(y, tails, axis=0)
        return pa.table({
            group: lines.column(group).take(pa.array([0] * points)), "point": pa.array(np.arange(points, dtype=np.int32)),
            "x": at, **{k: pa.array(v, from_pandas=True) for k, v in zip(("low", "high"), q)}})
    return run


def trend_band(df: DataFrame, group: str, entity: str, x: str, y: str,
               replicates: int = 1000, points: int = 100, level: float = 0.95,
               seed: int = 0) -> DataFrame:
    """Bootstrap band of the linear trend at evenly spaced x between a group's extremes.

    Every row gets a Poisson(1) weight in every replicate.  The weight is a fixed function of
    the entity, the replicate and the seed: two numbers from the entity's MD5 make a linear
    hash of the replicate number, so a lost task redraws the same weights.  A task multiplies the
    weights of a batch with its moments and hands on one row per (group, replicate).
    """
    both = cut(
        df.select(group, entity, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .dropna(subset=[group, "x", "y"]))
    limits = small(both.groupBy(group).agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.avg("x").alias("x_mid"),
        F.avg("y").alias("y_mid")))
    digest = F.md5(F.concat_ws("_", F.col(group).cast("string"), F.col(entity), F.lit(str(seed))))

    def part(start: int):
        return F.pmod(F.conv(F.substring(digest, start, 14), 16, 10).cast("long"), F.lit(PRIME))

    rows = both.join(limits, group).select(
        group, (F.col("x") - F.col("x_mid")).alias("dx"), (F.col("y") - F.col("y_mid")).alias("dy"),
        part(1).alias("a"), part(15).alias("b"))
    head = B.key_schema(rows, [group])
    moments = rows.mapInArrow(
        _replicate_moments(group, replicates),
        head + "replicate int, n double, sx double, sy double, sxx double, sxy double"
    ).groupBy(group, "replicate").agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "sxy")])
    slope = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.nullif("n", F.lit(0.0)),
                         F.col("sxx") - F.col("sx") * F.col("sx") / F.nullif("n", F.lit(0.0)))
    lines = moments.withColumn("slope", slope).withColumn(
        "base", F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), F.col("n")))
    tail = (1 - level) / 2
    return lines.join(limits, group).select(
        group, "slope", "base", "x_min", "x_max", "x_mid", "y_mid").groupBy(group).applyInArrow(
        _band(group, points, [tail, 1 - tail]), head + "point int, x double, low double, high double")
