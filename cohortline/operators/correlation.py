"""Pearson correlation: pairwise-complete matrix, and against one target column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.names import numeric_columns, pretty_name, require
from cohortline.operators import batches as B
from cohortline.operators.bounded import cut

KEY_COLUMNS = ("id_carrera", "matricula")
#: Deviation, against the mean, below which a column is constant but for rounding.
ROUNDING = 1e-14


def _pearson(x: str, y: str) -> Column:
    """Correlation of two SQL expressions where both are known; null if either is constant there."""
    both = f"({x}) is not null and ({y}) is not null"
    x, y = f"if({both}, {x}, null)", f"if({both}, {y}, null)"
    return F.expr(f"try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y}))")


def _within_one(r: Column) -> Column:
    """Rounding may lead a hair beyond 1; what is not a number is undefined."""
    return F.when(F.isnan(r), None).when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def _double(column: str) -> str:
    """The column as double; NaN counts as missing."""
    return f"nanvl(cast(`{column}` as double), cast(null as double))"


def _products(k: int):
    """Masked block products of each batch, summed to one half matrix of co-moments per task.

    With values X (unknown: 0) and the mask M of known ones, M'M counts the rows a pair has in common,
    X'M sums one side over them, X'X their products. Values are taken from each column's first known
    one, so that sums do not cancel.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.full(k, np.nan)
        n, sums, squares, products, infinite = (np.zeros((k, k)) for _ in range(5))
        for batch in batches:
            x = np.column_stack([B.doubles(batch, f"c{i}") for i in range(k)])
            known, endless = ~np.isnan(x), np.isinf(x)
            new = np.isnan(shift) & (known & ~endless).any(axis=0)
            shift[new] = x[(known & ~endless).argmax(axis=0)[new], new.nonzero()[0]]
            d = np.where(known & ~endless, x - np.nan_to_num(shift), 0.0)
            mask, beyond = known.astype(float), endless.astype(float)
            n += mask.T @ mask
            sums += d.T @ mask
            squares += (d * d).T @ mask
            products += d.T @ d
            infinite += beyond.T @ mask
        i, j = np.nonzero(np.triu(n))
        if len(i):
            m, a, b = n[i, j], sums[i, j], sums[j, i]
            names = ["i", "j", "n", "x", "y", "xx", "yy", "xy", "infinite"]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (
                i.astype(np.int32), j.astype(np.int32), m, shift[i] + a / m, shift[j] + b / m,
                squares[i, j] - a * a / m, squares[j, i] - b * b / m, products[i, j] - a * b / m,
                infinite[i, j] + infinite[j, i])], names=names)
    return run


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long matrix (variable_1, variable_2, correlation) of the numeric columns, one pass.

    Each pair is taken over the rows that know both. A task folds its rows into one matrix; the
    matrices of all tasks are merged by their means and co-moments, a row per pair and task. Pairs
    without a common row, with an infinite value or with a constant side are undefined.
    """
    columns = columns or numeric_columns(df, drop=KEY_COLUMNS)
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = cut(doubles.mapInArrow(
        _products(len(columns)),
        "i int, j int, n double, x double, y double, xx double, yy double, xy double, infinite double"))
    n = F.sum("n")
    means = parts.groupBy("i", "j").agg(
        n.alias("all_n"), (F.sum(F.col("n") * F.col("x")) / n).alias("mean_x"),
        (F.sum(F.col("n") * F.col("y")) / n).alias("mean_y"), F.sum("infinite").alias("all_infinite"))
    dx, dy = F.col("x") - F.col("mean_x"), F.col("y") - F.col("mean_y")
    whole = parts.join(means, ["i", "j"]).groupBy("i", "j", "all_n", "mean_x", "mean_y", "all_infinite").agg(
        F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"),
        F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"),
        F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy"))

    def varies(square: str, mean: str) -> Column:
        # what rounding leaves of a constant column is no variation
        least = F.col("all_n") * F.pow(F.col(mean) * ROUNDING, F.lit(2))
        return (F.col(square) > least) & (F.col("all_infinite") == 0)

    r = F.when(varies("xx", "mean_x") & varies("yy", "mean_y"),
               F.col("xy") / (F.sqrt("xx") * F.sqrt("yy")))
    # as many rows as the matrix has cells
    every = df.sparkSession.createDataFrame(
        [(i, j, a, b) for i, a in enumerate(columns) for j, b in enumerate(columns)],
        "a int, b int, variable_1 string, variable_2 string")
    half = whole.select("i", "j", _within_one(r).alias("correlation"))
    return every.join(half, (F.least("a", "b") == F.col("i")) & (F.greatest("a", "b") == F.col("j")), "left").select(
        "variable_1", "variable_2", "correlation")


def _stacked(one_row: DataFrame, labels: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """The columns r0, r1, ... of a single row as rows behind their labels."""
    cells = F.array(*[
        F.struct(*[F.lit(text).alias(name) for text, name in zip(label, names)],
                 F.col(f"r{i}").alias(names[-1]))
        for i, label in enumerate(labels)])
    return one_row.select(F.explode(cells).alias("c")).select("c.*")


def matrix_wide(long: DataFrame, columns: list[str]) -> DataFrame:
    """The matrix with one column per variable."""
    return long.groupBy("variable_1").pivot("variable_2", columns).agg(F.first("correlation"))


def target_correlation(df: DataFrame, target: str = "resultado_final",
                       columns: list[str] | None = None,
                       labels: dict[str, str] | None = None) -> DataFrame:
    """Correlation of each numeric column with the target, ascending, undefined ones last."""
    columns = columns if columns is not None else numeric_columns(df)
    if target not in numeric_columns(df):
        raise ValueError(f"{target} is not a numeric column")
    columns = [c for c in columns if c != target]
    if not columns:
        raise ValueError("no numeric column to compare with the target")
    labels = labels or {}
    one_row = df.agg(*[_pearson(_double(c), _double(target)).alias(f"r{i}")
                       for i, c in enumerate(columns)])
    shown = [(labels.get(c, c),) for c in columns]
    return (
        _stacked(one_row, shown, ["variable", "correlation"])
        .withColumn("correlation", _within_one(F.col("correlation")))
        .orderBy(F.col("correlation").asc_nulls_last(), "variable")
    )


def category_predictive_power(snapshots: DataFrame, prefix: str = "promedio_pf_",
                              target: str = "resultado_final") -> DataFrame:
    """Target correlation of the per-category means, under readable names."""
    require(snapshots, target)
    columns = [c for c in snapshots.columns if c.startswith(prefix)]
    labels = {c: pretty_name(c, prefix) for c in columns}
    return target_correlation(snapshots, target, columns, labels)
