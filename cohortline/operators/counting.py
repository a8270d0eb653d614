"""Frequency, contingency and rate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.bounded import small


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each non-null value, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Observed (row, column) pairs with their counts; rows with a null key do not count."""
    return (
        df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row, column).agg(F.count("*").alias("n"))
    )


def contingency_wide(df: DataFrame, row: str, column: str, levels: list | None = None) -> DataFrame:
    """One column per level of ``column``, 0 where a pair does not occur."""
    cells = contingency(df, row, column)
    wide = cells.groupBy(row).pivot(column, levels).agg(F.sum("n"))
    return wide.fillna(0)


def rate_table(df: DataFrame, row: str, column: str) -> DataFrame:
    """Contingency cells with their percentage of the row total."""
    cells = small(contingency(df, row, column))
    totals = cells.groupBy(row).agg(F.sum("n").alias("row_total"))
    return cells.join(totals, row).select(
        row, column, "n", (F.col("n") * 100.0 / F.col("row_total")).alias("percent"))


def top_values(counts: DataFrame, groups: list[str], k: int, *order) -> DataFrame:
    """First k rows of each group; Spark keeps k per task before it shuffles."""
    ranked = counts.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)
