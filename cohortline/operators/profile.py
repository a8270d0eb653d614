"""Whole-table profile, as tables."""

from __future__ import annotations


import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from cohortline.functions.names import numeric_columns
from cohortline.operators import batches as B
from cohortline.operators.bounded import SMALL_ROWS, cut, in_passes, small, written
from cohortline.operators.counting import top_values
from cohortline.operators.quantiles import describe, described

PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Counters of a summary of heavy values, and the binary logarithm of a distinct sketch's registers.
HEAVY_VALUES, SKETCH = 1_000, 12


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BooleanType))]


def long_text(df: DataFrame) -> DataFrame:
    """(column, value) of every string and boolean cell, nulls included."""
    names = text_columns(df)
    wide = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    return wide.unpivot([], [F.col(f"`{c}`") for c in names], "column", "value")


def _missing_cells(df: DataFrame):
    total = F.lit(0)
    for c in df.columns:
        total = total + F.col(f"`{c}`").isNull().cast("int")
    return total


def _fingerprint(df: DataFrame) -> list[Column]:
    """128 bits of a whole row, nulls included."""
    cells = [F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in df.columns]
    return [F.xxhash64(*cells).alias("_f1"), F.xxhash64(F.lit("row"), *cells).alias("_f2")]


def _repeated(df: DataFrame, stored: bool,
              then: Callable[[DataFrame], DataFrame] = lambda copies: copies) -> DataFrame:
    """``then`` of the rows that occur more than once, with their counts, or of each pass over them.

    Rows are counted by fingerprint; whole rows are compared, and shuffled, only where a fingerprint
    occurs again. Where that holds for many, a df that comes from storage is compared in passes.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(*names, *_fingerprint(df))
    again = written(rows.groupBy("_f1", "_f2").agg(F.count("*").alias("_n")).filter("_n > 1").select("_f1", "_f2"))
    few = again.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    again = small(again) if few else again

    def whole(part: DataFrame) -> DataFrame:
        return then(
            part.join(again, ["_f1", "_f2"], "left_semi")
            .groupBy("_f1", "_f2", *names).agg(F.count("*").alias("n_copies"))
            .filter(F.col("n_copies") > 1).select(*names, "n_copies"))

    return whole(rows) if few or not stored else in_passes(rows, F.col("_f1"), whole, stored=True)


def duplicates(df: DataFrame, stored: bool = False) -> DataFrame:
    """Rows that occur more than once, with their counts."""
    return _repeated(df, stored)


def overview(df: DataFrame, stored: bool = False) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows, columns per type.

    Rows meet as fingerprints of 16 bytes; whole rows only where a fingerprint occurs again.
    """
    types = [f.dataType for f in df.schema.fields]
    count = {
        "n_numeric": sum(isinstance(t, NumericType) for t in types),
        "n_text": sum(isinstance(t, StringType) for t in types),
        "n_boolean": sum(isinstance(t, BooleanType) for t in types),
    }
    sums = (
        df.select(*_fingerprint(df), _missing_cells(df).alias("_missing"))
        .groupBy("_f1", "_f2").agg(F.count("*").alias("_copies"), F.sum("_missing").alias("_missing"))
        .agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"),
             F.coalesce(F.sum("_missing"), F.lit(0)).alias("n_missing_cells"),
             F.count_if(F.col("_copies") > 1).alias("_again")).first())
    n = 0
    if sums["_again"]:
        more = _repeated(df, stored, lambda copies: copies.agg(F.sum(F.col("n_copies") - 1).alias("n")))
        n = more.agg(F.sum("n")).first()[0] or 0
    row = {"n_rows": sums["n_rows"], "n_columns": len(df.columns),
           "n_missing_cells": sums["n_missing_cells"], "n_duplicate_rows": n, **count}
    return df.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))


def numeric_summary(df: DataFrame, stored: bool = False) -> DataFrame:
    """One row per numeric column: counts, extremes, moments and exact percentiles.

    Skewness and kurtosis carry the usual small-sample correction; the deviation measure is the
    median absolute deviation.  One pass folds all columns; those with more distinct values than a
    summary holds are stored, unless df comes from storage itself, and read again, for the ranks inside
    brackets, their distinct values and their deviations.
    """
    columns = numeric_columns(df)
    found, many, rows = described(df, [], columns, list(PERCENTILES), stored)
    found = small(found)
    if many:
        cells = rows.unpivot([], [F.col(f"`{c}`") for c in many], "_column", "value")
        counted = cells.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("_column", "value").agg(
            F.count("*").alias("n")).groupBy("_column").agg(
            F.count("*").alias("_distinct"), F.count_if(F.col("n") == 1).alias("_unique"))
        middle = {r["_column"]: r["q"][2] for r in found.select("_column", "q").collect()}
        deviations = rows.select(*[F.abs(F.col(f"`{c}`") - F.lit(middle[c])).alias(c) for c in many])
        mads = describe(deviations, [], many, [0.5], stored=True).select("_column", F.col("q")[0].alias("_mad"))
        found = found.join(counted, "_column", "left").join(mads, "_column", "left").withColumns({
            "n_distinct": F.coalesce("n_distinct", "_distinct"),
            "n_unique": F.coalesce("n_unique", "_unique"), "mad": F.coalesce("mad", "_mad")})
    m = F.col("n").cast("double")
    spread = F.nullif(F.col("m2"), F.lit(0.0)) / m
    g1 = F.col("m3") / m / F.pow(spread, F.lit(1.5))
    g2 = F.col("m4") / m / (spread * spread) - 3
    skew = F.when(m > 2, g1 * F.sqrt(m * (m - 1)) / F.nullif(m - 2, F.lit(0.0)))
    kurt = F.when(m > 3, ((m + 1) * g2 + 6) * (m - 1)
                  / F.nullif((m - 2) * (m - 3), F.lit(0.0)))
    variance = F.when(m > 1, F.col("m2") / F.nullif(m - 1, F.lit(0.0)))
    named = [F.col("q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(PERCENTILES)]
    return found.select(
        F.col("_column").alias("column"), "n_rows", (F.col("n_rows") - F.col("n")).alias("n_missing"),
        F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"),
        F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"), "n_zeros", "n_negative",
        F.col("v_min").alias("min"), F.col("v_max").alias("max"),
        (F.col("v_max") - F.col("v_min")).alias("range"), "mean", F.col("v_sum").alias("sum"),
        F.sqrt(variance).alias("sd"), variance.alias("variance"),
        F.try_divide(F.sqrt(variance), F.col("mean")).alias("cv"),
        skew.alias("skewness"), kurt.alias("kurtosis"), *named,
        (F.col("q")[3] - F.col("q")[1]).alias("iqr"), "mad")


def text_summary(df: DataFrame) -> DataFrame:
    """One row per string or boolean column: missing, distinct and unique values, text lengths."""
    counts = long_text(df).groupBy("column", "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    length = F.length("value")
    return counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
        F.count_if(known & (F.col("n") == 1)).alias("n_unique"),
        F.min(length).cast("long").alias("min_length"),
        F.try_divide(F.sum(F.when(known, length * F.col("n"))),
                     F.sum(F.when(known, F.col("n")))).alias("mean_length"),
        F.max(length).cast("long").alias("max_length"),
    )


def _heavy(columns: list[str], most: int):
    """At most `most` values per column of a task's rows, with counts, and what any value may lack.

    Whenever there are more, the count of the next one is taken off all and those at zero go; what was
    taken off so far is the most that a task can have missed of any value.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {c: Counter() for c in columns}
        missed = dict.fromkeys(columns, 0)
        for batch in frames:
            for c in columns:
                counted = pc.value_counts(batch.column(c))
                own = held[c]
                own.update(dict(zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist())))
                own.pop(None, None)
                if len(own) > most:
                    less = sorted(own.values(), reverse=True)[most]
                    missed[c] += less
                    held[c] = Counter({v: n - less for v, n in own.items() if n > less})
        rows = [(c, None, missed[c]) for c in columns] + [(c, v, n) for c in columns for v, n in held[c].items()]
        yield B.record_batch(rows, [
            pa.field("column", pa.string()), pa.field("value", pa.string()), pa.field("n", pa.int64())])
    return run


def top_text_values(df: DataFrame, k: int = 10, most: int = HEAVY_VALUES, stored: bool = False) -> DataFrame:
    """The k most frequent values of each string or boolean column, exactly.

    Tasks summarise each column in `most` counters; the summaries add up to candidates and to the most
    that any value can lack. Candidates are counted again in the rows where something was missed. A
    column whose k-th candidate is not above that bound has no such heavy values: all of its values
    are counted. The columns that are read again are stored first, unless df comes from storage itself.
    """
    names = text_columns(df)
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    parts = cut(rows.mapInArrow(_heavy(names, most), "column string, value string, n long").groupBy(
        "column", "value").agg(F.sum("n").alias("n")))
    # a null value holds what was missed; one row per column
    missed = {r["column"]: r["n"] for r in parts.filter("value is null").collect()}
    found = parts.filter("value is not null")
    unsure = [c for c in names if missed.get(c)]
    known = top_values(found.filter(~F.col("column").isin(unsure)), ["column"], k, F.desc("n"), "value")
    if unsure:
        again = rows.select(*[F.col(f"`{c}`") for c in unsure])
        cells = (again if stored else cut(again)).unpivot(
            [], [F.col(f"`{c}`") for c in unsure], "column", "value").filter(F.col("value").isNotNull())
        likely = small(found.filter(F.col("column").isin(unsure)).select("column", "value"))
        counted = top_values(cells.join(likely, ["column", "value"]).groupBy("column", "value").agg(
            F.count("*").alias("n")), ["column"], k, F.desc("n"), "value")
        least = {r["column"]: r["n"] for r in counted.filter(F.col("rank") == k).select("column", "n").collect()}
        flat = [c for c in unsure if least.get(c, 0) <= missed[c]]
        known = known.unionByName(counted.filter(~F.col("column").isin(flat)))
        if flat:
            known = known.unionByName(top_values(
                cells.filter(F.col("column").isin(flat)).groupBy("column", "value").agg(F.count("*").alias("n")),
                ["column"], k, F.desc("n"), "value"))
    return known.select("column", F.col("rank").cast("long").alias("rank"), "value", "n")


def distinct_sketches(df: DataFrame, group: str, columns: list[str] | None = None,
                      lg_k: int = SKETCH) -> DataFrame:
    """(group, column, n, sketch): one mergeable sketch of distinct values per group and column.

    Sketches of a few kilobytes can be stored and added up later over any groups, without the rows.
    """
    columns = columns or [c for c in df.columns if c != group]
    sketches = df.groupBy(group).agg(
        F.count("*").alias("n"),
        *[F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(lg_k)).alias(f"s{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)])
    return sketches.select(group, "n", F.explode(cells).alias("c")).select(group, "c.column", "n", "c.sketch")


def distinct_estimates(sketches: DataFrame, lg_k: int = SKETCH) -> DataFrame:
    """(column, n_rows, n_distinct, low, high): the sketches of all groups added up.

    The true number lies between low and high, three standard errors off, but for one case in some
    hundreds.
    """
    error = 3 * 1.04 / math.sqrt(2**lg_k)
    whole = sketches.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
    return whole.withColumns({"low": F.col("n_distinct") * (1 - error), "high": F.col("n_distinct") * (1 + error)})


def _ends(columns: list[str], k: int):
    """The k least and k greatest distinct values of a task's rows with their counts.

    A value among the k least of all is among the k least of every task that meets it, so the sums
    over tasks are exact for them.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(c, side): (np.zeros(0), np.zeros(0, np.int64)) for c in columns for side in ("low", "high")}
        for batch in frames:
            for c in columns:
                x = B.doubles(batch, c)
                values, counts = np.unique(x[~np.isnan(x)], return_counts=True)
                for side in ("low", "high"):
                    own = held[c, side]
                    both, where = np.unique(np.concatenate((own[0], values)), return_inverse=True)
                    n = np.bincount(where, np.concatenate((own[1], counts)), len(both)).astype(np.int64)
                    part = slice(None, k) if side == "low" else slice(-k, None)
                    held[c, side] = both[part], n[part]
        yield B.record_batch(
            [(c, side, float(v), int(n)) for (c, side), x in held.items() for v, n in zip(*x)],
            [pa.field("column", pa.string()), pa.field("side", pa.string()), pa.field("value", pa.float64()),
             pa.field("n", pa.int64())])
    return run


def extremes(df: DataFrame, k: int = 5) -> DataFrame:
    """The k smallest and k largest distinct values of each numeric column, with counts."""
    columns = numeric_columns(df)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    counts = rows.mapInArrow(_ends(columns, k), "column string, side string, value double, n long").groupBy(
        "column", "side", "value").agg(F.sum("n").alias("n"))
    nearness = F.when(F.col("side") == "low", F.col("value")).otherwise(-F.col("value"))
    return top_values(counts, ["column", "side"], k, nearness).select(
        "column", "side", F.col("rank").cast("long").alias("rank"), "value", "n")


def _null_patterns(df: DataFrame) -> DataFrame:
    """Which columns are null together, with the number of rows; combines on the map side."""
    nulls = F.array_compact(F.array(*[
        F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in df.columns]))
    return df.groupBy(nulls.alias("nulls")).agg(F.count("*").alias("n"))


def missingness(df: DataFrame) -> DataFrame:
    """Null count and share of every column."""
    return _missing_of(_null_patterns(df), df.columns)


def _missing_of(patterns: DataFrame, columns: list[str]) -> DataFrame:
    names = F.explode(F.array(*[F.lit(c) for c in columns]))
    return (
        patterns.select(names.alias("column"), "nulls", "n")
        .groupBy("column").agg(
            F.sum(F.when(F.array_contains("nulls", F.col("column")), F.col("n"))
                  .otherwise(F.lit(0))).cast("long").alias("n_missing"),
            F.sum("n").alias("n_rows"))
        .select("column", "n_missing", "n_rows",
                (F.col("n_missing") / F.col("n_rows")).alias("share"))
    )


def co_missing(df: DataFrame) -> DataFrame:
    """Pairs of columns that are null in the same row: row count and nullity correlation.

    Pairs come from the distinct null patterns, never from the rows; the patterns are stored, so
    the rows are read once.
    """
    patterns = cut(_null_patterns(df))
    single = _missing_of(patterns, df.columns).filter(F.col("n_missing") > 0)
    left = patterns.select("n", "nulls", F.explode("nulls").alias("column_1"))
    pairs = (
        left.select("n", "column_1", F.explode("nulls").alias("column_2"))
        .filter(F.col("column_1") < F.col("column_2"))
        .groupBy("column_1", "column_2").agg(F.sum("n").alias("n_both")))
    one = single.select(F.col("column").alias("column_1"), F.col("n_missing").alias("m1"), "n_rows")
    two = single.select(F.col("column").alias("column_2"), F.col("n_missing").alias("m2"))
    p1, p2 = F.col("m1") / F.col("n_rows"), F.col("m2") / F.col("n_rows")
    spread = F.sqrt(p1 * (1 - p1) * p2 * (1 - p2))
    return pairs.join(one, "column_1").join(two, "column_2").select(
        "column_1", "column_2", "n_both",
        F.try_divide(F.col("n_both") / F.col("n_rows") - p1 * p2, spread).alias("nullity_correlation"))
