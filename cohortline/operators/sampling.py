"""Exact-size sampling that gives the same rows under any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKED_ROWS = 100_000


def sample_exact(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: those whose key has the smallest MD5 under the seed.

    One counting pass over 65,536 hash ranges finds the range the n-th smallest hash lies in, so
    only rows up to that range are ranked.  A sample too large for one task to rank takes all
    rows below that range as they are and ranks the rows of that range only.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    keyed = df.withColumn("_draw", F.md5(F.concat_ws("|", F.lit(str(seed)), *text)))
    slot = F.substring("_draw", 1, 4)
    sizes = keyed.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()
    if n > sum(row["n"] for row in sizes):
        raise ValueError("cannot take a larger sample than the table has rows")
    below, edge = 0, ""
    for row in sorted(sizes, key=lambda r: r["slot"]):
        edge = row["slot"]
        if below + row["n"] >= n:
            break
        below += row["n"]
    order = ["_draw", *df.columns]
    if n <= RANKED_ROWS:
        return keyed.filter(slot <= edge).orderBy(*order).limit(n).drop("_draw")
    ranked = keyed.filter(slot == edge).orderBy(*order).limit(n - below)
    return keyed.filter(slot < edge).unionByName(ranked).drop("_draw")


def shape(df: DataFrame) -> tuple[int, int]:
    """Rows and columns."""
    return df.count(), len(df.columns)


def preview(df: DataFrame, *order, rows: int = 5) -> DataFrame:
    """First rows; with an order they are the same rows every time."""
    return (df.orderBy(*order) if order else df).limit(rows)
