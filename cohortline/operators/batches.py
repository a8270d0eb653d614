"""Arrow batches as numpy arrays, for steps that fold rows into one small state per task.

A state per (group, ...) is kept while a task runs. Where groups are many, states are handed on early
and summed by Spark, so that a task never holds more than `HELD` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: States of one task at a time.
HELD = 2_000


def key_schema(df: DataFrame, groups: list[str]) -> str:
    """The group columns as the head of a schema string."""
    return "".join(f"`{g}` {df.schema[g].dataType.simpleString()}, " for g in groups)


def doubles(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of doubles, nulls as NaN."""
    return pc.fill_null(batch.column(name), float("nan")).to_numpy(zero_copy_only=False)


def group_slices(batch: pa.RecordBatch, groups: list[str]) -> Iterator[tuple[tuple, np.ndarray | slice]]:
    """(key, rows) of every group of a batch; null is a key like others."""
    if not groups:
        yield (), slice(None)
        return
    codes, levels = np.zeros(batch.num_rows, np.int64), []
    for g in groups:
        coded = pc.dictionary_encode(batch.column(g), null_encoding="encode")
        levels.append(coded.dictionary.to_pylist())
        codes = codes * len(levels[-1]) + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        code, key = int(codes[order[a]]), []
        for level in reversed(levels):
            code, place = divmod(code, len(level))
            key.append(level[place])
        yield tuple(reversed(key)), order[a:b]


def record_batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, f.type) for x, f in zip(columns, fields)], names=[f.name for f in fields])


def key_fields(batch: pa.RecordBatch, groups: list[str]) -> list[pa.Field]:
    return [batch.schema.field(g) for g in groups]
