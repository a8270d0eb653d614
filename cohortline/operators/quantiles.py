"""Counts, moments and exact quantiles per group, in one pass and a narrow second one.

Each task folds its rows into one state per (group, column): counts, central moments and a summary of
the sorted values. A summary is a list of (value, weight) points. It holds every distinct value with its
count as long as there are few; beyond `POINTS` of them, neighbours are merged into blocks, and the
number of values that a block may hide is added to the summary's error. Summaries merge by merging
their points, errors add up. So the rank of every point is known within the error, and every wanted
quantile is either known or bracketed between two points. One pass over the rows inside the brackets
then settles the open ones exactly; it holds distinct values of the brackets only.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators import batches as B
from cohortline.operators.bounded import cut, small

#: Points of a summary: the error of one merging is the number of values divided by this.
POINTS = 4_096
_COUNTS = ["n_rows", "n_zeros", "n_negative"]
_MOMENTS = ["mean", "m2", "m3", "m4"]
_STATE = [("_column", pa.string(), "string"), *((k, pa.int64(), "bigint") for k in _COUNTS),
          ("n", pa.int64(), "bigint"), *((k, pa.float64(), "double") for k in _MOMENTS),
          ("v_sum", pa.float64(), "double"), ("v_min", pa.float64(), "double"),
          ("v_max", pa.float64(), "double"), ("values", pa.list_(pa.float64()), "array<double>"),
          ("weights", pa.list_(pa.int64()), "array<bigint>"), ("error", pa.int64(), "bigint")]
_RANKS = pa.list_(pa.struct([
    ("fraction", pa.float64()), ("low_rank", pa.int64()), ("high_rank", pa.int64()),
    ("low", pa.float64()), ("high", pa.float64())]))
_RANKS_SQL = "array<struct<fraction:double,low_rank:bigint,high_rank:bigint,low:double,high:double>>"
_OPEN = pa.list_(pa.struct([("above", pa.float64()), ("upto", pa.float64())]))
_FOUND = [*_STATE[:-3], ("n_distinct", pa.int64(), "bigint"), ("n_unique", pa.int64(), "bigint"),
          ("mad", pa.float64(), "double"), ("ranks", _RANKS, _RANKS_SQL),
          ("open", _OPEN, "array<struct<above:double,upto:double>>")]
STATISTICS = [name for name, *_ in _FOUND if name not in ("_column", "ranks", "open")]


class Summary:
    """Sorted distinct points with weights, and the number of values that ranks may be off by."""

    def __init__(self, values: np.ndarray, weights: np.ndarray, error: int = 0):
        self.values, self.weights, self.error = values, weights, error

    @classmethod
    def merged(cls, parts: list[Summary], points: int = POINTS) -> Summary:
        values = np.concatenate([p.values for p in parts])
        weights = np.concatenate([p.weights for p in parts])
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
        first = np.ones(len(values), bool)
        first[1:] = values[1:] != values[:-1]
        starts = np.flatnonzero(first)
        error = sum(p.error for p in parts)
        if not len(starts):
            return cls(values, weights, error)
        return cls(values[starts], np.add.reduceat(weights, starts), error).within(points)

    def within(self, points: int) -> Summary:
        """Blocks of neighbours instead, named after their last point, if there are more points.

        A block ends with the first point that fills it, so a value with many copies hides nothing.
        """
        if len(self.values) <= points:
            return self
        before = np.cumsum(self.weights) - self.weights
        block = before * points // int(self.weights.sum())
        ends = np.append(np.flatnonzero(np.diff(block)), len(block) - 1)
        weights = np.add.reduceat(self.weights, np.append(0, ends[:-1] + 1))
        hidden = int((weights - self.weights[ends]).max())
        return Summary(self.values[ends], weights, self.error + hidden)

    def bracket(self, rank: int) -> tuple[float | None, float]:
        """(above, upto]: the value of this rank (from 0) lies there, None: no bound; (v, v) if it is v."""
        upto = np.cumsum(self.weights)
        k = int(np.searchsorted(upto, rank + 1))
        if not self.error:
            return float(self.values[k]), float(self.values[k])
        below = int(np.searchsorted(upto, rank - self.error, side="right")) - 1
        return (float(self.values[below]) if below >= 0 else None), float(self.values[k])


class _Tower:
    """Summaries of a stream of parts; two of one level merge into the next, so errors grow slowly."""

    def __init__(self):
        self.levels: dict[int, Summary] = {}

    def add(self, part: Summary) -> None:
        level = 0
        while level in self.levels:
            part = Summary.merged([self.levels.pop(level), part])
            level += 1
        self.levels[level] = part

    def whole(self) -> Summary:
        none = Summary(np.zeros(0), np.zeros(0, np.int64))
        return Summary.merged([none, *(self.levels[k] for k in sorted(self.levels))])


class _State:
    def __init__(self):
        self.tower = _Tower()
        self.counts = np.zeros(3, np.int64)
        self.n, self.numbers = 0, (0.0,) * len(_MOMENTS)
        self.sum, self.low, self.high = 0.0, float("inf"), float("-inf")

    def add(self, counts, n: int, mean: float, m2: float, m3: float, m4: float, total: float,
            low: float, high: float) -> None:
        """Add the counts and central sums of further values (pairwise merging)."""
        self.counts += counts
        if not n:
            return
        self.sum, self.low, self.high = self.sum + total, min(self.low, low), max(self.high, high)
        if not self.n:
            self.n, self.numbers = n, (mean, m2, m3, m4)
            return
        a, b, (own, own2, own3, own4) = self.n, n, self.numbers
        both = a + b
        with np.errstate(all="ignore"):  # infinite values have no moments
            d = np.float64(mean) - own
            self.numbers = tuple(float(x) for x in (
                own + d * b / both,
                own2 + m2 + d * d * a * b / both,
                own3 + m3 + d**3 * a * b * (a - b) / both**2 + 3 * d * (a * m2 - b * own2) / both,
                own4 + m4 + d**4 * a * b * (a * a - a * b + b * b) / both**3
                + 6 * d * d * (a * a * m2 + b * b * own2) / both**2 + 4 * d * (a * m3 - b * own3) / both))
        self.n = both

    def figures(self) -> tuple:
        return *self.counts.tolist(), self.n, *self.numbers, self.sum, self.low, self.high

    def row(self, key: tuple, column: str) -> tuple:
        s = self.tower.whole()
        return *key, column, *self.figures(), s.values.tolist(), s.weights.tolist(), s.error


def _fold(groups: list[str], columns: list[str]):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _State] = {}
        fields = None
        for batch in frames:
            fields = fields or [*B.key_fields(batch, groups), *(pa.field(k, t) for k, t, _ in _STATE)]
            values = {c: B.doubles(batch, c) for c in columns}
            for key, rows in B.group_slices(batch, groups):
                for c in columns:
                    own = values[c][rows]
                    known = own[~np.isnan(own)]
                    state = held.setdefault((key, c), _State())
                    counts = len(own), (known == 0).sum(), (known < 0).sum()
                    if not len(known):
                        state.add(counts, 0, *(0.0,) * 7)
                        continue
                    part = Summary(*np.unique(known, return_counts=True))
                    with np.errstate(all="ignore"):
                        mean = known.mean()
                        sums = [((part.values - mean)**k * part.weights).sum() for k in (2, 3, 4)]
                        state.add(counts, len(known), *map(float, (
                            mean, *sums, known.sum(), part.values[0], part.values[-1])))
                    state.tower.add(part)
            if len(held) > B.HELD:
                yield B.record_batch([s.row(*k) for k, s in held.items()], fields)
                held = {}
        if held:
            yield B.record_batch([s.row(*k) for k, s in held.items()], fields)
    return run


def _weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    whole = Summary(values[order], weights[order])
    n = int(weights.sum())
    return (whole.bracket((n - 1) // 2)[0] + whole.bracket(n // 2)[0]) / 2


def _settle(groups: list[str], probabilities: list[float]):
    """One row per (group, column) from its states, which come together."""
    def finished(key: tuple, column: str, state: _State) -> tuple:
        whole, n = state.tower.whole(), state.n
        ranks, brackets, exact = [], [], not whole.error
        for p in probabilities if n else ():
            at = p * (n - 1)
            low_rank, high_rank = int(np.floor(at)), int(np.ceil(at))
            low, high = whole.bracket(low_rank), whole.bracket(high_rank)
            brackets += [low, high]
            ranks.append((at - low_rank, low_rank, high_rank, *((low[1], high[1]) if exact else (None, None))))
        open_: list[list[float]] = []
        for above, upto in [] if exact else sorted(brackets, key=lambda b: (b[0] is not None, b[0] or 0.0, b[1])):
            if open_ and (above is None or above < open_[-1][1]):
                open_[-1][1] = max(open_[-1][1], upto)
            else:
                open_.append([above, upto])
        mad = None
        if exact and n:
            with np.errstate(all="ignore"):
                middle = (whole.bracket((n - 1) // 2)[0] + whole.bracket(n // 2)[0]) / 2
                mad = _weighted_median(np.abs(whole.values - middle), whole.weights)
        figures = state.figures() if n else (*state.counts.tolist(), 0, *(None,) * 7)
        return (*key, column, *figures, len(whole.values) if exact else None, int((whole.weights == 1).sum()) if exact else None, mad,
                [dict(zip(("fraction", "low_rank", "high_rank", "low", "high"), r)) for r in ranks],
                [{"above": a, "upto": b} for a, b in open_])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, names = [], [*groups, *(k for k, *_ in _STATE)]

        def rows() -> Iterator[tuple]:
            for batch in frames:
                fields[:] = [*B.key_fields(batch, groups), *(pa.field(k, t) for k, t, _ in _FOUND)]
                for i in range(batch.num_rows):
                    yield tuple(batch.column(k)[i] for k in names)

        out, g = [], len(groups)
        for key, parts in itertools.groupby(rows(), key=lambda r: tuple(x.as_py() for x in r[: g + 1])):
            state = _State()
            for part in parts:
                *numbers, values, weights, error = part[g + 1:]
                counts, (n, *moments) = [x.as_py() for x in numbers[:3]], [x.as_py() for x in numbers[3:]]
                state.add(counts, n, *moments)
                state.tower.add(Summary(values.values.to_numpy(), weights.values.to_numpy(), error.as_py()))
            out.append(finished(key[:-1], key[-1], state))
            if len(out) >= B.HELD:
                yield B.record_batch(out, fields)
                out = []
        if out:
            yield B.record_batch(out, fields)
    return run


def _same(names: list[str], prefix: str) -> Column:
    """Equality of the named columns with those numbered behind a prefix; nulls are equal."""
    return functools.reduce(operator.and_, (
        F.col(f"`{k}`").eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(names)))


def _inside(df: DataFrame, groups: list[str], columns: list[str], found: DataFrame) -> DataFrame:
    """(groups, _column, rank, value) of all ranks that lie in open brackets, from the rows inside.

    The brackets go to the rows, as a column or group may own any share of them: what is shuffled are
    counts of the distinct values inside, not the cells of a column.
    """
    keys = [*groups, "_column"]
    cells = df.unpivot([F.col(f"`{g}`") for g in groups], [F.col(f"`{c}`") for c in columns], "_column", "_value")
    wanted = small(found.filter(F.size("open") > 0).select(
        *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], "open",
        F.array_distinct(F.concat("ranks.low_rank", "ranks.high_rank")).alias("wanted")))
    v = F.nanvl("_value", F.lit(None).cast("double"))
    passed = F.size(F.filter("open", lambda b: b["upto"] < F.col("_value")))
    bracket = F.get("open", passed)
    here = bracket.isNotNull() & (bracket["above"].isNull() | (bracket["above"] < F.col("_value")))
    counted = (
        cells.withColumn("_value", v).filter("_value is not null").join(wanted, _same(keys, "_k"))
        .withColumns({"cell": passed * 2 + here.cast("int"),
                      "kept": F.when(here, F.col("_value"))})
        .groupBy(*[F.col(f"`{k}`") for k in keys], "wanted", "cell", "kept").agg(F.count("*").alias("c")))
    so_far = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy("cell", "kept").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("c").over(so_far)
    return counted.withColumn("upto", upto).select(
        *[F.col(f"`{k}`") for k in keys], "kept", F.explode(F.filter(
            "wanted", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("c")))).alias("rank"))


def described(df: DataFrame, groups: list[str], columns: list[str], probabilities: list[float],
              stored: bool = False) -> tuple[DataFrame, list[str], DataFrame | None]:
    """The frame of `describe`, the columns with open brackets, and their rows.

    These rows are stored before they are read again, unless df comes from storage itself.
    """
    rows = df.select(*groups, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    head = B.key_schema(df, groups)
    names = [*groups, "_column"]
    keys = [F.col(f"`{k}`") for k in names]
    parts = rows.mapInArrow(_fold(groups, columns), head + ", ".join(f"{k} {s}" for k, _, s in _STATE))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(parts.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(
        _settle(groups, probabilities), head + ", ".join(f"{k} {s}" for k, _, s in _FOUND)))
    # at most one name per column of df
    unsettled = found.filter(F.size("open") > 0).select("_column")
    open_ = sorted(r[0] for r in (unsettled.distinct() if groups else unsettled).collect())
    again = None
    if not open_:
        whole = found.withColumn("_known", F.lit(None).cast("map<bigint,double>"))
    else:
        again = rows.select(*groups, *[F.col(f"`{c}`") for c in open_])
        again = again if stored else cut(again)
        settled = _inside(again, groups, open_, found).groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("rank", "kept"))).alias("_known"))
        settled = settled.withColumnsRenamed({k: f"_s{i}" for i, k in enumerate(names)})
        whole = found.join(settled, _same(names, "_s"), "left")

    def value(r, side: str):
        return F.coalesce(r[side], F.try_element_at("_known", r[f"{side}_rank"]))

    def between(r):
        low, high = value(r, "low"), value(r, "high")
        return F.when(low == high, low).otherwise(low + (high - low) * r["fraction"])

    q = F.when(F.col("n") > 0, F.transform("ranks", between))
    return whole.select(*keys, *STATISTICS, q.alias("q")), open_, again


def describe(df: DataFrame, groups: list[str], columns: list[str],
             probabilities: list[float], stored: bool = False) -> DataFrame:
    """(groups, _column, STATISTICS, q) for every group and numeric column, NaN counting as null.

    q: linearly interpolated quantiles, exact; null without known values. n_distinct, n_unique and mad
    (median absolute deviation) are null where a column has more than POINTS distinct values in a
    group. df is read once, and once more in its columns with open brackets.
    """
    return described(df, groups, columns, probabilities, stored)[0]


def quantiles(df: DataFrame, groups: list[str], value: str, probabilities: list[float],
              stored: bool = False) -> DataFrame:
    """(groups, q): linearly interpolated quantiles of the known values of each group, exact."""
    return describe(df, groups, [value], probabilities, stored).filter("n > 0").select(
        *[F.col(f"`{g}`") for g in groups], "q")
