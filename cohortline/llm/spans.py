"""Spans of pattern matches as columns: start, end (code points, end exclusive) and matched text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,value:string,before:string>"
# matches whose lengths are summed at a time: places come from sums of blocks and sums within a block
BLOCK = 64


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def with_matches(frame: DataFrame, text: str, patterns: dict[str, str],
                 groups: dict[str, int] | None = None, context: int = 0) -> DataFrame:
    """Add one array column of spans per kind: leftmost matches that do not overlap.

    A text is cut at its matches; the lengths of the pieces and of the matches give the places. It is
    cut only where something matched. value is the given group of the match (0: all of it), before
    the last `context` code points between the previous match of the kind and this one. The work
    grows with the matches of a text, not with their square.
    """
    groups = groups or {}
    for kind, pattern in patterns.items():
        frame = frame.withColumn(f"_{kind}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    for kind, pattern in patterns.items():
        group = groups.get(kind, 0)
        found, rows, sizes, sums = (F.col(f"_{x}{kind}") for x in ("", "rows_", "sizes_", "sums_"))
        values = found if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        some = F.size(found) > 0
        last = F.floor((F.size(found) - 1) / BLOCK).cast("int")
        frame = (
            frame.withColumn(f"_rows_{kind}", F.when(some, F.arrays_zip(
                gaps.alias("g"), found.alias("m"), values.alias("v"))))
            .withColumn(f"_sizes_{kind}", F.transform(rows, lambda x: F.length(x["g"]) + F.length(x["m"])))
            .withColumn(f"_sums_{kind}", F.when(some, F.transform(
                F.sequence(F.lit(0), last), lambda b: _sum(F.slice(sizes, b * BLOCK + 1, BLOCK)))))
            .withColumn(f"_sums_{kind}", F.when(some, F.transform(
                F.sequence(F.lit(0), last), lambda b: _sum(F.slice(sums, 1, b))))))

        def span(x: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = (F.get(sums, block) + _sum(F.slice(sizes, block * BLOCK + 1, i % BLOCK))
                     + F.length(x["g"]))
            return F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"),
                x["v"].alias("value"),
                (F.right(x["g"], F.lit(context)) if context else F.lit("")).alias("before"))

        frame = frame.withColumn(kind, F.coalesce(
            F.transform(rows, span), F.array().cast(f"array<{SPAN}>")))
    return frame.drop(*(f"_{x}{kind}" for kind in patterns for x in ("", "rows_", "sizes_", "sums_")))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def bare(spans: Column) -> Column:
    """Spans without their context."""
    return F.transform(spans, lambda s: s.dropFields("before"))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Spans in order of start, then of their kind's place in the list."""
    order = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("a"), order[s["kind"]].alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def by_kind(spans: Column, kinds: list[str]) -> Column:
    """Spans in order of their kind's place in the list, then of start."""
    return reduce(lambda a, b: F.concat(a, b), (
        F.array_sort(of_kind(spans, k), lambda x, y: x["start"] - y["start"])
        for k in kinds))
