"""Mixing beside a plain version with its own integrals."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortline.llm import curriculum

from . import brute
from .conftest import frame

SCHEMA = "doc_id long, source string, text string"


def targets(sizes, weights, share, most):
    """Share a budget by weight; those above their bound stop there, the excess goes round again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * per > most * sizes[s]}
        if not over:
            target |= {s: weight[s] * per for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return order, target


def met_at(schedule, share, steps=20_000):
    """Time at which the integral reaches a share, by summing small steps."""
    def weight(t):
        x = min(t * (len(schedule) - 1), len(schedule) - 1.000001)
        k = int(x)
        return schedule[k] + (schedule[k + 1] - schedule[k]) * (x - k)

    parts = [weight((i + 0.5) / steps) for i in range(steps)]
    want, so_far = share * sum(parts), 0.0
    for i, p in enumerate(parts):
        if so_far + p >= want:
            return (i + (want - so_far) / p) / steps
        so_far += p
    return 1.0


def mixture(rows, weights=(3, 1, 2), share=1.5, most=2, schedules=curriculum.SCHEDULES):
    docs, copies = [], Counter()
    for doc_id, source, text in rows:
        digest = hashlib.md5((text or "").encode()).hexdigest()
        copies[doc_id, source, digest] += 1
        parts = ([] if doc_id is None else [str(doc_id)]) + [digest, str(copies[doc_id, source, digest]), "0"]
        docs.append((hashlib.md5(":".join(parts).encode()).hexdigest()[:15], doc_id, source,
                     len(brute.WORD.findall(text or ""))))
    sizes = defaultdict(int)
    for _, _, source, size in docs:
        sizes[source] += size
    order, target = targets(sizes, weights, share, most)
    out = []
    for k, source in enumerate(order):
        wanted, at = int(target[source] + 0.5), 0
        for _, doc_id, _, size in sorted((d for d in docs if d[2] == source), key=lambda d: d[0]):
            taken, position = 0, None
            for repeat in range(int(most)):
                begin = repeat * sizes[source] + at
                words = max(0, min(size, wanted - begin))
                if words and position is None:
                    position = met_at(schedules[k % len(schedules)], begin / wanted)
                taken += words
            at += size
            out.append((doc_id, size, sizes[source], pytest.approx(target[source]), taken,
                        position if position is None else pytest.approx(position * 1e9, abs=1e5)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[4]))


@pytest.fixture(scope="module")
def shelf(corpus):
    rng = random.Random(8)
    names = ["b"] * 6 + ["a", "é", None, "Z", "", "small"]
    rows = [(i, rng.choice(names), t) for i, t in corpus]
    return rows + [(900, "empty", None), (901, "empty", " \n"), (902, "one", "word")] + [(903, "b", "again x y")] * 4


def test_mix(spark, shelf):
    docs = spark.createDataFrame(shelf, SCHEMA).withColumn("rank", F.lit("?")).withColumn("size", F.lit(-1))
    got = [tuple(r) for r in curriculum.query(docs.repartition(7)).collect()]
    assert ordered(mixture(shelf)) == ordered(got)
    again = [tuple(r) for r in curriculum.query(docs.repartition(2)).collect()]
    assert Counter(got) == Counter(again)
    assert [r[5] is None for r in got] == sorted(r[5] is None for r in got)
    assert [r[5] for r in got if r[5] is not None] == sorted(r[5] for r in got if r[5] is not None)


def test_taken_words_meet_the_targets(spark, folder):
    plan = curriculum.mixed(spark.read.parquet(f"{folder}/documents.parquet"))
    by_source = plan.groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"),
        F.sum("size").alias("size"), F.first("source_size").alias("source_size")).collect()
    assert all(abs(r.taken - r.target) <= 0.5 and r.size == r.source_size for r in by_source)
    assert plan.filter("taken > 2 * size").isEmpty()
    assert sum(r.target for r in by_source) == pytest.approx(1.5 * sum(r.size for r in by_source))


def test_all_sources_full(spark):
    rows = [(i, f"s{i % 3}", "x y z") for i in range(9)]
    plan = curriculum.mixed(spark.createDataFrame(rows, SCHEMA), share=2, most=2).collect()
    assert all(r.taken == 6 and r.target == 18.0 for r in plan)


@pytest.mark.parametrize("schedule", [(1, 1), (0.2, 3.0), (2, 0.5, 1, 4)])
def test_inverse_of_the_integral(spark, schedule):
    shares = [0, 0.1, 0.25, 0.5, 0.77, 0.999]
    got = spark.createDataFrame([(x,) for x in map(float, shares)], "x double").select(
        curriculum.position_of(F.col("x"), schedule).alias("t")).collect()
    assert [r.t for r in got] == [pytest.approx(met_at(schedule, x), abs=1e-4) for x in shares]
    with pytest.raises(ValueError):
        curriculum.position_of(F.lit(0.5), (1.0, 0.0))


def test_training_stream(spark, shelf):
    docs = spark.createDataFrame(shelf, SCHEMA).withColumn("words", F.lit("?"))
    plan = curriculum.mixed(docs)
    rows = curriculum.training_stream(docs, plan).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert sum(r.words for r in rows) == plan.agg(F.sum("taken")).first()[0]
    for r in rows:
        assert 0 < r.words <= len(re.findall(brute.WORD, r.row.text)) and r.row.words == "?"


def test_schedules_shape_the_stream(spark):
    rows = [(i, "abc"[i % 3], f"five words of text {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = curriculum.mixed(docs, weights=(1,), share=1)
    rows = curriculum.training_stream(docs, plan).collect()
    early, late = (Counter(r.row.source for r in rows if at <= r.position < at + 0.25) for at in (0, 0.75))
    # level, rising from a half to one and a half, falling likewise
    assert early["a"] == pytest.approx(75, abs=1) == late["a"]
    assert early["b"] == pytest.approx(47, abs=1) == late["c"] and late["b"] == pytest.approx(103, abs=1) == early["c"]


def test_nothing(spark, nothing):
    assert curriculum.query(nothing).collect() == []
    only_empty = frame(spark, [(1, None), (2, "")])
    assert all(r.taken == 0 and r.target == 0 for r in curriculum.query(only_empty).collect())
