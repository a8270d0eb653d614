import random

import pytest
from pyspark.sql import functions as F

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mé", "Ti") for b in ("ra", "ne", "so") for c in ("", "x", "ns")]
# names that the operators use inside
CLASH = ["did", "th", "uid", "start", "count", "anchor", "spans", "kept", "score", "n", "row", "label",
         "hs", "base", "_text", "_id"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(20, 160)) for _ in range(40)]
    passage, base = prose(rng, 70), prose(rng, 90).split(" ")
    for i in (3, 9, 17):
        texts[i] += "\n" + passage + "\n" + prose(rng, 12)
    texts += [texts[5]] * 6
    for _ in range(30):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(len(near))] = "edit" + str(rng.randrange(9))
        texts.append(" ".join(near).upper() if rng.random() < 0.2 else " ".join(near))
    texts += [None, "", " \t\n", "one", "one", "two words", "a" * 3_000, "ab " * 900,
              "1 " * 3_000, prose(rng, 4_000), "x@" * 2_000, "mixed\x0bspace\x1ftext here"]
    rows = list(enumerate(texts))
    return rows + [(None, texts[5]), (None, "only here once"), (7, texts[7]), (7, texts[7]), (8, texts[2])]


def frame(spark, rows, clash=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:
        docs = docs.select("*", *(F.lit("?").alias(name) for name in CLASH))
    return docs.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 5)).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return frame(spark, corpus)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
