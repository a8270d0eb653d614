"""Conversation tries beside plain dictionaries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortline.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def own_turns(rows):
    """Turns of every conversation in order; ties go by the operator's own key."""
    def tie(role, text):
        return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            pair = (role or "", text or "")
            own[c].append(((turn is not None, turn or 0, tie(*pair)), pair))
    return {c: [pair for _, pair in sorted(found)] for c, found in own.items()}


def rebuilt(own):
    return {c: own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + v[zlib.crc32(str(c).encode()) % 9:]
            for c, v in own.items()}


def nodes(sequences):
    members, children = defaultdict(list), Counter()
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += not children[path]
        saved[path] += (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        if path:
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items())


def found(frame):
    return Counter(tuple(r) for r in frame.select(tries.RESULT).collect())


def conversations(seed, n, turns=6, kinds=4):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, turns)):
            rows.append((c, t, rng.choice(["user", "assistant"]), "é" * rng.randrange(kinds)))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def talk():
    rows = conversations(1, 120) + conversations(2, 40, turns=30, kinds=2)
    rows += [(500 + c, t, "user", f"same {t}") for c in range(60) for t in range(4)]  # copies
    rows += [(700, t, None, None) for t in range(300)]  # long, all turns alike
    rows += [(701, None, "system", "first"), (701, 0, "user", None), (701, 0, None, "x"), (701, 0, None, "x")]
    rows += [(None, 0, "user", "of none"), (2**40 + 1, 5, "user", "alone"), (-7, 0, "user", "below")]
    return rows


@pytest.mark.parametrize("part_bytes", [tries.PART_BYTES, 2_000])
def test_nodes(spark, talk, part_bytes):
    frame = spark.createDataFrame(talk, SCHEMA).withColumn("side", F.lit(1)).withColumn("path", F.lit("?"))
    turns = tries.sequences(frame.repartition(5))
    assert found(tries.prefix_trie(turns, part_bytes)) == nodes(own_turns(talk))


def test_rebuilt(spark, talk):
    rows = [r for r in talk if r[0] is None or r[0] >= 0]
    want = rebuilt(own_turns(rows))
    assert any(not s for s in want.values())  # some conversation is left without turns
    assert found(tries.query(spark.createDataFrame(rows, SCHEMA))) == nodes(want)


def test_given_table(spark, folder):
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    want = nodes(rebuilt(own_turns([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])))
    assert found(tries.query(table)) == want


def test_little_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tries.query(empty).collect() == []
    assert tries.query(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    # one conversation of another group's id, whose first turns are not there
    lone = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)
    assert zlib.crc32(b"1") % 9 >= 1
    assert found(tries.query(lone)) == nodes({1: []})


def test_union_find_makes_one_node_per_branching(spark):
    import numpy as np

    turns = np.array([2, 3, 3, 3, 1])
    common = np.array([0, 2, 2, 0, 0])
    forest = tries.Forest(common, turns, np.array([9, 4, 5, 1, 2]))
    top = forest.node_of(0)
    assert (forest.depth[top], forest.count[top], forest.low[top], forest.ends[top]) == (2, 3, 4, 1)
    root = forest.spine(4)[0]
    assert (forest.depth[root], forest.count[root], forest.low[root]) == (0, 5, 1)
    assert [forest.node_of(forest.parent[v]) for v in (top, forest.node_of(3))] == [root, root]
