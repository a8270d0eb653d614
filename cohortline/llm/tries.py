"""Prefix trie of conversations: union-find over sorted-neighbour LCP edges, partition by partition.

1. A conversation is one row: its turns in order, each as 24 bytes (128 bits of the turn's hash, 64 bits
   for the size of its text). Bytes sort as the turns do, so Spark range-sorts the rows.
2. Within a range partition every two sorted neighbours are an edge, weighted by their common turns.
   Edges are taken in descending depth and joined by union-find: every merge of two components is a
   node, branching there or ending a conversation; between merges the trie runs on without branching.
3. Only nodes that hold a partition's first or last row can reach beyond it. They are sent on,
   contracted to sums per depth; all other nodes are final where they were found.
4. The contracted forests are merged in order across the boundaries, one row per partition, with a
   stack no deeper than the longest conversation. Nodes below learn their parent's name by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: Bytes of a turn in a path: hash and size.
STEP = 24
#: Bytes of paths that a range partition holds, about.
PART_BYTES = 16_000_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
_OPEN = pa.list_(pa.struct([("n", pa.int64()), ("low", pa.int64()), ("children", pa.int64()),
                            ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())]))
_OPEN_SQL = "array<struct<n:bigint,low:bigint,children:bigint,leaves:bigint,saved:bigint,ends:string>>"
_FOUND = [("conv_id", pa.int64(), "bigint"), ("depth", pa.int64(), "bigint"),
          ("parent_conv_id", pa.int64(), "bigint"), ("n_convs", pa.int64(), "bigint"),
          ("n_children", pa.int64(), "bigint"), ("n_leaves", pa.int64(), "bigint"),
          ("saved_tokens", pa.int64(), "bigint"), ("ends_sha256", pa.string(), "string")]
# where an open node lies: the partition, 0 if it holds the partition's first row, else 1
_PLACE = [("part", pa.int64(), "bigint"), ("side", pa.int64(), "bigint")]
_UP = [("up_part", pa.int64(), "bigint"), ("up_side", pa.int64(), "bigint")]
_ENDS = [("first", pa.binary(), "binary"), ("last", pa.binary(), "binary"),
         ("shared", pa.int64(), "bigint"), ("left", _OPEN, _OPEN_SQL), ("right", _OPEN, _OPEN_SQL)]
RESULT = [name for name, *_ in _FOUND]


def _schema(fields: list[tuple]) -> str:
    return ", ".join(f"{name} {sql}" for name, _, sql in fields)


def _batch(fields: list[tuple], values: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values[name], kind) if name in values else pa.nulls(n, kind) for name, kind, _ in fields],
        names=[name for name, *_ in fields])


def common_turns(data: np.ndarray, begin: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Turns that each path shares with the one before it; data: three numbers a turn, path after path."""
    out = np.zeros(len(turns), np.int64)
    most = np.minimum(turns[1:], turns[:-1])
    step = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most)
    same = (data[np.repeat(begin[1:], most) + step] == data[np.repeat(begin[:-1], most) + step]).all(axis=1)
    agreed = np.where(same, np.repeat(most, most), step)
    some = most > 0
    if some.any():
        out[1:][some] = np.minimum.reduceat(agreed, (np.cumsum(most) - most)[some])
    return out


class Forest:
    """Nodes of the trie of sorted paths: branching ones, and those at which a path ends.

    Arrays per node: depth, count (paths below), low (least id of them), first (index of the first of
    them), ends (paths that end there, from `first` on), parent.
    """

    def __init__(self, common: np.ndarray, turns: np.ndarray, ids: np.ndarray):
        n = len(turns)
        self.depth, self.low, self.first = turns.tolist(), ids.tolist(), list(range(n))
        self.count, self.ends, self.parent, self.same = [1] * n, [1] * n, [-1] * n, [-1] * n
        member, top = list(range(n)), list(range(n))  # union-find over paths; node of each root
        for i in (np.argsort(-common[1:], kind="stable") + 1).tolist():
            d, a, b = int(common[i]), self._root(member, i - 1), self._root(member, i)
            left, right = top[a], top[b]
            if self.depth[left] == d and self.depth[right] == d:
                node, other = left, right
                self.same[right] = left
                self.ends[left] += self.ends[right]
            elif self.depth[left] == d:
                node, other = left, right
                self.parent[right] = left
            elif self.depth[right] == d:
                node, other = right, left
                self.parent[left] = right
            else:
                node, other = len(self.depth), left
                for values, x in ((self.depth, d), (self.low, self.low[right]), (self.first, self.first[left]),
                                  (self.count, self.count[right]), (self.ends, 0), (self.parent, -1),
                                  (self.same, -1)):
                    values.append(x)
                self.parent[left] = self.parent[right] = node
            self.count[node] += self.count[other]
            self.low[node] = min(self.low[node], self.low[other])
            self.first[node] = min(self.first[node], self.first[other])
            # the smaller component joins the larger
            a, b = (a, b) if self.count[left] >= self.count[right] else (b, a)
            member[b] = a
            top[a] = node

    @staticmethod
    def _root(member: list[int], i: int) -> int:
        while member[i] != i:
            member[i] = member[member[i]]
            i = member[i]
        return i

    def node_of(self, i: int) -> int:
        while i >= 0 and self.same[i] >= 0:
            i = self.same[i]
        return i

    def spine(self, i: int) -> list[int]:
        """Nodes from the top down to the one at which path i ends."""
        out, at = [], self.node_of(i)
        while at >= 0:
            out.append(at)
            at = self.node_of(self.parent[at])
        return out[::-1]


def _ids(ids: np.ndarray, begin: int, n: int) -> str:
    return ",".join(map(str, ids[begin: begin + n].tolist()))


def _forest_rows(part: int, paths: list[bytes], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Final nodes of a partition, then one row with its open ones."""
    fields = _FOUND + _PLACE + _UP + _ENDS
    turns = np.array([len(p) // STEP for p in paths])
    data = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 3)
    begin = np.cumsum(turns) - turns
    sums = np.append(0, np.cumsum(data[:, 2].astype(np.int64)))  # text bytes before each turn
    forest = Forest(common_turns(data, begin, turns), turns, ids)
    nodes = [v for v in range(len(forest.depth)) if forest.same[v] < 0]
    above = {v: forest.node_of(forest.parent[v]) for v in nodes}
    left, right = forest.spine(0), forest.spine(len(paths) - 1)
    side = {v: 1 for v in right} | {v: 0 for v in left}
    children, leaves, saved = ({v: 0 for v in nodes} for _ in range(3))
    top = {v: forest.depth[u] if u >= 0 else -1 for v, u in above.items()}

    def bytes_of(v: int, above_depth: int) -> int:
        """Text bytes of v's turns below that depth."""
        at = begin[forest.first[v]]
        return int(sums[at + forest.depth[v]] - sums[at + above_depth])

    rows: dict[str, list] = {name: [] for name in (*RESULT, "up_part", "up_side")}
    for v in sorted(nodes, key=lambda v: -forest.depth[v]):
        u, n, low, deep = above[v], forest.count[v], forest.low[v], forest.depth[v]
        if v in side:
            continue  # what lies beyond the boundary is not known yet
        leaves[v] = leaves[v] or 1
        own = range(top[v] + 1, deep + 1)
        rows["conv_id"] += [low] * len(own)
        rows["depth"] += own
        rows["parent_conv_id"] += [None if u in side else forest.low[u]] + [low] * (len(own) - 1)
        rows["up_part"] += [part if u in side else None] + [None] * (len(own) - 1)
        rows["up_side"] += [side.get(u)] + [None] * (len(own) - 1)
        rows["n_convs"] += [n] * len(own)
        rows["n_children"] += [1] * (len(own) - 1) + [children[v]]
        rows["n_leaves"] += [leaves[v]] * len(own)
        rows["saved_tokens"] += [saved[v] + (n - 1) * bytes_of(v, d - 1) for d in own]
        ends = _ids(ids, forest.first[v], forest.ends[v])
        rows["ends_sha256"] += [NO_ENDS] * (len(own) - 1) + [hashlib.sha256(ends.encode()).hexdigest()]
        children[u] += 1
        leaves[u] += leaves[v]
        saved[u] += saved[v] + (n - 1) * bytes_of(v, top[v])
    size = len(rows["conv_id"])
    for at in range(0, size, 50_000):
        some = {name: x[at: at + 50_000] for name, x in rows.items()}
        yield _batch(fields, some, len(some["conv_id"]))

    def spread(spine: list[int]) -> list[dict]:
        """One entry per depth: what the partition adds to the node there."""
        out = []
        for v in spine:
            for d in range(top[v] + 1, forest.depth[v] + 1):
                own = d == forest.depth[v]
                out.append({"n": forest.count[v], "low": forest.low[v], "children": own * children[v],
                            "leaves": own * leaves[v], "saved": own * saved[v],
                            "ends": _ids(ids, forest.first[v], forest.ends[v]) if own else ""})
        return out

    both = [v for v in right if side[v] == 0]
    yield _batch(fields, {
        "part": [part], "first": [paths[0]], "last": [paths[-1]],
        "shared": [forest.depth[both[-1]]], "left": [spread(left)],
        "right": [spread([v for v in right if side[v] == 1])]}, 1)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, ids = [], [np.zeros(0, np.int64)]
    for batch in batches:
        paths += batch.column("path").to_pylist()
        ids.append(batch.column("conv_id").to_numpy())
    if paths:
        yield from _forest_rows(TaskContext.get().partitionId(), paths, np.concatenate(ids))


class _Open:
    """A node that further partitions may add to."""

    def __init__(self, part: int, side: int, depth: int, size: int):
        self.part, self.side, self.depth, self.size = part, side, depth, size
        self.n = self.children = self.leaves = self.saved = 0
        self.low, self.ends, self.any = None, hashlib.sha256(), False

    def add(self, more: dict) -> None:
        self.n += more["n"]
        self.low = more["low"] if self.low is None else min(self.low, more["low"])
        self.children += more["children"]
        self.leaves += more["leaves"]
        self.saved += more["saved"]
        if more["ends"]:
            self.ends.update(("," if self.any else "").encode() + more["ends"].encode())
            self.any = True


_MERGED = _FOUND[:2] + _FOUND[3:] + _PLACE + _UP


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that were open at a boundary, and other names (up_part, up_side; n_convs null) of them.

    Rows come in order of the partitions. The stack holds the nodes above the last path seen.
    """
    stack: list[_Open] = []
    last, out = b"", {name: [] for name, *_ in _MERGED}

    def close(depth: int) -> None:
        while len(stack) > depth + 1:
            x = stack.pop()
            x.leaves = x.leaves if x.children else 1
            x.saved += (x.n - 1) * x.size
            up = stack[-1] if stack else None
            if up:
                up.leaves += x.leaves
                up.saved += x.saved
            put(x.low, x.depth, x.n, x.children, x.leaves, x.saved, x.ends.hexdigest(), x.part, x.side,
                up and up.part, up and up.side)

    def put(*values) -> None:
        for name, x in zip(out, values):
            out[name].append(x)

    def push(part: int, side: int, more: dict, path: bytes) -> None:
        depth = len(stack)
        if stack:
            stack[-1].children += 1
        size = int.from_bytes(path[depth * STEP - 8: depth * STEP], "big") if depth else 0
        stack.append(_Open(part, side, depth, size))
        stack[-1].add(more)

    def sent() -> pa.RecordBatch:
        batch = _batch(_MERGED, out, len(out["depth"]))
        for x in out.values():
            x.clear()
        return batch

    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            path, part = row["first"], row["part"]
            if stack:
                ends = (last, path)
                whole = np.frombuffer(b"".join(ends), ">u8").reshape(-1, 3)
                turns = np.array([len(p) // STEP for p in ends])
                close(int(common_turns(whole, np.array([0, turns[0]]), turns)[1]))
            for d, more in enumerate(row["left"]):
                if d < len(stack):
                    stack[d].add(more)
                    put(None, d, None, None, None, None, None, part, 0, stack[d].part, stack[d].side)
                else:
                    push(part, 0, more, path)
            close(row["shared"])
            for more in row["right"]:
                push(part, 1, more, row["last"])
            last = row["last"]
            if len(out["depth"]) > 50_000:
                yield sent()
    close(-1)
    yield sent()


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): turns in order, each as 48 hex digits for hash and size.

    Null turn numbers come first; turns of one number go by role and text. Null roles and texts are
    empty. Rows without an id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    size = F.octet_length(text)
    name = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("at"),
        F.md5(F.concat_ws(":", F.length(role), role, text)).alias("tie"),
        F.concat(F.substring(name, 1, 32), F.lpad(F.hex(size), 16, "0")).alias("step"))
    return turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "tie", "step")))["step"].alias("turns"))


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, turns) of conversations that open like the first of their group of ids.

    The first h turns are those of conversation c - c % group (all if it has fewer, none without it),
    the others c's own after its first h; h is the unsigned crc32 of the decimal id, modulo heads.
    """
    head = turns.select(F.col("conv_id").alias("base"),
                        F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = turns.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": h})
    none = F.array().cast("array<string>")
    return own.join(head, "base", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), F.col("h")),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def prefix_trie(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Nodes of the trie over (conv_id, turns) as `sequences` gives them, one row per node.

    A node is a distinct sequence of the first d turns of some conversation, d from 0. Returns
    conv_id (least member), depth, parent_conv_id (parent's conv_id; root: null), n_convs (members),
    n_children, n_leaves (childless nodes below or at it), saved_tokens (over the nodes below or at
    it, members beyond the first times the UTF-8 bytes of the node's last text) and ends_sha256 (of
    the ascending, comma-joined ids of members that end there). A node's last turn is turn `depth` of
    conversation conv_id.

    ids are unique. A conversation without turns is a member of the root. Equal conversations end at
    one node. Without any conversation there is no node: an empty frame. A conversation is one row
    of 24 bytes a turn, so memory follows the longest conversation and part_bytes; equal or alike
    conversations spread over partitions.
    """
    paths = stored(turns.select("conv_id", F.unhex(F.array_join("turns", "")).alias("path")), "paths")
    size = paths.agg(F.sum(F.octet_length("path") + 16)).first()[0] or 0
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    found = stored(
        paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
        .mapInArrow(_forests, _schema(_FOUND + _PLACE + _UP + _ENDS)), "forests")
    merged = stored(
        found.filter("first is not null").select("part", *(name for name, *_ in _ENDS))
        .repartition(1).sortWithinPartitions("part").mapInArrow(_merge, _schema(_MERGED)), "merged")
    opened = merged.filter("n_convs is not null")
    place = [F.col("part").alias("up_part"), F.col("side").alias("up_side"), F.col("depth").alias("up_depth")]
    name = opened.select(*place, F.col("conv_id").alias("named"))
    other = merged.filter("n_convs is null").select(
        *place, F.struct("up_part", "up_side", "depth").alias("is"))
    other = other.join(opened.select(F.struct("part", "side", "depth").alias("is"),
                                     F.col("conv_id").alias("named")), "is").drop("is")
    names = name.unionByName(other)
    closed = found.filter("first is null")
    waiting = closed.filter("up_part is not null").drop("parent_conv_id", *(k for k, *_ in _PLACE + _ENDS))
    waiting = waiting.unionByName(opened.filter("depth > 0").drop("part", "side")).withColumn(
        "up_depth", F.col("depth") - 1)
    settled = waiting.join(names, ["up_part", "up_side", "up_depth"]).withColumnRenamed(
        "named", "parent_conv_id")
    root = opened.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return (closed.filter("up_part is null").select(*RESULT).unionByName(settled.select(*RESULT))
            .unionByName(root.select(*RESULT)))


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of whole conversations: nodes as `prefix_trie` gives them, turns as `sequences`.

    Other columns are not read.
    """
    return prefix_trie(sequences(conversations, id_col, turn_col, role_col, text_col))


def query(conversations: DataFrame) -> DataFrame:
    return prefix_trie(rebuilt(sequences(conversations)))
