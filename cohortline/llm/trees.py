"""Trees of fitted forests as Spark columns and as rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.Ee]+)\)$")
_LEAF = re.compile(r"^( *)Predict: ([-+0-9.Ee]+)$")


@dataclass(frozen=True)
class Test:
    feature: int
    above: bool
    at: float

    def column(self, names: list[str]) -> Column:
        value = F.col(names[self.feature])
        return value > self.at if self.above else value <= self.at


def paths(model) -> list[tuple[float, list[tuple[tuple[Test, ...], float]]]]:
    """(weight, [(tests down to a leaf, its prediction)]) of every tree of a fitted ensemble."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        leaves, stack = [], []
        for line in tree.toDebugString.split("\n"):
            if m := _LINE.match(line):
                depth = len(m[1])
                stack = [(d, t) for d, t in stack if d < depth]
                stack.append((depth, Test(int(m[2]), m[3] == ">", float(m[4]))))
            elif m := _LEAF.match(line):
                depth = len(m[1])
                leaves.append((tuple(t for d, t in stack if d < depth), float(m[2])))
        out.append((float(weight), leaves))
    return out


def ensemble_sum(model, names: list[str]) -> Column:
    """Weighted sum of the trees' predictions, one flat conditional per tree."""
    total = F.lit(0.0)
    for weight, leaves in paths(model):
        value = None
        for tests, prediction in leaves:
            if not tests:
                value = F.lit(prediction)
                break
            met = tests[0].column(names)
            for t in tests[1:]:
                met = met & t.column(names)
            value = F.when(met, prediction) if value is None else value.when(met, prediction)
        total = total + weight * value
    return total


def conjunctions(model) -> list[tuple[Test, ...]]:
    """Every path from a root to a node below it, each once, in a fixed order."""
    found = {}
    for _, leaves in paths(model):
        for tests, _ in leaves:
            for k in range(1, len(tests) + 1):
                found.setdefault(tuple(tests[:k]), None)
    return list(found)
