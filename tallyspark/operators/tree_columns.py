"""Fitted MLlib tree ensembles as column expressions.

A tree is laid out as a complete binary heap: three arrays over all trees
hold each inner node's feature and threshold and each leaf's value (a leaf
above the last level fills the leaves below it).  Going down is arithmetic on
the heap index, so an ensemble is one nested ``aggregate`` over its trees and
levels that Spark evaluates in the JVM, inside another expression if need be
(the horizon of a recursive forecast), without a model stage or a Python
worker.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE = re.compile(r"^(\s*)(If|Else|Predict:)\s*(?:\(feature (\d+) (<=|>) ([^)]+)\)|([-+.\dEeINaify]+))?$")


class TreeColumns(NamedTuple):
    """Heaps of ``trees`` trees of ``depth`` levels; leaf values are weighted."""
    trees: int
    depth: int
    features: list[int]
    thresholds: list[float]
    leaves: list[float]

    def predict(self, x: Column) -> Column:
        """The ensemble's prediction for an array of features (a missing one
        is NaN or null and goes right, as in the library)."""
        inner, outer = (1 << self.depth) - 1, 1 << self.depth
        feature = _constant(self.features, "array<int>")
        threshold = _constant(self.thresholds, "array<double>")
        leaf = _constant(self.leaves, "array<double>")
        levels = F.sequence(F.lit(1), F.lit(self.depth)) if self.depth else F.array().cast("array<int>")
        values = F.transform(x, lambda v: F.coalesce(v, F.lit(float("nan"))))

        def down(values: Column, tree: Column) -> Column:
            def step(node: Column, _: Column) -> Column:
                at = tree * inner + node
                left = F.get(values, F.get(feature, at)) <= F.get(threshold, at)
                return node * 2 + F.when(left, 1).otherwise(2)
            end = F.aggregate(levels, F.lit(0), step)
            return F.get(leaf, tree * outer + end - inner)

        def total(values: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), F.lit(self.trees - 1)), F.lit(0.0), lambda s, tree: s + down(values, tree))

        # a lambda's variable, so that the features are computed once, not at every split
        return F.get(F.transform(F.array(values), total), 0)


def _constant(values: list, kind: str) -> Column:
    """A literal array, folded once by the optimizer."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(kind)


def _parse(text: str) -> list:
    """A debug string's trees as nested (feature, threshold, left, right) or
    leaf values."""
    trees: list = []
    path: list = []

    def close(node):
        while path:
            top = path[-1]
            top.append(node)
            if len(top) < 4:
                return
            node = tuple(path.pop())
        trees.append(node)

    for line in text.splitlines():
        m = _LINE.match(line)
        if not m:
            continue
        _, kind, feature, op, threshold, value = m.groups()
        if kind == "If":
            if op != "<=":
                raise ValueError(f"only numeric splits are supported: {line.strip()}")
            path.append([int(feature), float(threshold)])
        elif kind == "Predict:":
            close(float(value))
    return trees


def tree_columns(model) -> TreeColumns:
    """The column form of a fitted GBT, random forest or tree regressor (or
    of a pipeline that ends with one)."""
    model = model.stages[-1] if hasattr(model, "stages") else model
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    trees = _parse(model.toDebugString)
    if len(trees) != len(weights):
        raise ValueError(f"{len(trees)} trees read, {len(weights)} in the model")
    if type(model).__name__.startswith("RandomForest"):
        weights = [w / sum(weights) for w in weights]

    def height(node) -> int:
        return 1 + max(height(node[2]), height(node[3])) if isinstance(node, tuple) else 0

    depth = max(map(height, trees))
    inner, outer = (1 << depth) - 1, 1 << depth
    features, thresholds, leaves = [0] * (inner * len(trees)), [0.0] * (inner * len(trees)), [0.0] * (outer * len(trees))
    for k, (tree, weight) in enumerate(zip(trees, weights)):
        todo = [(tree, 0)]
        while todo:
            node, at = todo.pop()
            if at >= inner:
                leaves[k * outer + at - inner] = node * weight
            elif isinstance(node, tuple):
                features[k * inner + at], thresholds[k * inner + at] = node[0], node[1]
                todo += [(node[2], 2 * at + 1), (node[3], 2 * at + 2)]
            else:  # a leaf above the last level: either way leads to its value
                todo += [(node, 2 * at + 1), (node, 2 * at + 2)]
    return TreeColumns(len(trees), depth, features, thresholds, leaves)
