"""A tree of group profiles beside a fixed tree: turned towards it, compared with it, for one choice of method or all.

Profiles are group means over a hierarchy, one nested aggregation in Spark; what is left is a row
per group, and trees of so many leaves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregates, trees

METRICS = ("correlation", "euclidean", "cosine")


def profiles(df: DataFrame, features: Sequence[str], hierarchy: Sequence[str], group: str) -> tuple[list[str], np.ndarray]:
    """Groups in order, and their means when every unit of each level of the hierarchy counts alike below its parent."""
    got = aggregates.nested(df, list(features), list(hierarchy), [group]).orderBy(group).toPandas()  # a row per group
    return [str(g) for g in got[group]], got[list(features)].to_numpy(dtype=float)


def standardized(m: np.ndarray) -> np.ndarray:
    """Columns less their mean, over their population SD; constant ones are zero."""
    spread = m.std(axis=0)
    return (m - m.mean(axis=0)) / np.where(spread == 0, 1, spread)


def crossings_between(a: Sequence[int], b: Sequence[int]) -> int:
    """Pairs (x of a, y of b) with x > y: how often lines cross if a is drawn before b."""
    return int(np.searchsorted(np.sort(b), np.asarray(a), side="left").sum())


def rotated(tree: Sequence[tuple], places: Sequence[int]) -> list[int]:
    """Leaf order of the tree with the fewest crossings against a fixed order; places[i] is where leaf i stands in that.

    Whether two leaves cross depends on how the node that parts them is turned, and on nothing
    else; so each node is turned by its own count, from the leaves up. Ties keep the tree's turn.
    """
    n = len(tree) + 1
    of: dict[int, list[int]] = {i: [i] for i in range(n)}
    for at, (a, b, *_) in enumerate(tree):
        left, right = of.pop(a), of.pop(b)
        as_is, turned = (crossings_between([places[i] for i in x], [places[i] for i in y]) for x, y in ((left, right), (right, left)))
        of[n + at] = right + left if turned < as_is else left + right
    return of[n + len(tree) - 1] if tree else [0] * bool(len(places))


def agreement(left: Sequence, right: Sequence) -> dict[str, float]:
    """Crossings of two orders of the same leaves, the most there can be, and Kendall's tau (NaN below two leaves)."""
    n, crossed = len(left), trees.crossings(left, right)
    most = n * (n - 1) // 2
    return {"crossings": crossed, "most": most, "tau": 1 - 2 * crossed / most if most else float("nan")}


@dataclass(frozen=True)
class Tanglegram:
    """Two trees over the same labels, the orders their leaves are drawn in, and how well they agree."""

    labels: tuple[str, ...]
    fixed: list[tuple]
    tree: list[tuple]
    fixed_order: tuple[str, ...]
    tree_order: tuple[str, ...]
    gamma: float
    p: float
    crossings: int
    crossings_as_built: int
    shared_clades: tuple[tuple[str, ...], ...]

    @property
    def tau(self) -> float:
        return agreement(self.fixed_order, self.tree_order)["tau"]


def tanglegram(labels: Sequence[str], m: np.ndarray, fixed: Sequence[tuple], method: str = "average", metric: str = "correlation", scaled: bool = True) -> Tanglegram:
    """The tree of profiles m, rows in order of labels, turned towards `fixed`, a linkage of the same leaves."""
    if len(labels) != len(m) or len(fixed) != len(m) - 1:
        raise ValueError("labels, profiles and the fixed tree differ in their leaves")
    n = len(m)
    tree = trees.linkage(trees.distances(standardized(m) if scaled else m, metric), method)
    fixed_order = trees.members(fixed, n)[2 * n - 2] if n > 1 else (0,)
    places = np.empty(n, dtype=int)
    places[list(fixed_order)] = np.arange(n)
    built = trees.members(tree, n)[2 * n - 2] if n > 1 else (0,)
    turned = rotated(tree, places)
    gamma, p = trees.baker_gamma(fixed, tree, n)
    shared = trees.clades(fixed, labels) & trees.clades(tree, labels)
    named = lambda order: tuple(labels[i] for i in order)
    return Tanglegram(
        tuple(labels), list(fixed), list(tree), named(fixed_order), named(turned), gamma, p, trees.crossings(named(fixed_order), named(turned)),
        trees.crossings(named(fixed_order), named(built)), tuple(sorted(tuple(sorted(c)) for c in shared)),
    )


def sensitivity(labels: Sequence[str], m: np.ndarray, fixed: Sequence[tuple], methods: Sequence[str] = trees.METHODS, metrics: Sequence[str] = METRICS) -> list[dict]:
    """A row for each choice of standardisation, method and metric, the largest gamma first: what would have been found with another."""
    out = []
    for scaled in (False, True):
        for method in methods:
            for metric in metrics:
                t = tanglegram(labels, m, fixed, method, metric, scaled)
                out.append({
                    "standardized": scaled, "method": method, "metric": metric, "baker_gamma": t.gamma, "p": t.p, "crossings": t.crossings,
                    "crossings_as_built": t.crossings_as_built, "tau": t.tau, "shared_clades": len(t.shared_clades), "leaf_order": list(t.tree_order),
                })
    return sorted(out, key=lambda r: (r["baker_gamma"] != r["baker_gamma"], -r["baker_gamma"] if r["baker_gamma"] == r["baker_gamma"] else 0.0))


def links(spark, t: Tanglegram) -> DataFrame:
    """Rows (label, fixed_place, tree_place), a line of the drawing each."""
    rows = [(label, i, t.tree_order.index(label)) for i, label in enumerate(t.fixed_order)]
    return spark.createDataFrame(rows, "label string, fixed_place int, tree_place int").orderBy(F.col("fixed_place"))
