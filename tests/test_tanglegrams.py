"""Turned trees against all turns, and their tables."""

import itertools
import math

import numpy as np
import pytest

from tessera.operators import tanglegrams, trees


def all_orders(tree, n):
    for turns in itertools.product((False, True), repeat=len(tree)):
        of = {i: [i] for i in range(n)}
        for k, ((a, b, *_), turn) in enumerate(zip(tree, turns, strict=True)):
            of[n + k] = of[b] + of[a] if turn else of[a] + of[b]
        yield of[2 * n - 2]


@pytest.mark.parametrize("seed", range(6))
def test_no_turn_has_fewer_crossings(seed):
    rng = np.random.default_rng(seed)
    n = 7
    x = rng.normal(size=(n, 3))
    tree = trees.linkage(trees.distances(x, "euclidean"), "average")
    places = rng.permutation(n)
    target = list(np.argsort(places))
    got = tanglegrams.rotated(tree, places)
    best = min(trees.crossings(order, target) for order in all_orders(tree, n))
    assert trees.crossings(got, target) == best and sorted(got) == list(range(n))
    assert got in list(all_orders(tree, n))


def test_tanglegram_of_a_tree_with_itself():
    x = np.array([[0.0, 1], [0.2, 1.3], [5, 0], [5.5, 0.2], [20, 3]])
    labels = list("abcde")
    fixed = trees.linkage(trees.distances(x, "euclidean"), "average")
    t = tanglegrams.tanglegram(labels, x, fixed, "average", "euclidean", False)
    assert t.crossings == 0 and t.tree_order == t.fixed_order and t.tau == 1.0 and t.gamma == pytest.approx(1) and len(t.shared_clades) == 3
    other = tanglegrams.tanglegram(labels, x[::-1], fixed, "average", "euclidean", False)
    assert other.crossings <= other.crossings_as_built and sorted(other.tree_order) == labels
    with pytest.raises(ValueError):
        tanglegrams.tanglegram(labels[:4], x[:4], fixed)
    assert tanglegrams.agreement("ab", "ba") == {"crossings": 1, "most": 1, "tau": -1.0} and math.isnan(tanglegrams.agreement("a", "a")["tau"])


def test_sensitivity_and_links(spark):
    rng = np.random.default_rng(0)
    rows = [(g, f"{g}{s}", i, float(a), float(b), float(a * b)) for k, g in enumerate("pqrstu") for s in range(2 + k % 2) for i, (a, b) in enumerate(rng.normal((k, k % 3), 0.2, (4 + s, 2)))]
    df = spark.createDataFrame(rows, "g string, s string, i long, u double, v double, w double")
    labels, m = tanglegrams.profiles(df, ["u", "v", "w"], ["s"], "g")
    want = {g: np.mean([np.mean([r[3:] for r in rows if r[1] == s], axis=0) for s in sorted({r[1] for r in rows if r[0] == g})], axis=0) for g in "pqrstu"}
    assert labels == list("pqrstu") and np.allclose(m, [want[g] for g in labels])
    fixed = trees.linkage(np.abs(np.subtract.outer(range(6), range(6))).astype(float))
    table = tanglegrams.sensitivity(labels, m, fixed)
    assert len(table) == 2 * len(trees.METHODS) * 3
    known = [r["baker_gamma"] for r in table if r["baker_gamma"] == r["baker_gamma"]]
    assert known == sorted(known, reverse=True) and all(r["crossings"] <= r["crossings_as_built"] for r in table)
    t = tanglegrams.tanglegram(labels, m, fixed)
    got = tanglegrams.links(spark, t).collect()
    assert [r["label"] for r in got] == list(t.fixed_order) and sorted(r["tree_place"] for r in got) == list(range(6))
    assert (tanglegrams.standardized(np.ones((3, 1))) == 0).all()
