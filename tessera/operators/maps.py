"""Two-dimensional maps: fitted on a bounded sample, then applied to every row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import stratified_sample


def nearest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of the k rows of y nearest to each row of x, by blocks."""
    at, far = np.empty((len(x), k), dtype=int), np.empty((len(x), k))
    norms = (y * y).sum(axis=1)
    for a in range(0, len(x), 512):
        part = x[a : a + 512]
        d = np.clip((part * part).sum(axis=1)[:, None] + norms - 2 * part @ y.T, 0, None)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        order = np.take_along_axis(d, near, axis=1).argsort(axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        at[a : a + 512], far[a : a + 512] = near, np.sqrt(np.take_along_axis(d, near, axis=1))
    return at, far


def memberships(far: np.ndarray) -> np.ndarray:
    """exp(-(d - rho) / sigma) per row, sigma found by bisection so that a row's memberships sum to log2 of their number."""
    rho = np.where(far > 0, far, np.inf).min(axis=1)
    gap = np.clip(far - np.where(np.isfinite(rho), rho, 0)[:, None], 0, None)
    low, high = np.zeros(len(far)), np.full(len(far), np.inf)
    sigma, goal = np.ones(len(far)), np.log2(far.shape[1])
    for _ in range(64):
        over = np.exp(-gap / sigma[:, None]).sum(axis=1) > goal
        high, low = np.where(over, sigma, high), np.where(over, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    return np.exp(-gap / np.maximum(sigma, 1e-3 * far.mean(axis=1) + 1e-12)[:, None])


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b with 1 / (1 + a d^2b) nearest to 1 up to min_dist and exp(-(d - min_dist) / spread) beyond, by Gauss-Newton steps."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    goal = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    v = np.array([0.0, 0.0])  # logs of a and b

    def value(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(v[0]) * d ** (2 * np.exp(v[1])))

    damping = 1e-2
    for _ in range(200):
        f = value(v)
        jac = np.stack([(value(v + e) - f) / 1e-6 for e in np.eye(2) * 1e-6], axis=1)
        step = np.linalg.solve(jac.T @ jac + damping * np.eye(2), jac.T @ (goal - f))
        better = ((goal - value(v + step)) ** 2).sum() < ((goal - f) ** 2).sum()
        v, damping = (v + step, damping / 3) if better else (v, damping * 3)
    return float(np.exp(v[0])), float(np.exp(v[1]))


@dataclass(frozen=True)
class NeighbourMap:
    """A fitted map: sample rows, their places, and the features' scale."""

    features: tuple[str, ...]
    mean: np.ndarray
    sd: np.ndarray
    x: np.ndarray
    places: np.ndarray
    k: int

    def apply(self, df: DataFrame, names: tuple[str, str] = ("map_1", "map_2")) -> DataFrame:
        """Adds the mean place of a row's nearest sample rows, weighed by membership; null where a feature is missing."""
        me = self

        @F.pandas_udf("a double, b double")
        def place(v: pd.Series) -> pd.DataFrame:
            out = np.full((len(v), 2), np.nan)
            known = v.map(lambda r: r is not None and not np.isnan(np.asarray(r, dtype=float)).any()).to_numpy(dtype=bool)
            if known.any():
                z = (np.stack([np.asarray(r, dtype=float) for r in v[known]]) - me.mean) / me.sd
                at, far = nearest(z, me.x, me.k)
                w = memberships(far)
                same = far[:, 0] < 1e-7
                w[same] = np.eye(me.k)[0]  # a sample row keeps its place
                out[known] = (me.places[at] * (w / w.sum(axis=1, keepdims=True))[..., None]).sum(axis=1)
            return pd.DataFrame(out, columns=["a", "b"])

        whole = F.array(*[F.col(f).cast("double") for f in self.features])
        missing = F.exists(whole, lambda v: v.isNull())
        made = df.withColumn("_place", place(F.when(~missing, whole)))
        known = lambda c: F.when(~F.isnan(f"_place.{c}"), F.col(f"_place.{c}"))
        return made.withColumn(names[0], known("a")).withColumn(names[1], known("b")).drop("_place")


def lay_out(x: np.ndarray, k: int = 15, min_dist: float = 0.1, epochs: int = 200, seed: int = 42) -> np.ndarray:
    """Places of rows in two dimensions: fuzzy neighbour graph, axes of most variance to start, then attraction along its edges and repulsion from random rows."""
    n, rng = len(x), np.random.default_rng(seed)
    k = min(k, n - 1)
    at, far = nearest(x, x, k + 1)
    w = memberships(far[:, 1:])
    pairs: dict[tuple[int, int], float] = {}
    for i in range(n):
        for j, v in zip(at[i, 1:].tolist(), w[i].tolist(), strict=True):
            e = (i, j) if i < j else (j, i)
            if i != j:
                pairs[e] = pairs[e] + v - pairs[e] * v if e in pairs else v
    ends, weight = np.array(list(pairs)), np.array(list(pairs.values()))
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    y = (x - x.mean(axis=0)) @ axes[:2].T
    y = y if y.shape[1] == 2 else np.column_stack([y[:, 0], np.zeros(n)])
    y = 10 * y / max(np.abs(y).max(), 1e-12) + rng.normal(scale=1e-4, size=(n, 2))
    a, b = curve(min_dist)
    share = weight / weight.max()
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        used = rng.random(len(ends)) < share
        i, j = ends[used].T
        gap = y[i] - y[j]
        d2 = (gap * gap).sum(axis=1)
        pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)[:, None] * gap
        move = np.zeros_like(y)
        np.add.at(move, i, np.clip(pull, -4, 4))
        np.add.at(move, j, -np.clip(pull, -4, 4))
        for here in (i, j):
            other = rng.integers(n, size=(len(here), 3))
            gap = y[here][:, None] - y[other]
            d2 = (gap * gap).sum(axis=2)
            push = (2 * b / ((0.001 + d2) * (1 + a * d2**b)))[..., None] * gap
            np.add.at(move, here, np.clip(push, -4, 4).sum(axis=1))
        y = y + rate * np.clip(move, -4, 4)
    return y


def fit_map(df: DataFrame, features: Sequence[str], group: str, key: Sequence[str], k: int = 15, min_dist: float = 0.1, sample: int = 10_000, seed: int = 42) -> NeighbourMap:
    """Lay out at most `sample` rows, an equal share of each group, on z-scored features; apply() then places every row."""
    features = list(features)
    whole = df.dropna(subset=features)
    rows = stratified_sample(whole, group, sample, key, seed).orderBy(*key).select(*features).toPandas().to_numpy(dtype=float)  # `sample` rows at most
    if len(rows) < 3:
        raise ValueError("a map needs three rows or more")
    mean, sd = rows.mean(axis=0), rows.std(axis=0)
    sd = np.where(sd == 0, 1.0, sd)
    x = (rows - mean) / sd
    return NeighbourMap(tuple(features), mean, sd, x, lay_out(x, k, min_dist, seed=seed), min(k, len(x)))
