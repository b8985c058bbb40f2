"""Gaussian mixtures over all rows: each round of EM is one aggregation of sufficient statistics.

Tasks give, for each component, the sum of responsibilities, of responsibility-weighted rows and of
their outer products; Spark adds these up, and the driver gets as many numbers as the mixtures have
parameters. All numbers of clusters and all starts go through the same passes over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import sample_order

#: What is added to the variances, as usual for full covariances.
FLOOR = 1e-6
_BLOCK = 4096


@dataclass(frozen=True)
class Mixture:
    """Weights, means and full covariances of Gaussian components over features."""

    features: tuple[str, ...]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = math.nan
    rows: int = 0

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + k * d * (d + 1) // 2

    @property
    def bic(self) -> float:
        return self.parameters * math.log(self.rows) - 2 * self.log_likelihood

    def whiteners(self) -> np.ndarray:
        """For each component the matrix that turns a centred row into one of unit covariance."""
        return np.stack([np.linalg.inv(np.linalg.cholesky(c)).T for c in self.covariances])

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Rows by components: log of weight times density."""
        out = np.empty((len(x), len(self.weights)))
        for j, (w, m, p) in enumerate(zip(self.weights, self.means, self.whiteners(), strict=True)):
            out[:, j] = math.log(max(w, 1e-300)) - 0.5 * (((x - m) @ p) ** 2).sum(axis=1) + np.log(np.diag(p)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
        return out

    def columns(self) -> tuple[Column, Column]:
        """Expressions: the component of largest density (from 0, the first of equal ones), and the log density of the mixture."""
        logs = []
        for w, m, p in zip(self.weights, self.means, self.whiteners(), strict=True):
            centred = [F.col(f).cast("double") - F.lit(float(v)) for f, v in zip(self.features, m, strict=True)]
            gaps = [sum((c * F.lit(float(a)) for c, a in zip(centred, p[:, i], strict=True) if a), F.lit(0.0)) for i in range(len(m))]
            constant = math.log(max(w, 1e-300)) + float(np.log(np.diag(p)).sum()) - 0.5 * len(m) * math.log(2 * math.pi)
            logs.append(F.lit(constant) - F.lit(0.5) * sum((g * g for g in gaps), F.lit(0.0)))
        each = F.array(*[F.struct((-v).alias("v"), F.lit(j).alias("j")) for j, v in enumerate(logs)])
        top = F.array_min(each)
        both = F.aggregate(each, F.lit(0.0), lambda acc, e: acc + F.exp(-e["v"] + top["v"]), lambda acc: F.log(acc) - top["v"])
        return top["j"], both

    def reordered(self, order: Sequence[int]) -> Mixture:
        order = list(order)
        return Mixture(self.features, self.weights[order], self.means[order], self.covariances[order], self.log_likelihood, self.rows)


def starting_centres(x: np.ndarray, k: int, seed: int, rounds: int = 300) -> np.ndarray:
    """k-means of a bounded sample, from k-means++ starts."""
    rng = np.random.default_rng(seed)
    centre = [x[rng.integers(len(x))]]
    while len(centre) < k:
        d = np.min([((x - m) ** 2).sum(axis=1) for m in centre], axis=0)
        centre.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[rng.integers(len(x))])
    at = np.array(centre)
    for _ in range(rounds):
        own = ((x[:, None] - at[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[own == j].mean(axis=0) if (own == j).any() else at[j] for j in range(k)])
        if np.allclose(new, at):
            break
        at = new
    return at


def responsibilities(model: Mixture | np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Of rows for components, and the log-likelihood; of centres: the nearest one, and NaN."""
    if isinstance(model, np.ndarray):
        near = ((x[:, None] - model[None]) ** 2).sum(axis=2).argmin(axis=1)
        return np.eye(len(model))[near], math.nan
    logs = model.log_densities(x)
    top = logs.max(axis=1, keepdims=True)
    norm = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
    return np.exp(logs - norm[:, None]), float(norm.sum())


def _statistics(df: DataFrame, features: Sequence[str], models: Sequence[Mixture | np.ndarray], shift: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """For each model: log-likelihood, and by component sums of responsibilities, shifted rows and their outer products; one pass."""
    d = len(features)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(m) if isinstance(m, np.ndarray) else len(m.weights), 2 + d + d * d)) for m in models]
        for batch in batches:
            whole = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for at in range(0, len(whole), _BLOCK):
                x = whole[at : at + _BLOCK]
                off = x - shift
                for own, model in zip(sums, models, strict=True):
                    r, score = responsibilities(model, x)
                    own[0, 0] += score
                    own[:, 1] += r.sum(axis=0)
                    own[:, 2 : 2 + d] += r.T @ off
                    for j in range(len(own)):
                        own[j, 2 + d :] += ((r[:, j, None] * off).T @ off).ravel()
        rows = [(m, j, row) for m, own in enumerate(sums) for j, row in enumerate(own)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tolist() for r in rows], pa.list_(pa.float64()))],
            names=["m", "c", "sums"],
        )

    parts = df.select(*[F.col(f).cast("double").alias(f) for f in features]).mapInArrow(gather, "m int, c int, sums array<double>")
    added = parts.select("m", "c", F.posexplode("sums").alias("i", "v")).groupBy("m", "c", "i").agg(F.sum("v").alias("v"))
    out = {}
    sizes = [len(m) if isinstance(m, np.ndarray) else len(m.weights) for m in models]
    whole = [np.zeros((k, 2 + d + d * d)) for k in sizes]
    for r in added.collect():  # as many numbers as the models have parameters
        whole[r["m"]][r["c"], r["i"]] = r["v"]
    for m, own in enumerate(whole):
        out[m] = (own[0, 0], own[:, 1], own[:, 2 : 2 + d], own[:, 2 + d :].reshape(-1, d, d))
    return out


def _maximised(features: tuple[str, ...], got: tuple, shift: np.ndarray, rows: int) -> Mixture:
    _, n, sums, products = got
    n = n + 10 * np.finfo(float).eps
    mean = sums / n[:, None]
    covariance = products / n[:, None, None] - np.einsum("ij,ik->ijk", mean, mean) + FLOOR * np.eye(len(features))
    return Mixture(features, n / n.sum(), mean + shift, covariance, math.nan, rows)


def fit_mixtures(df: DataFrame, features: Sequence[str], candidates: Sequence[int], key: Sequence[str], starts: int = 3, tolerance: float = 1e-3, rounds: int = 100, sample: int = 10_000, seed: int = 42) -> dict[int, Mixture]:
    """For each number of components the mixture of largest likelihood among `starts`, fitted on all rows without missing features.

    Starts come from k-means of at most `sample` rows in digest order; a start is done when the mean
    log-likelihood moves by less than `tolerance`. Components are numbered by the rows they are
    likeliest for, the largest first.
    """
    features = tuple(features)
    known = df.dropna(subset=list(features)).where(~sum((F.isnan(F.col(f).cast("double")).cast("int") for f in features), F.lit(0)).cast("boolean"))
    known = known.select(*features, *[c for c in key if c not in features])
    x = known.orderBy(sample_order(key, seed), *key).limit(sample).select(*features).toPandas().to_numpy(dtype=float)
    first = known.agg(F.count("*").alias("n"), *[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    n = first["n"]
    if n <= max(candidates):
        raise ValueError("no more rows than components")
    shift = np.array([first[f"m{i}"] for i in range(len(features))])
    jobs = [(k, s) for k in candidates for s in range(starts)]
    models: list[Mixture | np.ndarray] = [starting_centres(x, k, seed + s) for k, s in jobs]
    last, active = np.full(len(jobs), -np.inf), list(range(len(jobs)))
    for _ in range(rounds + 1):  # the first gives the starts their parameters
        got = _statistics(known, features, [models[i] for i in active], shift)
        still = []
        for place, i in enumerate(active):
            begun = isinstance(models[i], np.ndarray)
            models[i] = _maximised(features, got[place], shift, n)
            score = got[place][0] / n
            if begun or abs(score - last[i]) >= tolerance:
                still.append(i)
            if not begun:
                last[i] = score
        active = still
        if not active:
            break
    best = {k: max((i for i, job in enumerate(jobs) if job[0] == k), key=lambda i: last[i]) for k in candidates}
    got = _statistics(known, features, [models[i] for i in best.values()], shift)
    out = {}
    for place, (k, i) in enumerate(best.items()):
        m = models[i]
        made = Mixture(m.features, m.weights, m.means, m.covariances, float(got[place][0]), n)
        sizes = {r["j"]: r["n"] for r in known.groupBy(made.columns()[0].alias("j")).agg(F.count("*").alias("n")).collect()}
        out[k] = made.reordered(sorted(range(k), key=lambda j: (-sizes.get(j, 0), j)))
    return out


def as_lists(model: Mixture) -> Mapping:
    return {"features": list(model.features), "weights": model.weights.tolist(), "means": model.means.tolist(), "covariances": model.covariances.tolist(), "log_likelihood": model.log_likelihood, "rows": model.rows}


def from_lists(data: Mapping) -> Mixture:
    return Mixture(tuple(data["features"]), *(np.array(data[c]) for c in ("weights", "means", "covariances")), data["log_likelihood"], data["rows"])
