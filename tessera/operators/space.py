"""Covariances, principal axes, feature scores: one aggregate in Spark, small matrices on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_corr


def moments(df: DataFrame, features: Sequence[str], weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariance (weighted, with weights that sum to 1, if given), in one pass."""
    cols = {f: F.col(f).cast("double") for f in features}
    mean_of = (lambda c: F.sum(F.col(weight) * c) / F.sum(weight)) if weight else F.avg
    means = np.array(df.agg(*[mean_of(c).alias(f) for f, c in cols.items()]).first(), dtype=float)
    centred = [c - F.lit(float(m)) for c, m in zip(cols.values(), means, strict=True)]
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1)]
    cov = np.zeros((len(features),) * 2)
    for k in range(0, len(pairs), 300):  # generated code has a size limit
        part = pairs[k : k + 300]
        got = df.agg(*[mean_of(centred[i] * centred[j]).alias(f"c{n}") for n, (i, j) in enumerate(part)]).first()
        for (i, j), v in zip(part, got, strict=True):
            cov[i, j] = cov[j, i] = v
    return means, cov


@dataclass(frozen=True)
class Axes:
    """Frozen principal axes: centre, loadings (features x components), share of variance."""

    features: tuple[str, ...]
    mean: np.ndarray
    loadings: np.ndarray
    explained: np.ndarray
    values: np.ndarray

    def project(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        cols = {}
        for k in range(self.loadings.shape[1]):
            terms = ((F.col(f).cast("double") - F.lit(float(m))) * F.lit(float(w)) for f, m, w in zip(self.features, self.mean, self.loadings[:, k], strict=True))
            cols[f"{prefix}{k + 1}"] = sum(terms, F.lit(0.0))
        return df.withColumns(cols)

    def components_for(self, share: float = 0.95) -> int:
        return int(min(np.searchsorted(np.cumsum(self.explained), share - 1e-12) + 1, len(self.explained)))

    def contributions(self) -> list[tuple[str, float]]:
        """Percent of the kept variance by feature."""
        total = self.explained.sum()
        return [(f, float((self.loadings[i] ** 2 * 100 * self.explained).sum() / total) if total else 0.0) for i, f in enumerate(self.features)]

    def top(self, component: int = 0, n: int = 5) -> list[tuple[str, float]]:
        order = np.argsort(-np.abs(self.loadings[:, component]), kind="stable")[:n]
        return [(self.features[i], float(self.loadings[i, component])) for i in order]


def fit_axes(df: DataFrame, features: Sequence[str], components: int = 50, weight: str | None = None) -> Axes:
    """Principal components of the covariance; in each, the loading of largest size is positive."""
    mean, cov = moments(df, features, weight)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[: min(components, len(features))]
    kept, loadings = np.clip(values[order], 0, None), vectors[:, order]
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(loadings.shape[1])])
    total = np.clip(values, 0, None).sum()
    return Axes(tuple(features), mean, loadings * np.where(signs == 0, 1, signs), kept / total if total else kept, kept)


def correlations(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Absolute pairwise-complete Pearson correlations; undefined counts 0."""
    out = np.eye(len(features))
    pairs = [(i, j) for i in range(len(features)) for j in range(i)]
    for k in range(0, len(pairs), 200):
        part = pairs[k : k + 200]
        got = df.agg(*[safe_corr(F.col(features[i]).cast("double"), F.col(features[j]).cast("double")).alias(f"r{n}") for n, (i, j) in enumerate(part)]).first()
        for (i, j), v in zip(part, got, strict=True):
            out[i, j] = out[j, i] = 0.0 if v is None or v != v else abs(v)
    return out


def correlation_filter(df: DataFrame, features: Sequence[str], threshold: float) -> list[str]:
    """Features that don't correlate above the threshold with any earlier one, dropped or not."""
    r = correlations(df, features)
    return [f for j, f in enumerate(features) if not (r[:j, j] > threshold).any()]


def variances(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    return df.agg(*[F.var_pop(F.col(f).cast("double")).alias(f) for f in features]).first().asDict()


def loading_scores(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    axes = fit_axes(df, features, 20)
    return dict(zip(axes.features, (np.abs(axes.loadings) * axes.explained).sum(axis=1).tolist(), strict=True))


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 50) -> DataFrame:
    """Rows (feature, mi): mutual information in nats of equal-width bins and label, all by pre-aggregated counts."""
    ranges = df.agg(*[a for f in features for a in (F.min(f).cast("double").alias(f"a_{f}"), F.max(f).cast("double").alias(f"b_{f}"))]).first()

    def cell(f: str) -> Column:
        low, width = ranges[f"a_{f}"], (ranges[f"b_{f}"] or 0) - (ranges[f"a_{f}"] or 0)
        return F.least(F.floor((F.col(f).cast("double") - F.lit(low)) / F.lit(width) * bins), F.lit(bins - 1)) if width else F.lit(0).cast("bigint")

    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), cell(f).alias("bin")) for f in features])
    counts = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.explode(pairs).alias("x")).where("x.bin is not null")
    joint = counts.groupBy("x.feature", "x.bin", "y").agg(F.count(F.lit(1)).alias("c"))
    of_bin = joint.groupBy("feature", "bin").agg(F.sum("c").alias("cb"))
    of_y = joint.groupBy("feature", "y").agg(F.sum("c").alias("cy"))
    n = joint.groupBy("feature").agg(F.sum("c").alias("n"))
    full = joint.join(of_bin, ["feature", "bin"]).join(of_y, ["feature", "y"]).join(n, "feature")
    return full.groupBy("feature").agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cb") * F.col("cy")))).alias("mi"))


def relevance_minus_redundancy(relevance: dict[str, float], r: np.ndarray, features: Sequence[str]) -> list[str]:
    """Greedy order: relevance less the mean absolute correlation with what is chosen; ties to the first."""
    left, chosen = list(range(len(features))), []
    while left:
        gain = [relevance[features[j]] - (r[j, chosen].mean() if chosen else 0.0) for j in left]
        chosen.append(left.pop(int(np.argmax(gain))))
    return [features[j] for j in chosen]


def top_features(scores: dict[str, float], n: int) -> list[str]:
    """Highest first, missing last, ties in the given order."""
    known = [(f, s) for f, s in scores.items() if s is not None and s == s]
    return [f for f, _ in sorted(known, key=lambda x: -x[1])][:n]


def ellipses(df: DataFrame, group: str, x: str, y: str, confidence: float = 0.95) -> DataFrame:
    """Per group: centre, full width and height, angle in degrees of the normal confidence ellipse; groups of one row are dropped."""
    q = -2 * np.log(1 - confidence)
    got = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("a"), F.var_samp(y).alias("c"), F.covar_samp(x, y).alias("b")
    ).where("n > 1")
    half = F.sqrt(((F.col("a") - F.col("c")) / 2) * ((F.col("a") - F.col("c")) / 2) + F.col("b") * F.col("b"))
    mid = (F.col("a") + F.col("c")) / 2
    length = lambda v: 2 * F.sqrt(F.greatest(v, F.lit(0.0)) * F.lit(float(q)))
    angle = F.degrees(0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c")))
    return got.select(group, "n", "cx", "cy", length(mid + half).alias("width"), length(mid - half).alias("height"), angle.alias("angle"))
