"""Bags, cluster models, evaluation by group, permutation tests."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixtures import fit_mixtures
from .ordered import quantile
from .rows import sample_order

BAG_STATISTICS: dict[str, Callable[[str], Column]] = {"mean": F.avg, "std": F.stddev_samp, "median": F.median, "skew": F.skewness}


def bags(df: DataFrame, subject: str, features: Sequence[str], n_bags: int, size: int, key: Sequence[str], statistics: Sequence[str] = ("mean", "std"), seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """Rows (subject, bag, n_rows, {feature}__{statistic}): each bag is `size` rows of a subject in the order of a digest of seed, bag and key.

    A subject with fewer rows gives all of them to each bag. std is the sample SD, skew the population skewness.
    """
    drawn = df.where(F.col(subject).isNotNull()).withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(n_bags - 1))))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("bag").cast("string"), *[F.col(c).cast("string") for c in key]))
    ranked = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy(subject, "bag").orderBy(order, *key, *ties))).where(F.col("_rank") <= size)
    aggs = [BAG_STATISTICS[s](f).alias(f"{f}__{s}") for f in features for s in statistics]
    return ranked.groupBy(subject, "bag").agg(F.count(F.lit(1)).alias("n_rows"), *aggs)


def sampling_plan(df: DataFrame, subject: str, size: int) -> DataFrame:
    """Per subject: rows, whether bags of `size` need replacement, expected distinct rows of such a draw, disjoint bags."""
    n = df.groupBy(subject).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.select(
        subject, "n_rows", (F.col("n_rows") < size).alias("needs_replacement"),
        (F.col("n_rows") * (1 - F.pow(1 - 1 / F.col("n_rows"), F.lit(size)))).alias("expected_distinct"), F.floor(F.col("n_rows") / size).alias("disjoint_bags"),
    )


@dataclass(frozen=True)
class Clusters:
    """Frozen centroids, numbered by size; prediction is a projection."""

    features: tuple[str, ...]
    centroids: tuple[tuple[float, ...], ...]
    atypical: float

    def assign(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        gap = lambda c: F.sqrt(sum(((F.col(f).cast("double") - F.lit(v)) * (F.col(f).cast("double") - F.lit(v)) for f, v in zip(self.features, c, strict=True)), F.lit(0.0)))
        nearest = F.array_min(F.array(*[F.struct(gap(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(self.centroids)]))
        known = sum((F.col(f).isNull().cast("int") for f in self.features), F.lit(0)) == 0
        named = df.withColumn("_nearest", F.when(known, nearest))
        label = F.concat(F.lit("Cluster_"), (F.col("_nearest.k") + 1).cast("string"))
        return named.withColumn(name, label).withColumn(f"{name}_distance", F.col("_nearest.d")).drop("_nearest")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Clusters:
        data = json.loads(text)
        return Clusters(tuple(data["features"]), tuple(map(tuple, data["centroids"])), data["atypical"])


def _first_rows(rows: DataFrame, features: Sequence[str], key: Sequence[str], sample: int, seed: int) -> np.ndarray:
    return rows.orderBy(sample_order(key, seed), *key).limit(sample).select(*features).toPandas().to_numpy(dtype=float)


def _cluster_sums(rows: DataFrame, features: Sequence[str], centre: np.ndarray, weight: str | None) -> list:
    """Rows (c, n, w, s0, s1, ..., inertia) of the clusters that have rows: rows, weight, weighted sums of the features and of squared distances; added up by batch, then by partition."""
    k, width = centre.shape
    names = ["c", "n", "w", *[f"s{j}" for j in range(width)], "inertia"]

    def part(batches):
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((2 + width, k))
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            d = np.sqrt([sum((x[j] - m[j]) ** 2 for j in range(width)) for m in centre])
            a = d.argmin(axis=0)
            n += np.bincount(a, minlength=k)
            w = x[width] if weight else np.ones(len(a))
            for j in range(width + 1):
                sums[j] += np.bincount(a, weights=w * x[j - 1] if j else w, minlength=k)
            sums[-1] += np.bincount(a, weights=w * d.min(axis=0) ** 2, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), *map(pa.array, sums)], names=names)

    plain = rows.select(*[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)], *([F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w")] if weight else []))
    made = plain.mapInArrow(part, "c long, n long, " + ", ".join(f"{c} double" for c in names[2:]))
    return made.where("n > 0").groupBy("c").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect()  # a row per cluster


def fit_clusters(df: DataFrame, features: Sequence[str], k: int, key: Sequence[str], starts: int = 5, rounds: int = 12, sample: int = 10_000, seed: int = 42, weight: str | None = None, x: np.ndarray | None = None, limit: bool = True) -> Clusters:
    """k-means: starts chosen on a bounded sample (in digest order, k-means++), then Lloyd steps over all rows as aggregates, weighted by a column if given. x: that sample, if known; without limit, `atypical` is infinite."""
    features = list(features)
    rows = df.dropna(subset=features).select(*features, *[c for c in key if c not in features], *([weight] if weight else []))
    x = _first_rows(rows, features, key, sample, seed) if x is None else x
    if len(x) < k:
        raise ValueError("fewer rows than clusters")

    def start(rng) -> np.ndarray:
        c = [x[rng.integers(len(x))]]
        while len(c) < k:
            d = np.min([((x - m) ** 2).sum(axis=1) for m in c], axis=0)
            c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[rng.integers(len(x))])
        return np.array(c)

    def lloyd(c: np.ndarray) -> tuple[float, np.ndarray]:
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
            a = d.argmin(axis=1)
            new = np.array([x[a == j].mean(axis=0) if (a == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        return float(d.min(axis=1).sum()), c

    _, centre = min((lloyd(start(np.random.default_rng(seed + s))) for s in range(starts)), key=lambda z: z[0])
    for _ in range(rounds):
        new = centre.copy()
        sizes = np.zeros(k)
        for r in _cluster_sums(rows, features, centre, weight):
            new[r["c"]], sizes[r["c"]] = [r[f"s{j}"] / r["w"] for j in range(len(features))], r["n"]
        moved = np.abs(new - centre).max()
        centre = new
        if moved < 1e-9:
            break
    centre = centre[np.argsort(-sizes, kind="stable")]
    model = Clusters(tuple(features), tuple(map(tuple, centre.tolist())), math.inf)
    return Clusters(model.features, model.centroids, quantile(model.assign(rows, "c"), "c_distance", 0.99)) if limit else model


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette, by blocks of rows; for a bounded sample."""
    names, inverse, counts = np.unique(labels, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return math.nan
    out = np.empty(len(x))
    for a in range(0, len(x), 512):
        d = np.sqrt(np.clip(((x[a : a + 512, None] - x[None]) ** 2).sum(axis=2), 0, None))
        sums = np.stack([d[:, inverse == j].sum(axis=1) for j in range(len(names))], axis=1)
        own = inverse[a : a + 512]
        at = np.arange(len(own))
        inner = sums[at, own] / np.maximum(counts[own] - 1, 1)
        mean = sums / counts
        mean[at, own] = np.inf
        other = mean.min(axis=1)
        out[a : a + 512] = np.where(counts[own] > 1, (other - inner) / np.maximum(np.maximum(inner, other), 1e-300), 0.0)
    return float(out.mean())


def scan_clusters(df: DataFrame, features: Sequence[str], candidates: Sequence[int], key: Sequence[str], sample: int = 10_000, algorithm: str = "kmeans", seed: int = 42, weight: str | None = None) -> list[dict]:
    """For each number of clusters: silhouette and, by algorithm, inertia (k-means) or BIC (Gaussian mixtures), both over all rows, and the smallest cluster's share.

    Silhouettes are of at most `sample` rows, chosen by digest of the key.
    """
    return scan_and_fit(df, features, candidates, key, sample, algorithm, seed, weight, limits=False)[0]


def scan_and_fit(df: DataFrame, features: Sequence[str], candidates: Sequence[int], key: Sequence[str], sample: int = 10_000, algorithm: str = "kmeans", seed: int = 42, weight: str | None = None, limits: bool = True) -> tuple[list[dict], dict]:
    """What scan_clusters says, and the model of each number of clusters; k-means without limits has infinite `atypical`."""
    if algorithm not in ("kmeans", "gmm"):
        raise ValueError("algorithm must be kmeans or gmm")
    features = list(features)
    rows = df.dropna(subset=features)
    x = _first_rows(rows, features, key, sample, seed)
    fitted = fit_mixtures(df, features, candidates, key, sample=sample, seed=seed) if algorithm == "gmm" else {k: fit_clusters(df, features, k, key, sample=sample, seed=seed, weight=weight, x=x, limit=limits) for k in candidates}
    out = []
    for k, model in fitted.items():
        if algorithm == "kmeans":
            got = _cluster_sums(rows, features, np.array(model.centroids), weight)
            inertia, score = float(sum(r["inertia"] for r in got)), math.nan
            labels = ((x[:, None] - np.array(model.centroids)[None]) ** 2).sum(axis=2).argmin(axis=1)
        else:
            got = rows.groupBy(model.columns()[0].alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
            inertia, score = math.nan, model.bic
            labels = model.log_densities(x).argmax(axis=1)
        sizes = [r["n"] for r in got]
        share = min(sizes) / sum(sizes) if len(sizes) == k else 0.0
        out.append({"n_clusters": k, "silhouette": silhouette(x, labels), "bic": score, "inertia": inertia, "smallest_share": share})
    return out, fitted


def choose_clusters(table: Sequence[dict], algorithm: str = "kmeans") -> int:
    """The number with the highest silhouette (k-means; the first of equal ones, undefined ones last) or the lowest BIC (mixtures)."""
    if algorithm == "kmeans":
        return max(table, key=lambda r: -math.inf if math.isnan(r["silhouette"]) else r["silhouette"])["n_clusters"]
    return min(table, key=lambda r: r["bic"])["n_clusters"]


def feature_statistics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: mean, population standard deviation, minimum and maximum of the values that aren't missing."""
    x = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    row = lambda f: F.struct(F.lit(f).alias("feature"), F.avg(x(f)).alias("mean"), F.stddev_pop(x(f)).alias("sd"), F.min(x(f)).alias("low"), F.max(x(f)).alias("high"))
    return df.agg(F.array(*[row(f) for f in features]).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def atypical_share(assigned: DataFrame, limit: float, label: str = "cluster") -> DataFrame:
    """Per cluster: rows, and the share of those that lie beyond the model's distance limit."""
    return assigned.groupBy(label).agg(F.count("*").alias("n"), F.avg((F.col(f"{label}_distance") > limit).cast("double")).alias("atypical_share"))


def drift_from_training(df: DataFrame, training: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: shift of the mean, share outside the training range, and a flag (shift over 1 or share over 5 %)."""
    t = training.agg(*[a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.min(f).alias(f"a_{f}"), F.max(f).alias(f"b_{f}"))]).first()
    row = lambda f: F.struct(
        F.lit(f).alias("feature"), (F.avg(f) - F.lit(t[f"m_{f}"])).alias("mean_shift"),
        F.avg(((F.col(f) < t[f"a_{f}"]) | (F.col(f) > t[f"b_{f}"])).cast("double")).alias("outside"),
    )
    long = df.agg(F.array(*[row(f) for f in features]).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return long.withColumn("flagged", (F.abs("mean_shift") > 1.0) | (F.col("outside") > 0.05))


def cluster_proportions(df: DataFrame, subject: str, cluster: str) -> DataFrame:
    """Per cluster: rows, percent of all, and mean, sample SD and median of the subjects' percentages (0 where a subject has none)."""
    counts = df.groupBy(subject, cluster).agg(F.count(F.lit(1)).alias("c"))
    grid = counts.select(subject).distinct().join(counts.select(cluster).distinct())  # subjects x clusters, both small
    per = grid.join(counts, [subject, cluster], "left").na.fill(0, ["c"]).withColumn("pct", 100 * F.col("c") / F.sum("c").over(Window.partitionBy(subject)))
    total = F.sum("c").over(Window.partitionBy())
    got = per.groupBy(cluster).agg(F.sum("c").alias("c"), F.avg("pct").alias("mean_pct"), F.stddev_samp("pct").alias("sd_pct"), F.median("pct").alias("median_pct"))
    return got.withColumn("pct_of_all", 100 * F.col("c") / total)


def fold_of(key: Sequence[str], folds: int, seed: int = 42) -> Column:
    """Fold from a digest of the key: rows of one key stay together."""
    return F.conv(F.substring(sample_order(key, seed), 1, 8), 16, 10).cast("long") % folds


def nearest_centroid_by_group(df: DataFrame, features: Sequence[str], label: str, group: str) -> DataFrame:
    """Leave-one-group-out predictions of a nearest-centroid classifier, in one job.

    The centroid of a class without a group is its total less that group's part, so no fold is
    trained on its own. Rows: group, label, predicted, n.
    """
    features = list(features)
    per = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"s_{f}") for f in features])
    w = Window.partitionBy(label)
    every = per.select(label).distinct().join(per.select(group).distinct())  # classes x groups, both small
    full = every.join(per, [group, label], "left").na.fill(0)
    out = full.withColumn("m", F.sum("n").over(w) - F.col("n"))
    out = out.withColumns({f"c_{f}": (F.sum(f"s_{f}").over(w) - F.col(f"s_{f}")) / F.col("m") for f in features}).where("m > 0")
    table = out.groupBy(group).agg(F.collect_list(F.struct(F.col(label).alias("y"), F.array(*[f"c_{f}" for f in features]).alias("c"))).alias("centroids"))
    gap = lambda c: sum(((F.col(f) - c["c"][j]) * (F.col(f) - c["c"][j]) for j, f in enumerate(features)), F.lit(0.0))
    guessed = df.join(table, group).withColumn("predicted", F.array_min(F.transform("centroids", lambda c: F.struct(gap(c).alias("d"), c["y"].alias("y"))))["y"])
    return guessed.groupBy(group, label, "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str, predicted: str, values: Sequence) -> DataFrame:
    """Row-normalised confusion matrix."""
    counts = df.groupBy(truth).pivot(predicted, list(values)).count().na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return counts.select(truth, *[(F.col(f"`{v}`") / total).alias(f"as_{v}") for v in values])


def label_assignments(labels: Sequence[str], most: int = 5000, rounds: int = 1000, seed: int = 42) -> list[tuple[str, ...]]:
    """Permuted labels of subjects, the true one first: all of them if two labels give `most` or fewer, else distinct random ones."""
    names = sorted(set(labels))
    if len(names) == 2 and math.comb(len(labels), labels.count(names[0])) <= most:
        every = (
            tuple(names[0] if i in set(c) else names[1] for i in range(len(labels))) for c in itertools.combinations(range(len(labels)), labels.count(names[0]))
        )
        return [tuple(labels), *(a for a in every if a != tuple(labels))]
    rng, seen = np.random.default_rng(seed), {tuple(labels): None}
    for _ in range(20 * rounds):
        if len(seen) > rounds:
            break
        seen[tuple(rng.permutation(list(labels)))] = None
    return list(seen)


def permutation_test(df: DataFrame, subject: str, label: str, value: str, most: int = 5000, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """One row: observed spread of group means over subjects, and the share of label assignments that reach it (the true one included)."""
    per = df.groupBy(subject).agg(F.first(label).alias("y"), F.avg(value).alias("v")).orderBy(subject).toPandas()  # a row per subject
    values, labels = per["v"].to_numpy(dtype=float), per["y"].astype(str).tolist()
    spark = df.sparkSession
    assigned = spark.createDataFrame([(i, list(a)) for i, a in enumerate(label_assignments(labels, most, rounds, seed))], "i long, y array<string>")

    def evaluate(parts):
        for pdf in parts:
            stat = [float(np.ptp([values[np.array(y) == g].mean() for g in sorted(set(y))])) for y in pdf["y"]]
            yield pd.DataFrame({"i": pdf["i"], "stat": stat})

    got = assigned.mapInPandas(evaluate, "i long, stat double")
    seen = F.max(F.when(F.col("i") == 0, F.col("stat")))
    both = got.withColumn("observed", seen.over(Window.partitionBy()))
    return both.agg(F.first("observed").alias("observed"), F.avg((F.col("stat") >= F.col("observed") - 1e-12).cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))


def linear_attributions(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean absolute contribution weight x (value - mean) of each feature of a linear model."""
    means = df.agg(*[F.avg(f).alias(f) for f in weights]).first()
    part = lambda f: F.struct(F.lit(f).alias("feature"), F.avg(F.abs(F.lit(weights[f]) * (F.col(f) - F.lit(means[f])))).alias("importance"))
    return df.agg(F.array(*[part(f) for f in weights]).alias("r")).select(F.explode("r").alias("r")).select("r.*")
