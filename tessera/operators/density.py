"""Density clusters of a bounded table (bags, maps), their profiles, and density curves of groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import silhouette


def spanning_tree(x: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (weight, a, b), a < b, of the least spanning tree under mutual reachability, by weight; a row of distances at a time.

    Of edges of one weight that with the smaller ends comes first, so there is one such tree only.
    """
    n = len(x)
    rows = np.arange(n)
    ends = lambda a, b: np.minimum(a, b) * n + np.maximum(a, b)
    best, source, open_ = np.full(n, np.inf), np.zeros(n, dtype=int), np.ones(n, dtype=bool)
    edges, at = [], 0
    for _ in range(n - 1):
        open_[at] = False
        reach = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(axis=1)), core[at]), core)
        closer = open_ & ((reach < best) | (reach == best) & (ends(rows, at) < ends(rows, source)))
        best[closer], source[closer] = reach[closer], at
        least = np.flatnonzero(open_ & (best == best[open_].min()))
        at = int(least[ends(least, source[least]).argmin()])
        a, b = sorted((int(source[at]), at))
        edges.append((float(best[at]), a, b))
    return sorted(edges)


def hdbscan(x: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None) -> np.ndarray:
    """Labels 0.. of clusters by excess of mass, -1 for noise; memory is linear, time quadratic in the rows: for a bounded table (others: density_trees).

    min_samples (the row itself included) is min_cluster_size unless given. The root is no cluster.
    """
    n = len(x)
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    k = min(min_samples or min_cluster_size, n) - 1
    core = np.array([np.partition(np.sqrt(((x - row) ** 2).sum(axis=1)), k)[k] for row in x])
    return labels_of_tree(spanning_tree(x, core), n, min_cluster_size)


def labels_of_tree(edges: list[tuple[float, int, int]], n: int, min_cluster_size: int) -> np.ndarray:
    """Labels of n rows from the edges (weight, a, b) of their least spanning tree, by weight."""
    parent, left, right, height, size = list(range(2 * n - 1)), {}, {}, {}, [1] * n + [0] * (n - 1)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for new, (w, a, b) in enumerate(edges, start=n):
        a, b = find(a), find(b)
        left[new], right[new], height[new], size[new] = a, b, w, size[a] + size[b]
        parent[a] = parent[b] = new

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            i = todo.pop()
            if i < n:
                out.append(i)
            else:
                todo += [left[i], right[i]]
        return out

    density = lambda w: 1 / w if w > 0 else 1e12
    birth, mass, children, fell = {0: 0.0}, {0: 0.0}, {0: []}, np.zeros(n, dtype=int)
    todo = [(2 * n - 2, 0)]
    while todo:  # from the root: a split with two large sides makes two clusters, else small sides fall out
        node, c = todo.pop()
        if node < n:
            fell[node] = c
            continue
        level, sides = density(height[node]), (left[node], right[node])
        if all(size[s] >= min_cluster_size for s in sides):
            mass[c] += size[node] * (level - birth[c])
            for s in sides:
                new = len(birth)
                birth[new], mass[new], children[new] = level, 0.0, []
                children[c].append(new)
                todo.append((s, new))
            continue
        for s in sides:
            if size[s] >= min_cluster_size:
                todo.append((s, c))
            else:
                mass[c] += size[s] * (level - birth[c])
                fell[leaves(s)] = c
    chosen, value = {}, {}
    for c in sorted(birth, reverse=True):  # children come after their parents
        below = sum(value[d] for d in children[c])
        chosen[c] = c != 0 and mass[c] >= below
        value[c] = mass[c] if chosen[c] else below
    label, names, todo = {}, 0, [(0, -1)]
    while todo:
        c, own = todo.pop()
        if own < 0 and chosen[c]:
            own, names = names, names + 1
        label[c] = own
        todo += [(d, own) for d in reversed(children[c])]
    return np.array([label[c] for c in fell])


def clustering_quality(x: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    """Clusters without noise, share of noise, and silhouette of the other rows (NaN below two clusters)."""
    kept = labels >= 0
    return {"clusters": len(set(labels[kept].tolist())), "noise": float(1 - kept.mean()) if len(labels) else math.nan, "silhouette": silhouette(x[kept], labels[kept])}


def profiles(df: DataFrame, cluster: str, features: Sequence[str], condition: str, young: str = "young", old: str = "old") -> DataFrame:
    """Per cluster, noise included: rows, percent of either condition (one digit), feature means."""
    share = lambda v: F.round(100 * F.avg(F.coalesce(F.col(condition) == v, F.lit(False)).cast("double")), 1)
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), share(young).alias("pct_young"), share(old).alias("pct_old"), *[F.avg(f).alias(f) for f in features])


def density_curve(df: DataFrame, group: str, value: str, points: int = 300, margin: float = 0.05) -> DataFrame:
    """Rows (grp, i, x, density): Gaussian kernels of Scott's width on an even grid over each group's range and a margin on either side.

    Equal values are counted first, so a grid point meets each distinct value of its group once.
    Groups of fewer than two rows or without spread give none.
    """
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull() & ~F.isnan(v) & F.col(group).isNotNull())
    counts = known.groupBy(F.col(group).alias("grp"), v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    spread = known.groupBy(F.col(group).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), (F.stddev_samp(v) * F.pow(F.count(F.lit(1)).cast("double"), -0.2)).alias("h"),
        (F.min(v) - margin * (F.max(v) - F.min(v))).alias("a"), ((F.max(v) - F.min(v)) * (1 + 2 * margin) / (points - 1)).alias("step"),
    )
    laid = counts.join(spread.where("h > 0"), "grp").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("a") + F.col("i") * F.col("step")
    kernel = F.col("c") * F.exp(-0.5 * F.pow((x - F.col("v")) / F.col("h"), 2.0))
    total = F.sum(kernel) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))
    return laid.groupBy("grp", "i").agg(F.first(x).alias("x"), total.alias("density"))


def violin(df: DataFrame, group: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rows (group..., feature, n, minimum, q25, median, q75, maximum)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = df.select(*group, F.explode(pairs).alias("p")).select(*group, "p.feature", F.when(~F.isnan("p.v"), F.col("p.v")).alias("v")).where("v is not null")
    q = lambda p: F.percentile("v", p)
    return long.groupBy(*group, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("minimum"), q(0.25).alias("q25"), F.median("v").alias("median"), q(0.75).alias("q75"), F.max("v").alias("maximum")
    )
