"""Heterogeneity of individuals: dispersion, structure, entropy, in relative and in frozen reference spaces."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import digamma
from ..sources.dataset import written
from . import group_kernels
from .layers import Layer, fit_layer
from .space import fit_axes

#: Groups with fewer rows are skipped.
MIN_ROWS = 5


def _few(df: DataFrame, large: bool) -> DataFrame:
    """A table of a row per group; where groups are large they are few, and it goes to the rows."""
    return F.broadcast(df) if large else df


def _big_enough(df: DataFrame, group: str, large: bool = False) -> DataFrame:
    """Rows of groups of MIN_ROWS or more; null groups are dropped."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= MIN_ROWS)
    return df.join(_few(sizes, large), group)


def _distances(df: DataFrame, group: str, columns: Sequence[str], large: bool = False) -> DataFrame:
    """Adds d, the Euclidean distance to the group's centroid."""
    centroids = df.groupBy(group).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    joined = df.join(_few(centroids, large), group)
    return joined.withColumn("d", F.sqrt(sum(((F.col(c) - F.col(f"_m_{c}")) * (F.col(c) - F.col(f"_m_{c}")) for c in columns), F.lit(0.0))))


def quantiles_of_large(df: DataFrame, group: str, value: str, shares: Sequence[float], bins: int = 4096) -> DataFrame:
    """Rows (group, n, q), q the exact quantiles of each group, linear between rows; a group's values needn't fit a task.

    Values are counted in cells of each group's range, and only cells that hold a row asked for are
    sorted. n counts all rows, null values too; NaN comes last.
    """
    narrow = written(df.select(group, F.col(value).cast("double").alias("v")), "values")
    fine = F.when(~F.isnan("v"), F.col("v"))
    ends = narrow.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("_known"), F.min(fine).alias("_low"), (F.max(fine) - F.min(fine)).alias("_wide"))
    cell = F.when(F.isnan("v"), F.lit(bins).cast("long")).otherwise(F.coalesce(F.least(F.floor((F.col("v") - F.col("_low")) / F.when(F.col("_wide") > 0, F.col("_wide")) * bins), F.lit(bins - 1)), F.lit(0)).cast("long"))
    ends = written(ends, "ends")
    placed = narrow.where("v is not null").join(F.broadcast(ends.drop("n")), group).withColumn("_cell", cell)
    counts = placed.groupBy(group, "_cell", "_known").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(group).orderBy("_cell")) - F.col("_c")
    places = F.array(*[f(F.lit(float(s)) * (F.col("_known") - 1)).cast("long") for s in shares for f in (F.floor, F.ceil)])
    inside = F.filter(F.array_distinct(places), lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_c")))
    wanted = counts.withColumn("_before", before).withColumn("_places", inside).where(F.size("_places") > 0).select(group, "_cell", "_before", "_places")
    near = placed.select(group, "_cell", "v").join(F.broadcast(wanted), [group, "_cell"])
    at = F.col("_before") + F.row_number().over(Window.partitionBy(group, "_cell").orderBy("v")) - 1
    found = near.withColumn("_at", at).where(F.array_contains("_places", F.col("_at"))).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("_at", "v"))).alias("_v"))

    def quantile(share: float):
        place = F.lit(float(share)) * (F.col("_known") - 1)
        low, high = (F.col("_v")[f(place).cast("long")] for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return ends.join(found, group, "left").select(group, "n", F.array(*map(quantile, shares)).alias("q"))


def dispersion(df: DataFrame, group: str, features: Sequence[str], standardize: str = "all", large: bool = False) -> DataFrame:
    """Per group: n, median and quartiles of the distance of standardised rows to their centroid (z-scores over all rows or the group).

    `large` is for few groups of any size: their quantiles are found by counting.
    """
    rows = _big_enough(df, group, large)
    if standardize == "all":
        z = fit_layer(df, features).apply(rows, "_z")
    else:
        w = Window.partitionBy(group)
        spread = lambda f: F.stddev_pop(f).over(w)
        z = rows.withColumns({f"{f}_z": (F.col(f) - F.avg(f).over(w)) / F.when(spread(f) == 0, 1.0).otherwise(spread(f)) for f in features})
    d = _distances(z, group, [f"{f}_z" for f in features], large)
    if large:
        q = F.col("q")
        return quantiles_of_large(d, group, "d", (0.5, 0.25, 0.75)).select(group, "n", q[0].alias("mhi_d"), q[1].alias("q25"), q[2].alias("q75"))
    return d.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.median("d").alias("mhi_d"), F.percentile("d", 0.25).alias("q25"), F.percentile("d", 0.75).alias("q75")
    )


def reference_layer(df: DataFrame, features: Sequence[str]) -> Layer:
    """The frozen reference: z-scores of a population of 10 rows or more; its origin is the mean."""
    if df.limit(10).count() < 10:
        raise ValueError("a reference needs at least 10 rows")
    return fit_layer(df, features)


def absolute(df: DataFrame, group: str, reference: Layer) -> DataFrame:
    """Per group in the reference space: offset (norm of the centroid), distances to the origin, and spread around the own centroid."""
    z = reference.apply(_big_enough(df, group), "_z")
    cols = [f"{f}_z" for f in reference.features]
    far = z.withColumn("o", F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))))
    d = _distances(far, group, cols)
    offset = F.sqrt(sum((F.avg(c) * F.avg(c) for c in cols), F.lit(0.0)))
    return d.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), offset.alias("amhi_offset"), F.median("o").alias("amhi_median"), F.avg("o").alias("amhi_mean"),
        F.stddev_pop("o").alias("amhi_std"), F.percentile("o", 0.25).alias("amhi_q25"), F.percentile("o", 0.75).alias("amhi_q75"), F.median("d").alias("mhi_d_absolute"),
    )


def binned_entropy(df: DataFrame, group: str, features: Sequence[str], bins: int = 4, dims: int = 5) -> DataFrame:
    """Per group: Shannon entropy of joint quantile cells over (dimensions x ln bins), within 0 and 1.

    More than `dims` features are first projected on that many principal axes of their z-scores,
    those of the largest variance. A group's edges are its own quantiles; duplicate edges fall together.
    """
    features = list(features)
    if len(features) > dims:
        df = fit_layer(df, features).apply(df, "_z")
        df = fit_axes(df, [f"{f}_z" for f in features], dims).project(df, "_axis")
        features = [f"_axis{k + 1}" for k in range(dims)]
    rows = _big_enough(df, group)
    inner = [k / bins for k in range(1, bins)]
    edges = rows.groupBy(group).agg(*[F.percentile(f, inner).alias(f"_e_{f}") for f in features])
    below = lambda f: F.size(F.filter(F.array_distinct(f"_e_{f}"), lambda e: e < F.col(f)))
    cell = F.concat_ws("|", *[below(f).cast("string") for f in features])
    counts = rows.join(edges, group).groupBy(group, cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(group))
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("h") / (len(features) * math.log(bins))))
    return counts.withColumn("p", p).groupBy(group).agg((-F.sum(F.col("p") * F.log("p"))).alias("h")).select(group, total.alias("mhi_e_bins"))


def knn_entropy(x: np.ndarray, k: int = 5) -> float:
    """Nearest-neighbour entropy over ln n, without the volume term; blocks bound its memory."""
    n, d = x.shape
    if n < k + 2:
        return math.nan
    radius = np.empty(n)
    square = (x * x).sum(axis=1)
    for a in range(0, n, 128):
        dist = square[a : a + 128, None] + square[None]
        dist -= 2 * x[a : a + 128] @ x.T
        dist.partition(k, axis=1)
        radius[a : a + 128] = np.sqrt(np.clip(dist[:, k], 0, None))
    return (-digamma(k) + digamma(n) + d / n * np.log(np.maximum(radius, 1e-10)).sum()) / math.log(n)


def dip(values: np.ndarray) -> float:
    """Hartigan's dip: half the least width of a band, between a convex and a concave part, that holds the empirical distribution."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return 0.5 / n if n else math.nan

    def hull(px: np.ndarray, py: np.ndarray, lower: bool) -> np.ndarray:
        """Greatest convex minorant (lower) or least concave majorant, at px."""
        keep: list[int] = []
        for i in range(len(px)):
            while len(keep) > 1:
                a, b = keep[-2], keep[-1]
                cross = (px[b] - px[a]) * (py[i] - py[a]) - (py[b] - py[a]) * (px[i] - px[a])
                if (cross <= 0) if lower else (cross >= 0):
                    keep.pop()
                else:
                    break
            keep.append(i)
        return np.array(keep)

    low, high, best = 0, n - 1, 1.0 / n
    up, down = np.arange(1, n + 1) / n, np.arange(n) / n
    while True:
        px = x[low : high + 1]
        g, l = hull(px, down[low : high + 1], True), hull(px, up[low : high + 1], False)
        gv, lv = np.interp(px, px[g], down[low : high + 1][g]), np.interp(px, px[l], up[low : high + 1][l])
        gaps = np.concatenate([lv[g] - gv[g], lv[l] - gv[l]])
        at = int(gaps.argmax())
        width = gaps[at]
        if width <= best + 1e-15:
            return best / 2
        point = (g[at] if at < len(g) else l[at - len(g)])
        new_low = g[g <= point].max() if at >= len(g) else point
        new_high = l[l >= point].min() if at < len(g) else point
        left, right = px[: new_low + 1], px[new_high:]
        if len(left):
            best = max(best, float((up[low : high + 1][: new_low + 1] - gv[: new_low + 1]).max()))
        if len(right):
            best = max(best, float((lv[new_high:] - down[low : high + 1][new_high:]).max()))
        if new_low == 0 and new_high == high - low or new_high <= new_low:
            return max(best, width if new_high <= new_low else best) / 2
        low, high = low + int(new_low), low + int(new_high)


def gaussian_mixture(x: np.ndarray, k: int, seed: int = 42, rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Full-covariance mixture by EM: log-likelihood, weights, means, covariances."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    means = x[rng.choice(n, k, replace=False)]
    cov = np.repeat((np.cov(x.T, bias=True).reshape(d, d) + 1e-6 * np.eye(d))[None], k, axis=0)
    weights, last, score = np.full(k, 1 / k), -math.inf, -math.inf
    for _ in range(rounds):
        logs = np.empty((n, k))
        for j in range(k):
            chol = np.linalg.cholesky(cov[j])
            y = np.linalg.solve(chol, (x - means[j]).T)
            logs[:, j] = np.log(weights[j] + 1e-300) - 0.5 * (y * y).sum(axis=0) - np.log(np.diag(chol)).sum() - 0.5 * d * math.log(2 * math.pi)
        top = logs.max(axis=1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        score = float(norm.sum())
        if abs(score - last) < 1e-3 * n * 1e-3:
            break
        last = score
        resp = np.exp(logs - norm[:, None])
        nk = resp.sum(axis=0) + 1e-10
        weights, means = nk / n, resp.T @ x / nk[:, None]
        for j in range(k):
            c = x - means[j]
            cov[j] = (resp[:, j, None] * c).T @ c / nk[j] + 1e-6 * np.eye(d)
    return score, weights, means, cov


def bic(x: np.ndarray, k: int, seed: int = 42) -> float:
    n, d = x.shape
    best = max(gaussian_mixture(x, k, seed + s)[0] for s in range(3))
    return -2 * best + (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(n)


@cache
def _uniform_dips(draws: int = 1000, size: int = 200, seed: int = 0) -> np.ndarray:
    """Sorted dips of uniform samples times the root of their size, whose distribution hardly depends on it."""
    rng = np.random.default_rng(seed)
    return np.sort(group_kernels.dips([rng.random(size) for _ in range(draws)]) * math.sqrt(size))


def dip_p_value(statistic: float, n: int) -> float:
    """Share of uniform samples with a dip as large, from a thousand simulated ones."""
    table = _uniform_dips()
    return float(len(table) - np.searchsorted(table, statistic * math.sqrt(n), side="left")) / len(table)


def _large_enough_groups(batches: Iterator[pa.RecordBatch], group: str, features: Sequence[str]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Key and rows of each group of MIN_ROWS or more; batches come ordered by group. Rows are ordered, as the draws of the mixtures depend on it."""
    for key, parts in group_kernels.runs(batches, group):
        if sum(b.num_rows for b in parts) >= MIN_ROWS:
            x = group_kernels.matrix(parts, features)
            yield key, x[np.lexsort(x.T)]


def _together(groups: Iterator[tuple[pa.Array, np.ndarray]], rows: int) -> Iterator[list[tuple[pa.Array, np.ndarray]]]:
    """Groups in lists of about that many rows, or of one group."""
    held, size = [], 0
    for one in groups:
        if held and size + len(one[1]) > rows:
            yield held
            held, size = [], 0
        held.append(one)
        size += len(one[1])
    if held:
        yield held


def _mixture_bics(units: Sequence[np.ndarray], max_k: int) -> np.ndarray:
    """A row per unit: the BIC of its mixtures of 1..max_k parts; units of like size and the same columns are fitted together."""
    out = np.empty((len(units), max_k))
    order = sorted(range(len(units)), key=lambda i: (units[i].shape[1], len(units[i])))
    while order:
        first = units[order[0]]
        alike = [i for i in order if units[i].shape[1] == first.shape[1] and len(units[i]) <= 1.25 * len(first)]
        order = order[len(alike) :]
        same, d = [units[i] for i in alike], first.shape[1]
        n = np.array([len(x) for x in same])
        for k in range(1, max_k + 1):
            fit = np.array([group_kernels.one_part(x) for x in same]) if k == 1 else group_kernels.log_likelihoods(same, k)
            out[alike, k - 1] = -2 * fit + (k - 1 + k * d + k * d * (d + 1) / 2) * np.log(n)
    return out


def structure(df: DataFrame, group: str, features: Sequence[str], max_k: int = 3, neighbours: int = 5, most_dims: int = 10, together: int = 16384) -> DataFrame:
    """Per group: largest dip over at most three local components and its p value, the same of the distances to the centroid (features in
    z-scores over all rows), the gain in BIC of the best mixture of 2..max_k on the local components that hold 95 % of the variance
    (`most_dims` at most), its size, kNN entropy.

    A group is an individual: it is one unit of this operator, whose rows have to be seen together. Small groups
    are worked `together` rows at a time, which changes no result.
    """
    features = list(features)
    of_all = df.agg(*[a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    middle, scale = (np.array([of_all[f"{k}_{f}"] or 0.0 for f in features], dtype=float) for k in "ms")

    def several(groups: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        series, local, entropy = [], [], []
        for _, x in groups:
            spread = x.std(axis=0)
            z = (x - x.mean(axis=0)) / np.where(spread == 0, 1, spread)
            u, s, _ = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
            share = np.cumsum(s * s) / max((s * s).sum(), 1e-300)
            coords = u * s
            whole = (x - middle) / np.where(scale == 0, 1, scale)
            series.append([*coords.T[:3], np.linalg.norm(whole - whole.mean(axis=0), axis=1)])
            local.append(coords[:, : int(min(np.searchsorted(share, 0.95) + 1, most_dims, len(s)))])
            entropy.append(knn_entropy(z, neighbours))
        n = [len(x) for _, x in groups]
        found = iter(group_kernels.dips([s for own in series for s in own]).tolist())
        dips = [[next(found) for _ in own] for own in series]
        gain, size = np.full(len(groups), math.nan), np.ones(len(groups), dtype=np.int64)
        fitted = [i for i in range(len(groups)) if n[i] > 3 * max_k] if max_k > 1 else []
        if fitted:
            scores = _mixture_bics([local[i] for i in fitted], max_k)
            gain[fitted], size[fitted] = scores[:, 0] - scores[:, 1:].min(axis=1), scores.argmin(axis=1) + 1
        p = lambda values: [dip_p_value(v, m) for v, m in zip(values, n, strict=True)]
        most, apart = [max(own[:-1]) for own in dips], [own[-1] for own in dips]
        columns = {"n": n, "dip": most, "dip_p": p(most), "distance_dip": apart, "distance_dip_p": p(apart), "delta_bic": gain, "best_k": size, "knn_entropy": entropy}
        return pa.RecordBatch.from_pydict({group: pa.concat_arrays([k for k, _ in groups])} | {c: pa.array(v, pa.int64() if c in ("n", "best_k") else pa.float64()) for c, v in columns.items()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(several, _together(_large_enough_groups(batches, group, features), together))

    kind = df.schema[group].dataType.simpleString()
    rows = df.where(F.col(group).isNotNull()).select(group, *[F.col(f).cast("double").alias(f) for f in features])
    dealt = rows.repartition(F.col(group)).sortWithinPartitions(group)
    return dealt.mapInArrow(work, f"{group} {kind}, n long, dip double, dip_p double, distance_dip double, distance_dip_p double, delta_bic double, best_k long, knn_entropy double")
