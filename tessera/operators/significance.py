"""Tests between groups of subjects: exact and permutation tests, pairwise comparisons."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, normal_sf, t_quantile
from .ranks import _normal_p, long_form, rank_sums


def dunn(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Rows (feature, a, b, z, p, p_adjusted): Dunn's comparison of mean ranks of each pair of groups, Bonferroni-adjusted over the pairs.

    Ranks come from counts per distinct value; what is joined in pairs is one row per group.
    """
    sums = rank_sums(long_form(df, group, features))
    side = lambda name: sums.select("feature", F.col("grp").alias(name), F.col("n").alias(f"n_{name}"), (F.col("rank_sum") / F.col("n")).alias(f"m_{name}"))
    totals = sums.groupBy("feature").agg(F.sum("n").cast("double").alias("n"), F.max("ties").alias("ties"), (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("pairs"))
    pairs = side("a").join(side("b"), "feature").where("a < b").join(totals, "feature")
    variance = (F.col("n") * (F.col("n") + 1) / 12 - F.col("ties") / (12 * (F.col("n") - 1))) * (1 / F.col("n_a") + 1 / F.col("n_b"))
    out = pairs.withColumn("z", F.when(variance > 0, (F.col("m_a") - F.col("m_b")) / F.sqrt(variance))).withColumn("p", _normal_p(F.abs("z")))
    return out.select("feature", "a", "b", "z", "p", F.least(F.lit(1.0), F.col("p") * F.col("pairs")).alias("p_adjusted"))


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def exact_u(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties, by counting rank sums."""
    ways = [[0] * (n1 * n2 + 1) for _ in range(n1 + 1)]  # ways[k][s]: k of the values seen so far, with U = s
    ways[0][0] = 1
    for j in range(n1 + n2):
        for k in range(min(n1, j + 1), 0, -1):
            step = j - (k - 1)  # values of the other group below this one
            if step <= n2:
                for s in range(n1 * n2, step - 1, -1):
                    ways[k][s] += ways[k - 1][s - step]
    high = max(u, n1 * n2 - u)
    return min(1.0, 2 * sum(ways[n1][math.ceil(high) :]) / math.comb(n1 + n2, n1))


def two_groups(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """U of a and its two-sided p: exact if one group has 8 or fewer and no values tie, else normal with continuity correction."""
    n1, n2 = len(a), len(b)
    both = np.concatenate([a, b])
    u = average_ranks(both)[:n1].sum() - n1 * (n1 + 1) / 2
    counts = np.unique(both, return_counts=True)[1].astype(float)
    if min(n1, n2) <= 8 and counts.max() == 1:
        return u, exact_u(u, n1, n2)
    n = n1 + n2
    variance = n1 * n2 / 12 * (n + 1 - (counts**3 - counts).sum() / (n * (n - 1)))
    return u, min(1.0, 2 * normal_sf((abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(variance))) if variance > 0 else math.nan


def kruskal(ranks: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """H of average ranks for each row of labels (values 0..k-1)."""
    n = len(ranks)
    labels = np.atleast_2d(labels)
    sums = np.stack([np.where(labels == j, ranks, 0.0).sum(axis=1) for j in range(k)], axis=1)
    sizes = np.stack([(labels == j).sum(axis=1) for j in range(k)], axis=1)
    counts = np.unique(ranks, return_counts=True)[1].astype(float)
    scale = 1 - (counts**3 - counts).sum() / (float(n) ** 3 - n)
    return (12 / (n * (n + 1)) * (sums**2 / sizes).sum(axis=1) - 3 * (n + 1)) / scale if scale > 0 else np.full(len(labels), math.nan)


def subject_tests(subjects: DataFrame, group: str, metrics: Sequence[str], by: str | None = None, permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """Rows (stratum, metric, n, groups, test, statistic, p, permutation_p, effect, p_min) from a table with a row per subject.

    Two groups: U of the first in sorted order, permutation p the share of shuffles with a U not
    below it (one-sided). More: H, and the share with an H not below it. p_min is the least p that
    shuffles can reach with these group sizes. Fewer than two groups, or a group of one: statistic
    null. One task per stratum and metric holds that metric's values, one per subject.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    stratum = F.col(by).cast("string") if by else F.lit("all")
    long = subjects.where(F.col(group).isNotNull()).select(stratum.alias("stratum"), F.col(group).cast("string").alias("grp"), F.explode(pairs).alias("x"))
    long = long.select("stratum", "grp", "x.metric", "x.value").where("value is not null and not isnan(value)")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["grp", "value"])
        names, labels = np.unique(pdf["grp"].to_numpy(dtype=str), return_inverse=True)
        x, k = pdf["value"].to_numpy(), len(names)
        sizes = np.bincount(labels, minlength=k)
        row = {"stratum": pdf["stratum"].iloc[0], "metric": pdf["metric"].iloc[0], "n": len(x), "groups": k, "test": "none", "statistic": None, "p": None, "permutation_p": None, "effect": None, "p_min": None}
        if k >= 2 and sizes.min() >= 2 and not np.allclose(x, x[0]):
            rank = average_ranks(x)
            n1 = int(sizes[0])
            stat = (lambda y: np.where(y == 0, rank, 0.0).sum(axis=1) - n1 * (n1 + 1) / 2) if k == 2 else (lambda y: kruskal(rank, y, k))
            seen = float(stat(labels[None])[0])
            rng, hits, step = np.random.default_rng(seed), 0, max(1, 2_000_000 // len(x))
            for a in range(0, permutations, step):
                many = rng.permuted(np.tile(labels, (min(step, permutations - a), 1)), axis=1)
                hits += int((stat(many) >= seen - 1e-9).sum())
            ways = math.lgamma(len(x) + 1) - sum(math.lgamma(s + 1) for s in sizes)
            p = two_groups(x[labels == 0], x[labels == 1])[1] if k == 2 else chi2_sf(seen, k - 1)
            effect = 1 - 2 * seen / (n1 * (len(x) - n1)) if k == 2 else seen / (len(x) - 1)
            row |= {"test": "U" if k == 2 else "H", "statistic": seen, "p": p, "permutation_p": hits / permutations, "effect": effect, "p_min": math.exp(-ways)}
        return pd.DataFrame([row])

    schema = "stratum string, metric string, n long, groups long, test string, statistic double, p double, permutation_p double, effect double, p_min double"
    return long.groupBy("stratum", "metric").applyInPandas(test, schema)


def pairwise(subjects: dict[str, np.ndarray]) -> list[tuple[str, str, float, float]]:
    """(a, b, U, Bonferroni-adjusted p) for each pair of groups."""
    pairs = list(itertools.combinations(sorted(subjects), 2))
    tests = [(a, b, *two_groups(subjects[a], subjects[b])) for a, b in pairs]
    return [(a, b, u, min(1.0, p * len(pairs))) for a, b, u, p in tests]


def regression_band(df: DataFrame, x: str, y: str, points: int = 50, level: float = 0.95) -> DataFrame:
    """Rows (i, x, fit, se, low, high): least-squares line on an even grid over x and the band of its mean; null below three rows or without spread."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = known.agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mean"), F.min(x).alias("a"), F.max(x).alias("b"),
    )
    free = at.first()["n"] - 2
    t = t_quantile(0.5 + level / 2, max(free, 1))
    grid = at.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("a") + F.col("i") * (F.col("b") - F.col("a")) / (points - 1))
    residual = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / max(free, 1)
    se = F.sqrt(residual * (1 / F.col("n") + F.pow(F.col("x") - F.col("mean"), 2.0) / F.col("sxx")))
    out = grid.select("i", "x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("fit"), F.when((F.col("n") > 2) & (F.col("sxx") > 0), se).alias("se"))
    return out.withColumns({"low": F.col("fit") - t * F.col("se"), "high": F.col("fit") + t * F.col("se")})
