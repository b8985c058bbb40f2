"""Rank statistics with multiplicity correction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import effect_label, safe_corr
from ..functions.special import chi2_sf, normal_sf
from .ordered import counts_below


def average_ranks(by_value: DataFrame) -> DataFrame:
    """Rows (feature, value, t, rank): rank with ties averaged, from a row per distinct value that t rows have."""
    return counts_below(by_value, "feature", "value", "t").withColumn("rank", F.col("below") + (F.col("t") + 1) / 2).drop("below")


def benjamini_hochberg(p: str, by: Sequence[str] = ()) -> Column:
    """Step-up adjusted p over the non-null ones."""
    known = F.col(p).isNotNull()
    m = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by, known).orderBy(p))
    frame = Window.partitionBy(*by, known).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(known, F.least(F.lit(1.0), F.min(F.col(p) * m / rank).over(frame)))


def long_form(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.explode(pairs).alias("x"))
    return long.select("grp", "x.feature", F.when(~F.isnan("x.value"), F.col("x.value")).alias("value"))


def rank_sums(long: DataFrame) -> DataFrame:
    """Rows (feature, grp, n, rank_sum, ties): ties is the sum of t^3 - t over the feature's tied values.

    Counts per distinct value come first, so ranks are computed over values, not rows, and a
    value that a third of the rows has is one row.
    """
    known = long.where("value is not null")
    by_value = known.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("t"))
    ranked = average_ranks(by_value)
    ties = by_value.groupBy("feature").agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    per = known.groupBy("feature", "value", "grp").agg(F.count(F.lit(1)).alias("k"))
    sums = per.join(ranked, ["feature", "value"]).groupBy("feature", "grp").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("rank_sum"))
    return sums.join(ties, "feature")


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda x: min(1.0, 2 * normal_sf(x)), na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def _chi2_p(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for h, df in parts:
        yield pd.Series([float("nan") if x != x or x is None else chi2_sf(x, d) for x, d in zip(h, df, strict=True)], dtype="float64")


def compare_groups(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Per feature: Mann-Whitney U (two groups; two-sided, continuity-corrected) or Kruskal-Wallis H, effect size and label, p and BH p.

    U is that of the first group in sorted order. The effect of H divides by all labelled rows.
    """
    labels = sorted(r[0] for r in df.where(F.col(group).isNotNull()).select(F.col(group).cast("string")).distinct().collect())
    if len(labels) < 2:
        raise ValueError("at least two groups are needed")
    total = df.where(F.col(group).isNotNull()).count()
    sums = rank_sums(long_form(df, group, features))
    features_all = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    if len(labels) == 2:
        of = lambda name, k: F.max(F.when(F.col("grp") == labels[k], F.col(name)))
        wide = sums.groupBy("feature").agg(of("n", 0).alias("n1"), of("n", 1).alias("n2"), of("rank_sum", 0).alias("r1"), F.max("ties").alias("ties"))
        n = F.col("n1") + F.col("n2")
        u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
        mean = F.col("n1") * F.col("n2") / 2
        sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
        z = (F.abs(F.col("statistic") - mean) - 0.5) / sd
        out = wide.withColumn("statistic", u).withColumn("p", F.when(sd > 0, _normal_p(z)))
        out = out.withColumn("effect", 1 - 2 * F.col("statistic") / (F.col("n1") * F.col("n2")))
        metric = "r"
    else:
        wide = sums.groupBy("feature").agg(
            F.sum("n").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k"), F.max("ties").alias("ties")
        )
        h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)
        correction = 1 - F.col("ties") / (F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n"))
        out = wide.withColumn("statistic", F.when((F.col("k") == len(labels)) & (correction > 0), h / correction))
        out = out.withColumn("p", F.when(F.col("statistic").isNotNull(), _chi2_p("statistic", F.lit(float(len(labels) - 1)))))
        out = out.withColumn("effect", F.col("statistic") / (total - 1))
        metric = "eta"
    full = features_all.join(out, "feature", "left").select("feature", "statistic", "effect", "p")
    full = full.withColumn("effect_label", effect_label(F.col("effect"), metric)).withColumn("p_adjusted", benjamini_hochberg("p"))
    return full.orderBy(F.col("p_adjusted").asc_nulls_last(), "feature")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation of two columns, the latter from counts of distinct pairs."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    pairs = known.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    both = pairs.select("c", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in ("x", "y")])).alias("v"))
    rank = average_ranks(both.groupBy("v.feature", "v.value").agg(F.sum("c").alias("t")))
    side = lambda n: rank.where(F.col("feature") == n).select(F.col("value").alias(n), F.col("rank").alias(f"r{n}"))
    centre = (known.count() + 1) / 2
    dx, dy, c = F.col("rx") - centre, F.col("ry") - centre, F.col("c")
    sums = pairs.join(side("x"), "x").join(side("y"), "y").agg(F.sum(c * dx * dy).alias("xy"), F.sum(c * dx * dx).alias("xx"), F.sum(c * dy * dy).alias("yy"))
    scale = F.sqrt(F.col("xx") * F.col("yy"))
    return known.agg(safe_corr("x", "y").alias("pearson")).join(sums.select(F.when(scale > 0, F.col("xy") / scale).alias("spearman")))  # one row each


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve from average ranks over distinct scores; null if one class is absent."""
    long = df.select(F.col(label).cast("string").alias("grp"), F.lit("s").alias("feature"), F.col(score).cast("double").alias("value"))
    sums = rank_sums(long)
    of = lambda name, k: F.max(F.when(F.col("grp") == k, F.col(name)))
    wide = sums.agg(of("n", "1").alias("n1"), of("n", "0").alias("n0"), of("rank_sum", "1").alias("r1"))
    return wide.select(((F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))
