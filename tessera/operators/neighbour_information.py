"""Mutual information of a number and a label from nearest neighbours, in one-dimensional sorted order.

For each row the radius reaches its k-th nearest row of the same label; the rows of any label within
it are counted. Values that repeat are one row with a count. Values are dealt to cells at
approximate quantiles; a cell gets the k values before and after it, whichever cells they lie in,
so results don't depend on where the cells end and no task orders a whole feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dataset import written
from .ordered import PARTS, TASK_ROWS, counts_below

EULER = 0.5772156649015329


def digamma(n: Column) -> Column:
    """Of whole numbers from 1."""
    small = [-EULER + sum(1 / j for j in range(1, k)) for k in range(1, 20)]
    x = n.cast("double")
    q = 1 / (x * x)
    series = F.log(x) - 0.5 / x - q * (F.lit(1 / 12) - q * (F.lit(1 / 120) - q / 252))
    return F.when(n < 20, F.get(F.array(*map(F.lit, small)), n.cast("int") - 1)).otherwise(series)


def _radii(values: DataFrame, k: int, parts: int) -> DataFrame:
    """values (feature, y, v, c) with r: the distance to the k-th nearest other row of the label (fewer, if the label has fewer)."""
    # up to `parts` cuts for each feature, of which there are few; joined, not collected
    cuts = values.groupBy("feature").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000))).alias("cuts"))
    dealt = written(values.join(cuts, "feature").withColumn("cell", F.size(F.filter("cuts", lambda e: e < F.col("v")))).drop("cuts"), "cells")
    pair = F.struct("v", "c")
    ends = dealt.groupBy("feature", "y", "cell").agg(F.array_sort(F.collect_list(pair)).alias("own"))
    ends = ends.select("feature", "y", "cell", F.slice("own", 1, k).alias("head"), F.reverse(F.slice(F.reverse("own"), 1, k)).alias("tail"))
    line = Window.partitionBy("feature", "y").orderBy("cell")  # a row per cell
    before = F.flatten(F.collect_list("tail").over(line.rowsBetween(-k, -1)))
    after = F.flatten(F.collect_list("head").over(line.rowsBetween(1, k)))
    carried = ends.select("feature", "y", "cell", F.reverse(F.slice(F.reverse(before), 1, k)).alias("before"), F.slice(after, 1, k).alias("after"))

    def radius(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("v")
        beside = [[(p["v"], p["c"]) for p in edges[side].iloc[0]] for side in ("before", "after")]
        v = np.concatenate([[p[0] for p in beside[0]], own["v"].to_numpy(), [p[0] for p in beside[1]]]).astype(float)
        c = np.concatenate([[p[1] for p in beside[0]], own["c"].to_numpy(), [p[1] for p in beside[1]]]).astype(int)
        copies = np.minimum(c, k + 1)  # more are never needed
        z = np.repeat(v, copies)
        at = (np.cumsum(copies) - copies)[len(beside[0]) : len(beside[0]) + len(own)]
        near = min(k, len(z) - 1)
        padded = np.concatenate([np.full(near, -np.inf), z, np.full(near, np.inf)])
        r = np.full(len(own), np.inf)
        for j in range(near + 1):  # all stretches of near + 1 rows that hold the row
            low, high = padded[at + near - j], padded[at + 2 * near - j]
            r = np.minimum(r, np.maximum(z[at] - low, high - z[at]))
        return own[["feature", "y", "v", "c"]].assign(r=r)

    keys = ["feature", "y", "cell"]
    return dealt.groupBy(*keys).cogroup(carried.groupBy(*keys)).applyInPandas(radius, "feature string, y string, v double, c long, r double")


def neighbour_information(df: DataFrame, features: Sequence[str], label: str, k: int = 3, task_rows: int = TASK_ROWS, parts: int = PARTS) -> DataFrame:
    """Rows (feature, mi): Ross's estimate in nats, 0 at least.

    Where values repeat, the rows within the radius count in place of k, and none is moved at
    random. Rows with a missing label or value, and labels of a single row, are left out of a
    feature; a feature without rows has no row here.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("y"), F.explode(pairs).alias("p")).select("y", "p.feature", (F.col("p.v") + F.lit(0.0)).alias("v"))
    counts = long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("feature", "y", "v").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("feature", "y").agg(F.sum("c").alias("ny")).where("ny > 1")
    values = written(counts.join(sizes.select("feature", "y"), ["feature", "y"]), "values")
    radii = written(_radii(values, k, parts), "radii")
    # a little wider than the radius, which is a rounded difference
    wide = F.col("r") + 4 * 2.0**-52 * (F.col("r") + F.abs("v"))
    asked = written(radii.select("*", (F.col("v") - wide).alias("low"), (F.col("v") + wide).alias("high")), "asked")

    def within(amounts: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        """asked with `name`: the rows of amounts (by..., v, c) between low and high, less the row itself."""
        group = F.concat_ws("\x1f", *by)
        points = amounts.select(group.alias("g"), "v", "c")
        for end in ("low", "high"):
            points = points.unionByName(asked.select(group.alias("g"), F.col(end).alias("v"), F.lit(0).cast("long").alias("c")))
        below = written(counts_below(points.groupBy("g", "v").agg(F.sum("c").alias("c")), "g", "v", "c", "b", task_rows, parts), "below")
        keyed = asked.withColumn("g", group)
        low = below.select("g", F.col("v").alias("low"), F.col("b").alias("_low"))
        high = below.select("g", F.col("v").alias("high"), (F.col("b") + F.col("c")).alias("_high"))
        got = keyed.join(low, ["g", "low"]).join(high, ["g", "high"])
        return got.select("feature", "y", "v", "c", (F.col("_high") - F.col("_low") - 1).alias(name))

    everyone = values.groupBy("feature", "v").agg(F.sum("c").alias("c"))
    own = within(values, ["feature", "y"], "k")
    met = within(everyone, ["feature"], "m").join(own, ["feature", "y", "v", "c"]).join(sizes, ["feature", "y"])
    mean = lambda c: F.sum(F.col("c") * digamma(F.col(c))) / F.sum("c")
    score = digamma(F.sum("c")) + mean("k") - mean("ny") - mean("m")
    return met.groupBy("feature").agg(F.greatest(score, F.lit(0.0)).alias("mi"))
