"""The tables behind figures: profiles, curves, histograms and centroids, one aggregation each."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .aggregates import nested
from .ordered import quantile

# Colours of conditions, and the palette for all others.
PREFERRED = {"Young": "#1f77b4", "Old": "#d62728", "IF": "#2ca02c", "AL": "#ff7f0e"}
PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")


def _centre(aggregate: str):
    if aggregate not in ("mean", "median"):
        raise ValueError("aggregate must be mean or median")
    return F.avg if aggregate == "mean" else F.median


def profile(df: DataFrame, group: str, features: Sequence[str], aggregate: str = "mean", nest: Sequence[str] = (), overall: bool = False) -> DataFrame:
    """Rows (group, feature, value): each group's centre, pooled or nested (means of means along `nest`); with overall also that of all rows, under a null group."""
    centre = _centre(aggregate)
    wide = nested(df, features, nest, [group], centre) if nest else df.groupBy(group).agg(*[centre(f).alias(f) for f in features])
    if overall:
        wide = wide.select(group, *features).unionByName(df.agg(*[centre(f).alias(f) for f in features]).withColumn(group, F.lit(None).cast(df.schema[group].dataType)))
    return wide.select(group, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select(group, "x.*")


def time_curve(df: DataFrame, x: str, features: Sequence[str], group: str | None = None, aggregate: str = "mean", order: Sequence[str] | None = None) -> DataFrame:
    """Rows (x, group, feature, centre, sd, n, place): centre and sample standard deviation at each x; place is x's in `order` (values not in it are left out) or in natural order."""
    centre = _centre(aggregate)
    known = df.where(F.col(x).isNotNull())
    if order is not None:
        known = known.where(F.col(x).cast("string").isin(*order))
    keys = [x, *([group] if group else [])]
    long = known.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("m")).select(*keys, "m.*")
    got = long.groupBy(*keys, "feature").agg(centre("v").alias("centre"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n"))
    return got.join(resolve_order(got, x, order), x)


def resolve_order(df: DataFrame, x: str, order: Sequence[str] | None = None) -> DataFrame:
    """Rows (x, place) of the values that occur: place in `order`, or by number in the label, then label."""
    values = df.select(x).distinct()
    if order is not None:
        return values.select(x, F.array_position(F.array(*[F.lit(o) for o in order]), F.col(x).cast("string")).cast("int").alias("place"))
    from ..functions.tokens import natural_order

    number, label = natural_order(F.col(x).cast("string"))
    return values.select(x, F.row_number().over(Window.orderBy(number, label)).alias("place"))  # a row per category


def histogram(df: DataFrame, group: str, feature: str, bins: int = 10) -> DataFrame:
    """Rows (group, bin, density): equal bins over each group's range, the last one closed; a group of one value has one bin."""
    span = df.where(F.col(feature).isNotNull()).groupBy(group).agg(F.min(feature).alias("_a"), F.max(feature).alias("_b"), F.count("*").alias("_n"))
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(feature) - F.col("_a")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = df.where(F.col(feature).isNotNull()).join(span, group).groupBy(group, at.alias("bin"), "_n", width.alias("_w")).agg(F.count("*").alias("n"))
    return counted.select(group, "bin", (F.col("n") / (F.col("_n") * F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0))).alias("density"))


def feature_vs_target(df: DataFrame, group: str, subject: str, feature: str, target: str) -> DataFrame:
    """Per group the line through subjects' (target, median of feature): slope, intercept, n."""
    per = df.groupBy(group, subject).agg(F.median(feature).alias("_y"), F.first(target).alias("_x"))
    return per.groupBy(group).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_count("_y", "_x").alias("n"))


def centroids(projected: DataFrame, group: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Per group (and time, if it is one of them): rows and the mean of each axis."""
    return projected.groupBy(*group).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in axes])


def clamp_lower(value: Column, error: Column, least: Column) -> Column:
    """The error arm, shortened so that value - arm stays at a tenth of the least positive value."""
    return F.least(error, F.greatest(value - least / 10, F.lit(0.0)))


def palette(values: Sequence[str], existing: Mapping[str, str] | None = None) -> dict[str, str]:
    """A colour for each value: the one it has, else the preferred one, else the next of the palette; the same again for the same values."""
    out, taken = dict(existing or {}), 0
    for v in sorted(set(values), key=str):
        if v not in out:
            if v in PREFERRED:
                out[v] = PREFERRED[v]
            else:
                out[v], taken = PALETTE[taken % len(PALETTE)], taken + 1
    return out


def young_and_old(labels: Sequence[str]) -> tuple[str | None, str | None]:
    """How the labels spell young and old."""
    find = lambda word: next((v for v in sorted({str(x) for x in labels}) if word in v.lower()), None)
    return find("young"), find("old")


def map_key(neighbours: int, distance: float, components: int | None = None) -> str:
    """Name of a neighbour map by its parameters."""
    return f"X_umap_{'' if components is None else f'pca{components}_'}n{neighbours}_d{distance}"


def head_and_tail(df: DataFrame, order: Sequence[str], n: int = 5) -> tuple[DataFrame, DataFrame]:
    """The first and the last n rows in an order."""
    return df.orderBy(*order).limit(n), df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def distance_rings(projected: DataFrame, group: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Rows (group..., n, axes, radius, inside_1, inside_2): centroid of each group, and the shares of its rows within once and twice the radius.

    The radius is the median distance of all rows from the origin, the same in every row. Rows
    without a value on an axis are left out; a billionth beyond a ring counts as within it, so that
    rounding doesn't part rows of equal distance.
    """
    far = F.sqrt(sum((F.col(a).cast("double") * F.col(a) for a in axes), F.lit(0.0)))
    known = projected.dropna(subset=list(axes)).withColumn("_far", far)
    radius = quantile(known, "_far", 0.5)
    inside = [F.avg((F.col("_far") <= F.lit(radius).cast("double") * (k * (1 + 1e-9))).cast("double")).alias(f"inside_{k}") for k in (1, 2)]
    return known.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in axes], F.lit(radius).cast("double").alias("radius"), *inside)


def shown_features(df: DataFrame, features: Sequence[str] | None = None, leave_out: Sequence[str] = ()) -> list[str]:
    """The features asked for, which must be columns; None: all numeric columns but those to leave out."""
    if features is None:
        return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in leave_out]
    if absent := [f for f in features if f not in df.columns]:
        raise ValueError(f"no such features: {absent}")
    return list(features)


def category_blocks(features: Sequence[str], categories: Mapping[str, str], order: Sequence[str]) -> list[str]:
    """The features with those of a category together, categories in their order; what has none comes last, with a warning."""
    if unknown := [f for f in features if categories.get(f) not in order]:
        warnings.warn(f"features without a category: {unknown}", stacklevel=2)
    place = {c: k for k, c in enumerate(order)}
    return sorted(features, key=lambda f: place.get(categories.get(f), len(place)))
