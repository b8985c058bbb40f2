"""Scalar expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

COFACTOR = 150.0


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def asinh(c: Column) -> Column:
    """The inverse hyperbolic sine by the value's size: Spark's own loses digits below zero, and all of them at -1e8."""
    return F.when(c < 0, -F.asinh(-c)).otherwise(F.asinh(c))


def arcsinh(c: Column, cofactor: float = COFACTOR) -> Column:
    return asinh(c / F.lit(cofactor))


def display(c: Column, scale: str, cofactor: float = 250.0) -> Column:
    """A value on a display axis: log (values under 1 count as 1), biex (asinh) or lin."""
    return {"log": lambda: F.log10(F.greatest(c, F.lit(1.0))), "biex": lambda: asinh(c / F.lit(cofactor)), "lin": lambda: c}[scale]()


def rank_biserial(u: Column, n1: Column, n2: Column) -> Column:
    """Positive when the first group tends to be smaller."""
    return 1 - 2 * u / (n1 * n2)


def epsilon_squared(h: Column, n: Column) -> Column:
    return h / (n - 1)


def effect_label(effect: Column, metric: str) -> Column:
    small, medium, large = (0.1, 0.3, 0.5) if metric == "r" else (0.01, 0.06, 0.14)
    size = F.abs(effect)
    return (
        F.when(effect.isNull() | F.isnan(effect), "unknown")
        .when(size < small, "negligible")
        .when(size < medium, "small")
        .when(size < large, "medium")
        .otherwise("large")
    )


def recode(c: Column, groups: Mapping[str, Sequence], other: str = "Other") -> Column:
    """The label whose values hold c's text; nulls and all else become `other`. A value under two labels goes to the last."""
    table = {str(v): label for label, values in groups.items() for v in values}
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c.cast("string")], F.lit(other)) if pairs else F.lit(other)


def split_at(c: Column, threshold: float, labels: tuple[str, str] | None = None) -> Column:
    """Below the threshold, or from it on; null stays null."""
    low, high = labels or (f"Low (< {threshold:.1f})", f"High (≥ {threshold:.1f})")
    v = nan_to_null(c.cast("double"))
    return F.when(v < threshold, low).when(v >= threshold, high)


def joined_label(*columns: Column) -> Column:
    """One grouping label from several columns; a null reads nan."""
    return F.concat_ws(" / ", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in columns])


def in_polygon(x: Column, y: Column, vertices: Sequence[tuple[float | Column, float | Column]]) -> Column:
    """Even-odd rule over literal vertices."""
    crossings = F.lit(0)
    corners = [(F.lit(a), F.lit(b)) for a, b in vertices]
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        over = (y1 > y) != (y2 > y)  # never on a level edge, which has no slope
        crossings = crossings + (over & (x < x1 + (y - y1) * F.try_divide(x2 - x1, y2 - y1))).cast("int")
    return crossings % 2 == 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over the rows that have both, null where either has no spread there."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    scale = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.covar_pop(x, y) / F.when(scale > 0, scale)
