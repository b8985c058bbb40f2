"""Aggregates that respect the replication hierarchy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nested(df: DataFrame, values: Sequence[str], hierarchy: Sequence[str], group: Sequence[str] = (), agg: Callable[[Column], Column] = F.avg) -> DataFrame:
    """Aggregate at the finest level, then level by level to the group, so each unit has one vote.

    hierarchy runs from coarse to fine. Rows with a null level are dropped unless all are null;
    ids of the finest level are expected to be unique below their group, as the path is kept.
    """
    kept = df.dropna(subset=list(hierarchy)) if hierarchy else df
    for depth in range(len(hierarchy), -1, -1):
        kept = kept.groupBy(*group, *hierarchy[:depth]).agg(*[agg(F.col(v)).alias(v) for v in values])
    return kept


def group_means(df: DataFrame, values: Sequence[str], group: Sequence[str], hierarchy: Sequence[str] = ()) -> DataFrame:
    return nested(df, values, hierarchy, group) if hierarchy else df.groupBy(*group).agg(*[F.avg(v).alias(v) for v in values])


def individuals_to_group(df: DataFrame, group: str, metrics: Sequence[str], count: str) -> DataFrame:
    """Per group over individuals: their number, the sum of count, and median, sample SD and quartiles of each metric."""
    aggs = [F.count(F.lit(1)).alias("n_individuals"), F.sum(count).alias(f"sum_{count}")]
    for m in metrics:
        aggs += [
            F.median(m).alias(f"{m}_median"), F.stddev_samp(m).alias(f"{m}_std"),
            F.percentile(m, 0.25).alias(f"{m}_q25"), F.percentile(m, 0.75).alias(f"{m}_q75"),
        ]
    return df.groupBy(group).agg(*aggs)


def intensity_table(df: DataFrame, sample: str, channels: Sequence[str], statistic: str = "mean") -> DataFrame:
    """Long table sample, channel, value, sd (population), over finite values."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    long = df.select(
        F.col(sample).cast("string").alias("sample"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), finite(F.col(c).cast("double")).alias("v")) for c in channels])).alias("x"),
    ).select("sample", "x.*")
    value = F.avg("v") if statistic == "mean" else F.median("v")
    return long.groupBy("sample", "channel").agg(value.alias("value"), F.stddev_pop("v").alias("sd"))


def share_table(df: DataFrame, subject: str, label: str, labels: Sequence) -> DataFrame:
    """Percent of each subject's rows by label, 0 where absent."""
    total = F.count(F.lit(1))
    return df.groupBy(subject).agg(*[(100 * F.count(F.when(F.col(label) == v, 1)) / total).alias(f"pct_{v}") for v in labels])


def subject_summary(df: DataFrame, subject: str, columns: Sequence[str]) -> DataFrame:
    """Distinct texts of each column joined by " / "; none reads as a dash."""
    text = lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), " / ")
    return df.groupBy(subject).agg(*[F.when(text(c) == "", "—").otherwise(text(c)).alias(c) for c in columns])


def mode(df: DataFrame, group: str, label: str) -> DataFrame:
    """Most frequent non-null label, the smallest of ties."""
    return df.groupBy(group).agg(F.mode(F.col(label).cast("string"), deterministic=True).alias("mode"))


def nested_weights(df: DataFrame, hierarchy: Sequence[str], name: str = "weight") -> DataFrame:
    """df with a weight by which every unit of a level counts alike below its parent; weights sum to 1.

    Units are counted by grouping and come to the rows by a join, so nothing but df's own columns
    is shuffled. Null is a unit of its own, but counts as no child of its parent.
    """
    own = [f"_h{k}" for k in range(len(hierarchy))]
    units = df.groupBy(*[F.col(h).alias(o) for h, o in zip(hierarchy, own, strict=True)]).agg(F.count(F.lit(1)).alias("_rows"))
    weight, made = 1.0 / F.col("_rows"), units
    for depth, child in enumerate(own):
        below = units.select(*own[: depth + 1]).distinct().groupBy(*[F.col(o).alias(f"{o}_") for o in own[:depth]]).agg(F.count(child).alias(f"_n{depth}"))
        made = made.join(below, _alike([(F.col(o), F.col(f"{o}_")) for o in own[:depth]])).drop(*[f"{o}_" for o in own[:depth]])
        weight = weight / F.col(f"_n{depth}")
    weights = made.select(*own, weight.alias("_w"))
    joined = df.drop(name).join(weights, _alike([(df[h], F.col(o)) for h, o in zip(hierarchy, own, strict=True)]))
    return joined.withColumnRenamed("_w", name).drop(*own)


def _alike(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Whether both sides of every pair are equal, nulls included."""
    same = F.lit(True)
    for a, b in pairs:
        same = same & a.eqNullSafe(b)
    return same


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def r_mad(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """1.4826 times the median absolute deviation."""
    w = Window.partitionBy(*group)
    dev = df.withColumn("_m", F.median(column).over(w)).withColumn("_d", F.abs(F.col(column) - F.col("_m")))
    return dev.groupBy(*group).agg((1.4826 * F.median("_d")).alias("mad"))
