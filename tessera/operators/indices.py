"""Runs of the heterogeneity indices: all of them by individual, on every row, between groups, and their tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import natural_order
from . import heterogeneity
from .significance import average_ranks, subject_tests, two_groups

METRICS = ("dispersion", "structure", "entropy")


def join_metrics(parts: Sequence[DataFrame], individual: str) -> DataFrame:
    """Metric tables of one row per individual as one table: a full outer join, so nobody is lost; columns of a name that occurs again are taken from the first."""
    out = parts[0]
    for more in parts[1:]:
        fresh = [c for c in more.columns if c not in out.columns]
        out = out.join(more.select(individual, *fresh), individual, "full")
    return out


def compute_all(df: DataFrame, individual: str, features: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """A row per individual of enough rows with the chosen indices."""
    if unknown := set(metrics) - set(METRICS):
        raise ValueError(f"unknown metrics {sorted(unknown)}; there are {METRICS}")
    made = {"dispersion": heterogeneity.dispersion, "structure": heterogeneity.structure, "entropy": heterogeneity.binned_entropy}
    return join_metrics([made[m](df, individual, features) for m in METRICS if m in metrics], individual)


def on_rows(df: DataFrame, results: DataFrame, individual: str) -> DataFrame:
    """df with the indices of each row's individual, null where there are none; columns of these names are replaced."""
    return df.drop(*[c for c in results.columns if c != individual]).join(results, individual, "left")


def of_groups(results: DataFrame, df: DataFrame, individual: str, group: str) -> DataFrame:
    """results with the group of each individual (the first in order, if it has several)."""
    return results.join(df.groupBy(individual).agg(F.min(group).alias(group)), individual, "left")


def run_tests(results: DataFrame, group: str, metrics: Sequence[str], permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """Kruskal-Wallis, permutation and pairwise tests of each metric between groups; results has a row per individual."""
    return subject_tests(results.where(F.col(group).isNotNull()), group, metrics, None, permutations, seed)


def run_age_tests(results: DataFrame, species: str, age: str, metrics: Sequence[str], permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """Per species and metric: Mann-Whitney U between the first two age groups in natural order, its p value, and the share of permutations with U as large.

    Species with one age group are left out. The permutation test is one-sided, in the direction of
    U of the first group. A group here is the individuals of a species, a row each.
    """
    number, label = natural_order(F.col(age))
    ages = results.where(f"`{species}` is not null and `{age}` is not null").select(species, age).distinct()
    place = F.row_number().over(Window.partitionBy(species).orderBy(number, label))
    two = ages.withColumn("place", place).where("place <= 2").withColumn("n_ages", F.count("*").over(Window.partitionBy(species))).where("n_ages = 2")
    long = results.join(two.select(species, age, "place"), [species, age]).select(
        F.col(species).cast("string").alias("species"), "place", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")
    )

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf.loc[(pdf["place"] == k) & pdf["v"].notna(), "v"].sort_values().to_numpy() for k in (1, 2))
        row = {"species": pdf["species"].iloc[0], "metric": pdf["metric"].iloc[0], "n_first": len(a), "n_second": len(b), "u": None, "p": None, "perm_p": None}
        if len(a) and len(b):
            row["u"], row["p"] = two_groups(a, b)
            ranks, rng, least = average_ranks(np.concatenate([a, b])), np.random.default_rng(seed), len(a) * (len(a) + 1) / 2
            hits = sum((rng.permuted(np.tile(ranks, (n, 1)), axis=1)[:, : len(a)].sum(axis=1) - least >= row["u"] - 1e-9).sum() for n in [min(1000, permutations - k) for k in range(0, permutations, 1000)])
            row["perm_p"] = hits / permutations
        return pd.DataFrame([row])

    schema = "species string, metric string, n_first int, n_second int, u double, p double, perm_p double"
    return long.select("species", "place", "x.*").groupBy("species", "metric").applyInPandas(test, schema)


def group_distances(results: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """Rows (a, b, distance), a < b: Euclidean distance of groups' mean metrics, scaled to 0..1 over the groups; a missing mean counts as the groups' mean."""
    means = results.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(*[F.avg(m).alias(m) for m in metrics])
    every = Window.partitionBy()  # a row per group

    def scaled(m: str):
        x = F.coalesce(F.col(m), F.avg(m).over(every))
        low, high = F.min(m).over(every), F.max(m).over(every)
        return F.when(high > low, (x - low) / (high - low)).otherwise(0.0).alias(m)

    unit = means.select("g", *[scaled(m) for m in metrics])
    a, b = unit.toDF("a", *[f"{m}_a" for m in metrics]), unit.toDF("b", *[f"{m}_b" for m in metrics])
    apart = F.sqrt(sum((F.pow(F.col(f"{m}_a") - F.col(f"{m}_b"), 2) for m in metrics), F.lit(0.0)))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", apart.alias("distance"))


def group_profile(results: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """Per group: individuals, and mean and sample standard deviation of each metric."""
    cols = [a for m in metrics for a in (F.avg(m).alias(f"{m}__mean"), F.stddev_samp(m).alias(f"{m}__sd"))]
    return results.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_individuals"), *cols)


def summarize_absolute(absolute: DataFrame, dispersion: DataFrame, individual: str, reference: str | None = None, offset: str = "offset") -> DataFrame:
    """Both tables by individual, the largest offset first; the row of the reference label is left out."""
    joined = absolute.join(dispersion.select(individual, *[c for c in dispersion.columns if c not in absolute.columns]), individual)
    return (joined if reference is None else exclude_reference(joined, individual, reference)).orderBy(F.desc_nulls_last(offset), individual)


def exclude_reference(df: DataFrame, column: str, label: str) -> DataFrame:
    """Rows that aren't those of the made-up reference; nulls stay."""
    return df.where(~F.coalesce(F.col(column) == label, F.lit(False)))


def check_individual(columns: Mapping[str, str] | Sequence[str], individual: str | None) -> str:
    """The individual column; ValueError if there is none of that name."""
    found = individual or next((c for c in ("unique_subject_ID", "subject_ID") if c in columns), None)
    if found is None or found not in columns:
        raise ValueError(f"no individual column {individual or ''} among {list(columns)}")
    return found
