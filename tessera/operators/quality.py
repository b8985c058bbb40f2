"""Acquisition quality: drift, gates and pairs of files."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_medians(df: DataFrame, subject: str, channel: str, time: str, windows: int = 20, least: int = 100) -> DataFrame:
    """Rows (subject, bucket, n, med): median log10 of the positive channel in equal time windows of each subject, the last one closed."""
    fine = df.where((F.col(channel) > 0) & F.col(time).isNotNull() & ~F.isnan(F.col(channel).cast("double")) & (F.col(channel) < float("inf")))
    w = Window.partitionBy(subject)
    span = fine.select(subject, F.col(channel).cast("double").alias("x"), F.col(time).cast("double").alias("t")).withColumns(
        {"t0": F.min("t").over(w), "t1": F.max("t").over(w)}
    )
    step = (F.col("t1") - F.col("t0")) / windows
    bucket = F.when(step > 0, F.least(F.floor((F.col("t") - F.col("t0")) / step), F.lit(windows - 1))).otherwise(0)
    got = span.groupBy(subject, bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.median(F.log10("x")).alias("med"))
    return got.where(F.col("n") >= least)


def drift(df: DataFrame, subject: str, channel: str, time: str, windows: int = 20, least: int = 100) -> DataFrame:
    """Per subject: windows used, end-to-end and full-range drift in log10 and as ratios; with fewer than two windows they are null."""
    med = window_medians(df, subject, channel, time, windows, least)
    got = med.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n_windows"), (F.max_by("med", "bucket") - F.min_by("med", "bucket")).alias("end"), (F.max("med") - F.min("med")).alias("rng")
    )
    everyone = df.select(subject).distinct().join(got, subject, "left")
    enough = F.col("n_windows") >= 2
    cols = {"end_to_end_log10": F.col("end"), "full_range_log10": F.col("rng"), "end_to_end_ratio": F.pow(F.lit(10.0), F.col("end")), "full_range_ratio": F.pow(F.lit(10.0), F.col("rng"))}
    return everyone.select(subject, F.coalesce("n_windows", F.lit(0)).alias("n_windows"), *[F.when(enough, c).alias(k) for k, c in cols.items()])


def effect_floor(drifts: DataFrame) -> DataFrame:
    known = drifts.where("full_range_ratio is not null")
    return known.agg(
        F.median("full_range_ratio").alias("median_ratio"), F.max("full_range_ratio").alias("max_ratio"), F.median(F.pow(F.lit(10.0), F.abs("end_to_end_log10"))).alias("median_end_ratio")
    )


def scatter_gate(channels: dict[str, float | None], least: float = 1.0) -> Column:
    """All scatter channels above `least` and below saturation (range - 1); a null range doesn't limit."""
    test = F.lit(True)
    for c, top in channels.items():
        test = test & (F.col(c) > least)
        if top is not None:
            test = test & (F.col(c) < top - 1)
    return test


def saturation(ranges: dict[str, float], scatter: Sequence[str], least: float = 1024.0) -> dict[str, float | None]:
    """Ranges of the scatter channels; an implausible one is replaced by the most common plausible range."""
    plausible = [r for r in ranges.values() if r == r and r >= least]
    common = max(sorted(set(plausible)), key=plausible.count) if plausible else None
    return {c: (ranges[c] if ranges.get(c, math.nan) == ranges.get(c) and ranges.get(c, 0) >= least else common) for c in scatter}


def stain_threshold(df: DataFrame, channel: str, quantile: float = 0.999) -> float:
    got = df.agg(F.percentile(channel, quantile).alias("q")).first()["q"]
    if got is None:
        raise ValueError("no unstained values")
    return got


def stain_alerts(unstained: DataFrame, stained: DataFrame, channel: str, cofactor: float = 250.0) -> DataFrame:
    """One row: threshold, tail spread of the unstained in display units, percent of stained above, and between q.99 and q.9999."""
    q = unstained.agg(F.percentile(channel, [0.99, 0.999, 0.9999]).alias("q")).first()["q"]
    spread = math.asinh(q[2] / cofactor) - math.asinh(q[0] / cofactor)
    above = lambda t: 100 * F.avg((F.col(channel) > t).cast("double"))
    return stained.agg(above(q[1]).alias("pct_positive"), (above(q[0]) - above(q[2])).alias("sensitivity_points")).select(
        F.lit(q[1]).alias("threshold"), F.lit(spread).alias("tail_spread"), "pct_positive", "sensitivity_points"
    )


def label_channel(passed: Column) -> Column:
    """2000 for events that pass, 6000 for the others."""
    return F.when(passed, 2000.0).otherwise(6000.0)


def best_pairs(names: DataFrame, stained: Column, ignore: Sequence[str] = ()) -> DataFrame:
    """Per stained file the unstained one with the longest common token prefix (two tokens at least); several: the first, flagged.

    Unstained files are counted by each of their prefixes, so stained ones meet prefixes, never all files that begin alike.
    """
    tokens = F.filter(F.split(F.regexp_replace("file", r"(?i)\.fcs$", ""), "_"), lambda t: ~t.isin(*ignore) if ignore else F.lit(True))
    lengths = F.when(F.size("t") >= 2, F.sequence(F.lit(2), F.size("t")))
    prefixes = F.transform(lengths, lambda n: F.struct(n.alias("n"), F.array_join(F.slice("t", F.lit(1), n), "_").alias("prefix")))  # a token has no _
    rows = names.groupBy("file", stained.alias("is_stained")).agg(F.count(F.lit(1)).alias("times")).withColumn("t", tokens)
    s = rows.where("is_stained").select(F.col("file").alias("stained_file"), "times", prefixes.alias("p"))
    u = rows.where("not is_stained").select("file", "times", F.explode(prefixes).alias("p")).select("file", "times", "p.*")
    first = u.groupBy("n", "prefix").agg(F.min("file").alias("unstained_file"), F.sum("times").alias("n_candidates"))
    met = s.select("stained_file", F.explode("p").alias("p")).select("stained_file", "p.*").join(first, ["n", "prefix"])
    best = met.groupBy("stained_file").agg(F.max(F.struct("n", "unstained_file", "n_candidates")).alias("best"))  # a file has one prefix of a length
    several = F.coalesce(F.col("best.n_candidates") * F.col("times") > 1, F.lit(False))
    return s.join(best, "stained_file", "left").select("stained_file", "best.unstained_file", F.col("best.n").alias("common_tokens"), several.alias("several"))
