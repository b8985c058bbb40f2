"""Acquisition quality of flow cytometry files: flow rate, signal acquisition and dynamic range.

A file is one acquisition. Events are counted by time bin, ranked in time order and reduced to
medians of bins by DataFrame operations; only those series, some thousand numbers of a file, go
through an Arrow kernel. What the kernels call bad comes back by a join on (file, bin).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_sf

CHECKS = ("flow_rate", "signal_acquisition", "dynamic_range")
SIDES = ("both", "upper", "lower")
#: Makes a median absolute deviation a standard deviation for normal data.
MAD_SCALE = 1.4826
#: Scatter channels are not checked for their range.
SCATTER = "FSC|SSC"


# --- kernels on the series of one file -----------------------------------------------------------


def mad(x: np.ndarray) -> float:
    return MAD_SCALE * float(np.median(np.abs(x - np.median(x)))) if len(x) else math.nan


def cycle(series: np.ndarray, low: float = 2.0, high: float = 8.0) -> np.ndarray:
    """The part of a series with periods between low and high: its convolution with the ideal band-pass weights."""
    n = len(series)
    a, b = 2 * math.pi / high, 2 * math.pi / low
    lag = np.arange(1, n)
    half = (np.sin(lag * b) - np.sin(lag * a)) / (math.pi * lag)
    weights = np.concatenate([half[::-1], [(b - a) / math.pi], half])
    if n <= 4096:
        return np.convolve(series, weights)[n - 1 : 2 * n - 1]
    size = 1 << (3 * n).bit_length()
    return np.fft.irfft(np.fft.rfft(series, size) * np.fft.rfft(weights, size), size)[n - 1 : 2 * n - 1]


def _t_quantile(p: float, df: float, start: float) -> float:
    """Student's t quantile by Newton steps from a near value."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    x = start
    for _ in range(60):
        step = (t_sf(x, df) - (1 - p)) / (scale * (1 + x * x / df) ** (-(df + 1) / 2))
        x += max(-1.0, min(1.0, step))
        if abs(step) < 1e-12 * max(1.0, abs(x)):
            break
    return x


def rate_anomalies(counts: np.ndarray, alpha: float = 0.01, most: float = 0.49, decompose: bool = True) -> np.ndarray:
    """Positions of counts (of bins that aren't empty) that the generalised extreme studentised deviate test calls anomalous.

    With decompose the distance to the median count and the size of the cycle are tested together,
    signed by the side of the trend. The spread is that of the counts left.
    """
    x = np.asarray(counts, dtype=float)
    n = len(x)
    if decompose:
        middle, wave = math.trunc(np.median(x)) if n else 0, cycle(x) if n else x
        tested = np.trunc(np.abs(x - middle) + np.abs(wave)) * np.where(x - wave - middle < 0, -1.0, 1.0)
    else:
        tested = x - np.median(x) if n else x
    left, removed, hits, t = np.arange(n), [], 0, 3.0
    for i in range(1, math.trunc(n * most) + 1):
        spread = mad(x[left])
        if spread == 0:
            break
        score = np.abs(tested[left] - np.median(tested[left])) / spread
        at = int(score.argmax())
        removed.append(int(left[at]))
        left = np.delete(left, at)
        free = n - i - 1
        t = _t_quantile(1 - alpha / (2 * (n - i + 1)), free, t)
        if score[at] > t * (n - i) / math.sqrt((free + t * t) * (n - i + 1)):
            hits = i
    return np.array(sorted(removed[:hits]), dtype=int)


def changepoints(series: np.ndarray, penalty: float = 200.0, most: int = 3, least: int = 2) -> list[int]:
    """Binary segmentation for changes of mean or variance: the last place (from 1) of each stretch, the length at the end."""
    n = len(series)
    s1, s2 = np.concatenate([[0], np.cumsum(series)]), np.concatenate([[0], np.cumsum(np.square(series))])

    def cost(a, b) -> np.ndarray:
        m = b - a
        var = (s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / m) / m
        return m * (math.log(2 * math.pi) + np.log(np.where(var > 0, var, 1e-11)) + 1)

    cuts: list[int] = []
    while len(cuts) < most:
        best = (-math.inf, -1)
        for a, b in zip([0, *sorted(cuts)], [*sorted(cuts), n], strict=True):
            k = np.arange(a + least + 1, b - least)
            if len(k):
                gain = cost(np.array(a), np.array(b)) - cost(a, k) - cost(k, b)
                if gain.max() > best[0]:
                    best = (float(gain.max()), int(k[gain.argmax()]))
        if best[0] < penalty:  # later gains count no more than this one
            break
        cuts.append(best[1])
    return [*sorted(cuts), n]


def stable_stretch(medians: np.ndarray, penalty: float, most: int, least: int) -> tuple[int, int]:
    """First and last bin (from 1) of the longest stretch without a change in any column; of equal ones, from the first to the start of the second."""
    ends = {1}
    for column in medians.T:
        ends |= set(changepoints(column, penalty, most, least))
    places = np.array(sorted(ends))
    if len(places) == 1:
        return 1, len(medians)
    gaps = np.diff(places)
    longest = np.flatnonzero(gaps == gaps.max())
    return tuple(int(v) for v in np.concatenate([places[longest], places[longest + 1]])[:2])  # type: ignore[return-value]


# --- tables ----------------------------------------------------------------------------------------


def cut_at_range(df: DataFrame, ranges: Mapping[str, float | None]) -> DataFrame:
    """df with values cut at the top of their channel's range (range - 1)."""
    return df.withColumns({c: F.least(F.col(c).cast("double"), F.lit(float(top - 1))) for c, top in ranges.items() if top is not None})


def rate_bin(time: Column, step: float, fraction: float) -> Column:
    """Number (from 1) of an event's time bin of `fraction` seconds, closed on the right; `step` is the seconds of a time unit."""
    return F.greatest(F.ceil(time / F.lit(fraction / step)), F.lit(1)).cast("long")


def rate_counts(df: DataFrame, file: str, time: str, step: float = 0.01, fraction: float = 0.1) -> DataFrame:
    """Rows (file, bin, n): events by time bin, empty bins left out."""
    return df.groupBy(file, rate_bin(F.col(time), step, fraction).alias("bin")).agg(F.count("*").alias("n"))


def time_resets(df: DataFrame, file: str, time: str, order: str) -> DataFrame:
    """Rows (file, resets): how often the time of an event lies before that of the one recorded before it."""
    before = F.lag(time).over(Window.partitionBy(file).orderBy(order))
    return df.select(file, (F.col(time) < before).alias("back")).groupBy(file).agg(F.count_if(F.coalesce("back", F.lit(False))).alias("resets"))


def lower_limits(df: DataFrame, file: str, channels: Sequence[str], mads: float = 3.5) -> DataFrame:
    """A row per file with the lower outlier limit of each channel's negative values, null where there are none; two aggregations for all channels."""
    below = lambda c: F.when(F.col(c) < 0, F.col(c))
    middle = df.groupBy(file).agg(*[F.median(below(c)).alias(f"{c}__m") for c in channels])
    apart = df.join(middle, file).groupBy(file).agg(
        *[F.first(f"{c}__m").alias(f"{c}__m") for c in channels], *[F.median(F.abs(below(c) - F.col(f"{c}__m"))).alias(f"{c}__d") for c in channels]
    )
    return apart.select(file, *[(F.col(f"{c}__m") - mads * MAD_SCALE * F.col(f"{c}__d") / 0.6745).alias(f"{c}__low") for c in channels])


def dynamic_range(df: DataFrame, file: str, channels: Sequence[str], tops: Mapping[str, float | None], side: str = "both", mads: float = 3.5) -> DataFrame:
    """df with range_ok: no checked channel at or above its top, or at or below the lower outlier limit of its file's negative values."""
    if side not in SIDES:
        raise ValueError(f"side must be one of {SIDES}")
    checked = [c for c in channels if not any(s in c for s in SCATTER.split("|"))]
    bad = F.lit(False)
    if side != "lower":
        for c in checked:
            if tops.get(c) is not None:
                bad = bad | (F.col(c) >= F.lit(float(tops[c])))  # type: ignore[arg-type]
    if side == "upper" or not checked:
        return df.withColumn("range_ok", ~F.coalesce(bad, F.lit(False)))
    for c in checked:
        bad = bad | F.coalesce(F.col(c) <= F.col(f"{c}__low"), F.lit(False))
    return df.join(lower_limits(df, file, checked, mads), file, "left").withColumn("range_ok", ~F.coalesce(bad, F.lit(False))).drop(*[f"{c}__low" for c in checked])


def flow_quality(
    df: DataFrame,
    file: str,
    time: str,
    order: str,
    channels: Sequence[str],
    ranges: Mapping[str, float | None] | None = None,
    checks: Sequence[str] = CHECKS,
    step: float = 0.01,
    fraction: float = 0.1,
    alpha: float = 0.01,
    decompose: bool = True,
    penalty: float = 200.0,
    most: int = 3,
    least: int = 2,
    side: str = "both",
    plugin_order: bool = False,
) -> DataFrame:
    """df with rate_ok, signal_ok, range_ok and quality_ok, true for events that pass; a check that isn't asked for passes all.

    `order` numbers the events of a file as recorded, without repeats. Values and times are cut at
    range - 1 for the checks, not in the result. With plugin_order event i of a file gets what the
    i-th event in time order would: another labelling only where time goes back.
    """
    if unknown := set(checks) - set(CHECKS):
        raise ValueError(f"unknown checks {sorted(unknown)}; there are {CHECKS}")
    if side not in SIDES:
        raise ValueError(f"side must be one of {SIDES}")
    channels, ranges = list(channels), dict(ranges or {})
    cut = cut_at_range(df.select(file, order, time, *channels), {c: ranges.get(c) for c in (time, *channels)})
    of_file = Window.partitionBy(file)
    events = cut.withColumns({"_rank": F.row_number().over(of_file.orderBy(time, order)), "_n": F.count("*").over(of_file)})
    if "dynamic_range" in checks:
        events = dynamic_range(events, file, channels, {c: ranges[c] - 1 for c in channels if ranges.get(c) is not None}, side)  # type: ignore[operator]
    else:
        events = events.withColumn("range_ok", F.lit(True))
    kind = df.schema[file].dataType.simpleString()

    if "flow_rate" in checks:

        def anomalous(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bin")
            at = rate_anomalies(pdf["n"].to_numpy(), alpha, decompose=decompose)
            return pdf.iloc[at][[file, "bin"]].rename(columns={"bin": "_bin"})

        bad = rate_counts(events, file, time, step, fraction).groupBy(file).applyInPandas(anomalous, f"`{file}` {kind}, _bin long").withColumn("_bad", F.lit(True))
        events = events.withColumn("_bin", rate_bin(F.col(time), step, fraction)).join(bad, [file, "_bin"], "left").withColumn("rate_ok", F.col("_bad").isNull()).drop("_bin", "_bad")
    else:
        events = events.withColumn("rate_ok", F.lit(True))

    if "signal_acquisition" in checks:
        size = F.least(F.greatest(F.ceil(F.col("_n") / 100), F.lit(1)), F.lit(500))
        placed = events.withColumn("_bin", F.floor((F.col("_rank") - 1) / size) + 1)
        medians = placed.groupBy(file, "_bin").agg(*[F.median(c).alias(c) for c in channels])

        def stretch(pdf: pd.DataFrame) -> pd.DataFrame:
            first, last = stable_stretch(pdf.sort_values("_bin")[channels].to_numpy(dtype=float), penalty, most, least)
            return pd.DataFrame({file: pdf[file].iloc[:1], "_first": first, "_last": last})

        kept = medians.groupBy(file).applyInPandas(stretch, f"`{file}` {kind}, _first long, _last long")
        events = placed.join(kept, file, "left").withColumn("signal_ok", F.col("_bin").between(F.col("_first"), F.col("_last"))).drop("_bin", "_first", "_last")
    else:
        events = events.withColumn("signal_ok", F.lit(True))

    verdict = events.select(file, order, "_rank", "rate_ok", "signal_ok", "range_ok")
    if plugin_order:
        place = Window.partitionBy(file).orderBy(order)
        recorded = verdict.select(file, order, F.row_number().over(place).alias("_rank"))
        verdict = recorded.join(verdict.drop(order), [file, "_rank"])
    return df.join(verdict.drop("_rank"), [file, order]).withColumn("quality_ok", F.col("rate_ok") & F.col("signal_ok") & F.col("range_ok"))


def percent_removed(checked: DataFrame, file: str) -> DataFrame:
    """Per file: events, events kept, and the percentage that each check and all together remove."""
    share = lambda c: (100 * F.avg((~F.col(c)).cast("double"))).alias(c.replace("_ok", "_removed"))
    return checked.groupBy(file).agg(F.count("*").alias("events"), F.count_if("quality_ok").alias("kept"), *[share(c) for c in ("rate_ok", "signal_ok", "range_ok", "quality_ok")])
