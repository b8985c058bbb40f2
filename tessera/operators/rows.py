"""Filters, samples, bins: operators that choose or label rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dataset import written
from .ordered import first_rows, row_at, up_to


def matches(column: Column, values: Sequence) -> Column:
    """Equal to one of values; null or "" among them matches both null and ""."""
    plain = [v for v in values if v is not None and v != ""]
    test = F.coalesce(column.isin(*plain), F.lit(False)) if plain else F.lit(False)
    if len(plain) < len(values):
        test = test | column.isNull() | (column.cast("string") == "")
    return test


def subset(df: DataFrame, filters: Mapping[str, Sequence], strict: bool = True) -> DataFrame:
    """OR within a column, AND across columns; an unknown column raises, or is passed over if not strict."""
    missing = [c for c in filters if c not in df.columns]
    if missing and strict:
        raise KeyError(f"no such columns: {missing}")
    tests = [matches(F.col(c), v) for c, v in filters.items() if v and c in df.columns]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def by_value(column: Column, mode: str, low: float | None = None, high: float | None = None, inclusive: bool = True) -> Column:
    """between, below or above; null and NaN never match."""
    fine = column.isNotNull() & ~F.isnan(column.cast("double"))
    test = {
        "above": lambda: column >= low if inclusive else column > low,
        "below": lambda: column <= high if inclusive else column < high,
        "between": lambda: (column >= low) & (column <= high) if inclusive else (column > low) & (column < high),
    }[mode]()
    return fine & test


def fraction(df: DataFrame, column: str, share: float, key: Sequence[str], mode: str = "highest", within: str | None = None) -> DataFrame:
    """The highest or lowest share of the rows (within each group), round half to even of the valid count.

    Ties go to the later row (highest) or the earlier one (lowest) in order of `key`.
    """
    valid = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    down = mode == "highest"
    if not within:
        return first_rows(valid, list(dict.fromkeys((column, *key))), down, round(share * valid.count()))
    group = [F.coalesce(F.col(within).cast("string"), F.lit("nan"))]
    order = [F.col(c).desc() if down else F.col(c).asc() for c in (column, *key)]
    w = Window.partitionBy(*group)
    ranked = valid.withColumn("_rank", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_rank") <= F.bround(F.lit(share) * F.col("_n"))).drop("_rank", "_n")


def sample_order(key: Sequence[str], seed: int) -> Column:
    """A digest that orders rows at random, alike in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def first_per_group(df: DataFrame, group: Sequence[str], digest: Column, n: int, then: Sequence[str] = (), rank: str = "_rank") -> DataFrame:
    """The first n rows of each group in order of a hexadecimal digest, then of columns, with their rank; written, so that nothing is drawn twice.

    Digests are even, so n rows of a group of N have digests in the first n / N of all, or little
    beyond: only rows there are sorted. Groups that have too few there give their other rows too.
    """
    group, order = list(group), F.row_number().over(Window.partitionBy(*group).orderBy(digest, *then))
    sizes = written(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    usual = sizes.agg(F.percentile_approx("_n", 0.02)).first()[0] or 0
    share = (n + 6 * math.sqrt(n) + 12) / max(usual, 1)
    if share > 0.7:
        return written(df.withColumn(rank, order).where(F.col(rank) <= n), "drawn")
    early = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(share * 2**32)
    first = written(df.where(early), "early")
    met = first.groupBy(*group).agg(F.count(F.lit(1)).alias("_met"))
    same = [sizes[c].eqNullSafe(met[c]) for c in group]
    short = written(sizes.join(met, reduce(lambda a, b: a & b, same), "left").where(F.coalesce("_met", F.lit(0)) < F.least("_n", F.lit(n))).select(*[sizes[c] for c in group]), "short")
    if not short.isEmpty():
        rest = df.where(~early)
        first = first.unionByName(rest.join(short, reduce(lambda a, b: a & b, [rest[c].eqNullSafe(short[c]) for c in group]), "left_semi"))
    return written(first.withColumn(rank, order).where(F.col(rank) <= n), "drawn")


def sample_per_group(df: DataFrame, group: str, n: int, key: Sequence[str], seed: int = 0, replace_if_short: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """n rows of each group in digest order, then by key and ties; short groups give all rows, or with replace_if_short n draws of them.

    Null groups are dropped. Only rows whose digests come early are sorted; see first_per_group().
    """
    named = df.where(F.col(group).isNotNull())
    enough = first_per_group(named, [group], sample_order(key, seed), n, [*key, *ties])
    if not replace_if_short:
        return enough.drop("_rank")
    sizes = enough.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))  # n stands for n and more
    enough = enough.join(sizes, group)
    short = enough.where(F.col("_n") < n)
    draws = (
        short.select(group, "_n").distinct().select(group, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_draw"), "_n")
    ).withColumn(
        "_rank",
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col("_draw").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("_n") + 1,
    )
    again = short.drop("_n").join(draws.select(group, "_rank"), [group, "_rank"])
    return enough.where(F.col("_n") >= n).drop("_rank", "_n").unionByName(again.drop("_rank"))


def stratified_sample(df: DataFrame, group: str, most: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """At most `most` rows: an equal quota of each group, filled up with other rows in digest order. Small inputs stay whole."""
    order = [sample_order(key, seed), *key]
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("g")).first()
    if totals["n"] <= most:
        return df
    quota = most // max(1, totals["g"])
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    first = F.when(F.col(group).isNotNull() & (F.col("_rank") <= quota), 0).otherwise(1)
    return ranked.orderBy(first, *order).limit(most).drop("_rank")


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct linear-interpolated quantiles of the non-null rows."""
    if bins < 2:
        raise ValueError("at least two bins are needed")
    edges = df.agg(F.percentile(column, [k / bins for k in range(bins + 1)]).alias("e")).first()["e"]
    if edges is None:
        raise ValueError(f"{column} has no values")
    return sorted(set(edges))


def quantile_bin(df: DataFrame, column: str, bins: int = 3, name: str | None = None) -> DataFrame:
    """df with a label T1.., Q1.. or Bin 1..: right-closed equal-frequency bins, the lowest edge included; null stays null."""
    edges = quantile_edges(df, column, bins)
    prefix = {3: "T", 4: "Q"}.get(bins, "Bin ")
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<double>")
    at = F.size(F.filter(inner, lambda e: e < F.col(column).cast("double"))) + 1
    suffix = {3: "tertiles", 4: "quartiles"}.get(bins, f"{bins}bins")
    return df.withColumn(name or f"{column}_{suffix}", F.when(F.col(column).isNotNull(), F.concat(F.lit(prefix), at.cast("string"))))


def rank_tertiles(df: DataFrame, column: str, key: Sequence[str], name: str = "tertile") -> DataFrame:
    """low, mid or high by rank in order of value and key, cut at equal widths of rank."""
    ranked, order = df.where(F.col(column).isNotNull()), list(dict.fromkeys((column, *key)))
    n = ranked.count()
    label = F.lit("high")
    for title, third in (("mid", 2), ("low", 1)):
        k = math.floor(1 + third * (n - 1) / 3)
        if n:
            label = F.when(up_to(order, row_at(ranked, order, False, k)), title).otherwise(label)
    return ranked.withColumn(name, label)
