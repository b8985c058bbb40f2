"""Running counts and cuts in a total order without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task may order.
TASK_ROWS = 1_000_000
#: Parts that a column is cut into, at approximate quantiles.
PARTS = 256


def _edges(value: str, parts: int) -> Column:
    return F.array_sort(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), [k / parts for k in range(1, parts)], 10_000)))


def _part(edges: Sequence[float], value: str) -> Column:
    """How many edges lie below the value."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(value).cast("double")))


def counts_below(counts: DataFrame, by: str, value: str, amount: str, name: str = "below", task_rows: int = TASK_ROWS, parts: int = PARTS) -> DataFrame:
    """counts with `name`: the sum of `amount` over the rows of the same `by` with a smaller value; a row per (by, value), by being few strings.

    Up to task_rows rows of one `by` are ordered in one task. Beyond that values are dealt to parts
    at approximate quantiles (literals: parts per `by`), ordered within their part, and the parts
    before are added. Results don't depend on where the cuts lie.
    """
    sizes = counts.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per `by`
    running = lambda w: F.coalesce(F.sum(amount).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if all(r["n"] <= task_rows for r in sizes):
        return counts.withColumn(name, running(Window.partitionBy(by)))
    cuts = counts.groupBy(by).agg(_edges(value, parts).alias("e")).collect()  # parts per `by`
    part = F.lit(0)
    for r in cuts:
        part = F.when(F.col(by) == r[by], _part(r["e"], value)).otherwise(part)
    dealt = counts.withColumn("_part", part)
    totals = dealt.groupBy(by, "_part").agg(F.sum(amount).alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(by, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = dealt.withColumn("_inner", running(Window.partitionBy(by, "_part")))
    # At most `parts` rows per `by`.
    return inner.join(F.broadcast(offsets), [by, "_part"]).withColumn(name, F.col("_before") + F.col("_inner")).drop("_part", "_before", "_inner")


def _ahead(column: str, down: bool, at: object) -> Column:
    """Rows strictly before the value `at`: nulls come first in ascending order, last in descending order."""
    c = F.col(column)
    if at is None:
        return c.isNotNull() if down else F.lit(False)
    return F.coalesce(c > F.lit(at), F.lit(False)) if down else c.isNull() | (c < F.lit(at))


def _equal(column: str, at: object) -> Column:
    return F.col(column).isNull() if at is None else F.coalesce(F.col(column) == F.lit(at), F.lit(False))


def _around(edges: Sequence[float], n: int, place: int) -> list[float]:
    """The edges two parts below and above the place (from 0) among n values; few, as every row is compared with each."""
    if not edges:
        return []
    at = place * (len(edges) + 1) // max(n, 1)
    return sorted({edges[j] for j in (at - 2, at + 2) if 0 <= j < len(edges)})


def row_at(df: DataFrame, order: Sequence[str], down: bool, k: int, task_rows: int = TASK_ROWS, parts: int = PARTS) -> tuple:
    """Values of the order columns in the k-th row (from 1) of df in that order.

    Candidates are narrowed by counting numeric columns' parts until a task can order what is left.
    """
    left = df.select(*order)
    kinds = dict(left.dtypes)
    numeric = [c for c in order if kinds[c] in ("int", "bigint", "smallint", "tinyint", "double", "float", "long")]
    total = left.count()
    for c in [x for x in numeric for _ in range(3)]:
        if total <= task_rows:
            break
        if order.index(c) and left.agg(F.count_distinct(*[F.coalesce(F.col(x).cast("string"), F.lit("null")) for x in order[: order.index(c)]])).first()[0] > 1:
            break  # columns before this one still decide
        cuts = left.agg(F.count(c).alias("n"), F.percentile_approx(F.col(c).cast("double"), [j / parts for j in range(1, parts)], 10_000).alias("e")).first()
        part = F.when(F.col(c).isNull(), -1).otherwise(_part(_around(cuts["e"] or [], cuts["n"], cuts["n"] - k if down else k - 1 - (total - cuts["n"])), c))
        sizes = sorted(left.groupBy(part.alias("p")).count().collect(), key=lambda r: -r["p"] if down else r["p"])  # `parts` rows
        for r in sizes:
            if k <= r["count"]:
                left, total = left.where(part == r["p"]), r["count"]
                break
            k -= r["count"]
    row = left.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c in order]).offset(k - 1).limit(1).first()
    return tuple(row[c] for c in order)


def quantile(df: DataFrame, column: str, share: float, task_rows: int = TASK_ROWS, parts: int = PARTS) -> float | None:
    """The exact quantile of the values that aren't missing, between two rows in proportion; None if there are none."""
    v = F.col(column).cast("double")
    known = df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    n = known.count()
    if not n:
        return None
    at = share * (n - 1)
    k = min(int(at), n - 1)
    low = row_at(known, ["v"], False, k + 1, task_rows, parts)[0]
    if at == k:
        return low
    after = known.agg(F.count_if(F.col("v") <= low).alias("n"), F.min(F.when(F.col("v") > low, F.col("v"))).alias("next")).first()
    high = low if after["n"] > k + 1 else after["next"]
    return low + (high - low) * (at - k)


def _against(order: Sequence[str], at: Sequence, down: bool) -> tuple[Column, Column]:
    """Whether a row comes before the one with the values `at`, and whether it has them."""
    before, same = F.lit(False), F.lit(True)
    for c, v in zip(order, at, strict=True):
        before = before | (same & _ahead(c, down, v))
        same = same & _equal(c, v)
    return before, same


def up_to(order: Sequence[str], at: Sequence) -> Column:
    """Whether a row comes before the one with the values `at` in ascending order, or has them."""
    before, same = _against(order, at, False)
    return before | same


def first_rows(df: DataFrame, order: Sequence[str], down: bool, k: int, task_rows: int = TASK_ROWS, parts: int = PARTS) -> DataFrame:
    """The k first rows of df in order; of rows that repeat in all order columns, as many as fit."""
    if k <= 0:
        return df.limit(0)
    at = row_at(df, order, down, k, task_rows, parts)
    before, same = _against(order, at, down)
    n = df.agg(F.count_if(before).alias("before"), F.count_if(same).alias("same")).first()
    if n["before"] + n["same"] <= k:
        return df.where(before | same)
    return df.where(before).unionByName(df.where(same).limit(k - n["before"]))
