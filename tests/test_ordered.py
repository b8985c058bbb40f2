"""Counted cuts agree with plain sorting, however few rows a task may order."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered, ranks, rows, space

random.seed(1)
ROWS = [("ab"[i % 2], float(random.choice([1, 1, 1, 2, 3, 5, 8, random.random() * 9])), i % 5, i) for i in range(1500)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "g string, v double, t long, i long").persist()


def test_counts_below_in_parts(df):
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    got = {(r["g"], r["v"]): r["below"] for r in ordered.counts_below(counts, "g", "v", "c", task_rows=10, parts=16).collect()}
    assert got == {(g, v): sum(w[0] == g and w[1] < v for w in ROWS) for g, v in got}


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("k", [0, 1, 700, 1500])
def test_first_rows_in_parts(df, down, k):
    want = sorted(ROWS, key=lambda r: r[1:], reverse=down)[:k]
    assert sorted(r["i"] for r in ordered.first_rows(df, ["v", "t", "i"], down, k, 20, 8).collect()) == sorted(w[3] for w in want)


def test_repeated_and_null_rows(spark):
    some = spark.createDataFrame([(1.0, None), (1.0, None), (1.0, "a"), (None, "b"), (2.0, "a")], "v double, k string")
    assert ordered.first_rows(some, ["v", "k"], False, 2).count() == 2
    assert [r["v"] for r in ordered.first_rows(some, ["v", "k"], False, 1).collect()] == [None]
    assert [r["v"] for r in ordered.first_rows(some, ["v", "k"], True, 1).collect()] == [2.0]
    assert rows.rank_tertiles(some, "v", ["k"]).count() == 4
    assert rows.rank_tertiles(some.limit(0), "v", ["k"]).count() == 0


def test_spearman_of_a_monotone_curve(spark):
    df = spark.createDataFrame([(float(i), float(i**3)) for i in range(20)] + [(None, 1.0)], "x double, y double")
    assert ranks.spearman(df, "x", "y").first()["spearman"] == pytest.approx(1)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert ranks.spearman(flat, "x", "y").first()["spearman"] is None


def test_features_without_spread_correlate_with_nothing(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.0), (None, 7.0, 9.0)], "x double, c double, y double")
    assert space.correlations(df, ["x", "c", "y"])[0].tolist() == pytest.approx([1, 0, 1])
    assert space.correlation_filter(df, ["x", "c", "y"], 0.9) == ["x", "c"]
