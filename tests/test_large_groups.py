"""Quantiles of groups that needn't fit a task."""

from pyspark.sql import functions as F

from tessera.operators import heterogeneity as het


def test_quantiles_by_counting_are_those_of_percentile(spark):
    rows = [(g, v) for g, vs in {"a": [5.0], "b": [1.0, 1.0, 1.0, 2.0], "c": [float(i * i % 97) for i in range(500)], "d": [1.0, None, 3.0, float("nan")], "e": [None], "f": [0.0, 1e300, 2.0]}.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    want = {r["g"]: (r["n"], r["q"]) for r in df.groupBy("g").agg(F.count("*").alias("n"), F.array(*[F.percentile("v", s) for s in shares]).alias("q")).collect()}
    got = {r["g"]: (r["n"], r["q"]) for r in het.quantiles_of_large(df, "g", "v", shares, 7).collect()}
    assert str(got) == str({g: want[g] for g in got}) and got.keys() == want.keys()
