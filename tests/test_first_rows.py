"""The first rows of groups, of which only those with early digests are sorted."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import rows


def test_first_rows_of_large_small_and_short_groups(spark, monkeypatch):
    sizes = dict.fromkeys(range(60), 400) | {60: 3, None: 500}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g long, i long")
    late = F.when(F.col("g") == 7, F.concat(F.lit("ffffffff"), F.md5(F.col("i").cast("string")))).otherwise(rows.sample_order(["g", "i"], 1))
    want = df.withColumn("_rank", F.row_number().over(Window.partitionBy("g").orderBy(late, "i"))).where("_rank <= 20")
    seen, plain = {}, rows.written
    monkeypatch.setattr(rows, "written", lambda df, name: seen.setdefault(name, plain(df, name)))
    got = rows.first_per_group(df, ["g"], late, 20, ["i"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("g is null or g = 7").count() == 40 and seen["early"].count() < df.count() / 4
