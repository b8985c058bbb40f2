"""Queries of heterogeneity runs and of the tables behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import KEY, MEASURES, ORACLE_SQL, QUERIES, lines, query, table
from .operators import figures, indices, layers, models, space


@query(f"select * from ({ORACLE_SQL['dispersion']}) full join ({ORACLE_SQL['binned_entropy']}) using (l_suppkey)")
def all_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.join_metrics([QUERIES[q](spark, sf_dir) for q in ("dispersion", "binned_entropy")], "l_suppkey")


@query(
    """
select l_partkey, returned, open from (select l_partkey, avg(l_quantity) as returned from lineitem where l_returnflag = 'R' group by 1)
full join (select l_partkey, avg(l_quantity) as open from lineitem where l_linestatus = 'O' group by 1) using (l_partkey)
"""
)
def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric tables that each lack some individuals: parts without returned lines, and parts without open ones."""
    mean = lambda where, name: lines(spark, sf_dir).where(where).groupBy("l_partkey").agg(F.avg("l_quantity").alias(name))
    return indices.join_metrics([mean("l_returnflag = 'R'", "returned"), mean("l_linestatus = 'O'", "open")], "l_partkey")


def _individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per supplier with two metrics, its nation's number modulo 5 as species and the parity of its key as age group."""
    per = lines(spark, sf_dir).groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m1"), F.avg("l_extendedprice").alias("m2"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 5).cast("int").alias("species"), F.when(F.col("s_suppkey") % 2 == 0, "2M").otherwise("10M").alias("age"))
    return indices.on_rows(known, per, "l_suppkey")


_INDIVIDUALS = """
i as (select s_suppkey as l_suppkey, s_nationkey % 5 as species, case when s_suppkey % 2 = 0 then '2M' else '10M' end as age, m1, m2
      from supplier left join (select l_suppkey, avg(l_quantity) m1, avg(l_extendedprice) m2 from lineitem group by 1) on s_suppkey = l_suppkey)"""


@query(
    "with "
    + _INDIVIDUALS
    + """,
l as (select species, age, 'm1' as metric, m1 as v from i where m1 is not null union all select species, age, 'm2', m2 from i where m2 is not null),
two as (select species from l group by 1 having count(distinct age) = 2),
r as (select *, rank() over w + (count(*) over (partition by species, metric, v) - 1) / 2.0 as rk from l join two using (species) window w as (partition by species, metric order by v))
select species::varchar as species, metric, count(*) filter (age = '2M')::int as n_first, count(*) filter (age = '10M')::int as n_second,
       (sum(rk) filter (age = '2M') - count(*) filter (age = '2M') * (count(*) filter (age = '2M') + 1) / 2.0)::double as u from r group by 1, 2
"""
)
def age_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = indices.run_age_tests(_individuals(spark, sf_dir), "species", "age", ["m1", "m2"], permutations=200)
    return got.select("species", "metric", "n_first", "n_second", "u")


@query(
    "with "
    + _INDIVIDUALS
    + """,
g as (select species, avg(m1) a, avg(m2) b from i where species is not null group by 1),
u as (select species, (a - min(a) over ()) / (max(a) over () - min(a) over ()) a, (b - min(b) over ()) / (max(b) over () - min(b) over ()) b from g)
select x.species as a, y.species as b, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) as distance from u x join u y on x.species < y.species
"""
)
def group_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.group_distances(_individuals(spark, sf_dir), "species", ["m1", "m2"])


@query("with " + _INDIVIDUALS + " select species, count(*) as n_individuals, avg(m1) as m1__mean, stddev_samp(m1) as m1__sd, avg(m2) as m2__mean, stddev_samp(m2) as m2__sd from i group by 1")
def group_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.group_profile(_individuals(spark, sf_dir), "species", ["m1", "m2"])


@query("with " + _INDIVIDUALS + " select l_suppkey, m1, m2 from i where species <> 3")
def without_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.exclude_reference(_individuals(spark, sf_dir), "species", "3").select("l_suppkey", "m1", "m2")


@query(
    """
with p as (select l_returnflag g, l_suppkey s, avg(l_quantity) q, avg(l_discount) d from lineitem group by 1, 2),
w as (select g, avg(q) q, avg(d) d from p group by 1 union all select null, avg(l_quantity), avg(l_discount) from lineitem)
select g as l_returnflag, 'l_quantity' as feature, q as value from w union all select g, 'l_discount', d from w
"""
)
def radar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.profile(lines(spark, sf_dir), "l_returnflag", ["l_quantity", "l_discount"], "mean", ["l_suppkey"], overall=True)


@query(
    """
with c as (select l_linenumber as x, l_returnflag as g, median(l_quantity) m, stddev_samp(l_quantity) s, count(l_quantity) n from lineitem group by 1, 2)
select x as l_linenumber, g as l_returnflag, 'l_quantity' as feature, m as centre, s as sd, n, dense_rank() over (order by x)::int as place from c
"""
)
def time_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.time_curve(lines(spark, sf_dir), "l_linenumber", ["l_quantity"], "l_returnflag", "median")


@query("select l_returnflag, l_linestatus, count(*) as n, avg(l_quantity) as l_quantity, avg(l_discount) as l_discount from lineitem group by 1, 2")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.centroids(lines(spark, sf_dir), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])


@query(
    """
with p as (select l_returnflag as g, avg(l_quantity) as m, stddev_samp(l_quantity) * 2 as e from lineitem group by 1)
select g as l_returnflag, least(e, greatest(m - (select min(l_quantity) from lineitem where l_quantity > 0) / 10, 0)) as arm from p
"""
)
def error_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    per = df.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"), (F.stddev_samp("l_quantity") * 2).alias("e"))
    least = df.where("l_quantity > 0").agg(F.min("l_quantity").alias("least"))
    return per.join(F.broadcast(least)).select("l_returnflag", figures.clamp_lower(F.col("m"), F.col("e"), F.col("least")).alias("arm"))  # one row


@query(
    "\nunion all\n".join(f"select '{f}' as feature, avg({f}) as mean, stddev_pop({f}) as sd, min({f}) as low, max({f}) as high from lineitem" for f in MEASURES)
)
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.feature_statistics(lines(spark, sf_dir), MEASURES)


@query(
    """
select cluster, count(*) as n, avg((least(d1, d2) > 12)::int) as atypical_share from (select *, case when d1 <= d2 then 'Cluster_1' else 'Cluster_2' end as cluster from (
  select sqrt((l_quantity - 15) ** 2 + (l_discount - 0.05) ** 2) d1, sqrt((l_quantity - 35) ** 2 + (l_discount - 0.05) ** 2) d2 from lineitem)) group by 1
"""
)
def atypical_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = models.Clusters(("l_quantity", "l_discount"), ((15.0, 0.05), (35.0, 0.05)), 12.0)
    return models.atypical_share(model.assign(lines(spark, sf_dir)), model.atypical)


@query()
def cluster_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two to four clusters and whether each number is the chosen one."""
    df = lines(spark, sf_dir)
    z = layers.fit_layer(df, MEASURES).apply(df, "_z")
    got = models.scan_clusters(z, [f"{f}_z" for f in MEASURES], (2, 3, 4), KEY)
    best = models.choose_clusters(got)
    rows = [(r["n_clusters"], r["silhouette"], r["inertia"], r["smallest_share"], r["n_clusters"] == best) for r in got]
    return spark.createDataFrame(rows, "n_clusters int, silhouette double, inertia double, smallest_share double, chosen boolean")


@query(
    """
with m as (select avg(l_quantity) a, avg(l_extendedprice) b, stddev_pop(l_quantity) sa, stddev_pop(l_extendedprice) sb, corr(l_quantity, l_extendedprice) r from lineitem)
select avg(abs(((l_quantity - a) / sa + sign(r) * (l_extendedprice - b) / sb) / sqrt(2))) as mean_abs_pc1, avg(abs(((l_quantity - a) / sa - sign(r) * (l_extendedprice - b) / sb) / sqrt(2))) as mean_abs_pc2
from lineitem, m
"""
)
def two_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal axes of two standardised features lie at 45 degrees."""
    df = lines(spark, sf_dir)
    z = layers.fit_layer(df, MEASURES[:2]).apply(df, "_z")
    got = space.fit_axes(z, [f"{f}_z" for f in MEASURES[:2]], 2).project(z)
    return got.agg(F.avg(F.abs("pc1")).alias("mean_abs_pc1"), F.avg(F.abs("pc2")).alias("mean_abs_pc2"))
