"""Queries over datasets that runs write, clusters of whole tables, and frozen spaces."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import KEY, MEASURES, lines, query, table
from .operators import bag_studies, cluster_models, density_trees, figures, layers, mixtures, models, neighbour_information, spaces, tanglegrams, tree_shap, trees
from .sources.dataset import Dataset, work_folder


@query(
    """
select concat('supplier_', l_suppkey) as source_filename, count(*) as n, sum(l_linenumber)::bigint as line_numbers, sum((l_quantity * 100)::bigint)::bigint as quantity
from lineitem group by all
"""
)
def dataset_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for files: one run brings in those of half the nations, the next the others, and one more finds nothing new."""
    rows = lines(spark, sf_dir).select(F.concat(F.lit("supplier_"), "l_suppkey").alias("source_filename"), "l_suppkey", "l_linenumber", "l_quantity")
    counts = rows.groupBy("source_filename", "l_suppkey").agg(F.count("*").alias("n_rows"))
    files = counts.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "left")
    files = files.select("source_filename", "n_rows", "s_nationkey", F.lit("ok").alias("status"))
    data = Dataset(spark, work_folder(spark, "dataset"))
    for listed in (files.where("s_nationkey < 12"), files, files):
        fresh = data.missing(listed).drop("s_nationkey")
        if not fresh.isEmpty():
            data.write(rows.join(fresh.select("source_filename"), "source_filename", "left_semi"), fresh, {"features": ["l_quantity"]}, expected="n_rows")
    got = data.rows().groupBy("source_filename")
    return got.agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("line_numbers"), F.sum(F.round(F.col("l_quantity") * 100).cast("long")).alias("quantity"))


def _spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by what they order: number of orders, and mean and spread of the prices."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.stddev_pop("o_totalprice").alias("spread"))
    return orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment"), "o_custkey")


SPENDING = ("n_orders", "mean_price", "spread")


@query()
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in density clusters of their standardised spending."""
    df = _spending(spark, sf_dir)
    z = layers.fit_layer(df, SPENDING).apply(df)
    return density_trees.hdbscan(z, ["o_custkey"], SPENDING, 10)


@query()
def mixture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIC of mixtures of two to four components over all lines, and the shares of their components."""
    df = lines(spark, sf_dir)
    space = spaces.fit_space(df, MEASURES, "pca", components=2)
    got = mixtures.fit_mixtures(space.project(df), space.names, (2, 3, 4), KEY, starts=2)
    rows = [(k, m.bic, m.log_likelihood, [float(w) for w in m.weights]) for k, m in got.items()]
    return spark.createDataFrame(rows, "n_clusters int, bic double, log_likelihood double, weights array<double>")


@query(
    """
with m as (select avg(l_quantity) a, avg(l_extendedprice) b, stddev_pop(l_quantity) sa, stddev_pop(l_extendedprice) sb, corr(l_quantity, l_extendedprice) r from lineitem),
z as (select l_suppkey, (l_quantity - a) / sa + sign(r) * (l_extendedprice - b) / sb as x, case when (1 + abs(r)) / 2 >= 0.95 then 0 else (l_quantity - a) / sa - sign(r) * (l_extendedprice - b) / sb end as y from lineitem, m),
d as (select l_suppkey, x / sqrt(2) as x, y / sqrt(2) as y from z),
e as (select *, sqrt(x * x + y * y) o, sqrt((x - avg(x) over w) ** 2 + (y - avg(y) over w) ** 2) d from d window w as (partition by l_suppkey))
select l_suppkey, count(*) as n, sqrt(avg(x) ** 2 + avg(y) ** 2) as amhi_offset, median(o) as amhi_median, avg(o) as amhi_mean, stddev_pop(o) as amhi_std,
       quantile_cont(o, 0.25) as amhi_q25, quantile_cont(o, 0.75) as amhi_q75, median(d) as mhi_d_absolute from e group by 1
"""
)
def absolute_on_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute indices of suppliers on the frozen principal axes of all lines; the axes of two standardised features lie at 45 degrees."""
    df = lines(spark, sf_dir)
    return spaces.absolute(df, "l_suppkey", spaces.Space.from_json(spaces.fit_reference(df, MEASURES[:2]).to_json()))


@query(
    """
with m as (select avg(l_quantity) a, avg(l_extendedprice) b, stddev_pop(l_quantity) sa, stddev_pop(l_extendedprice) sb from lineitem),
z as (select (l_quantity - a) / sa as x, (l_extendedprice - b) / sb as y from lineitem, m),
d as (select sqrt((x + 1) ** 2 + (y + 1) ** 2) as d1, sqrt((x - 1) ** 2 + (y - 1) ** 2) as d2 from z)
select case when d1 <= d2 then 'Cluster_1' else 'Cluster_2' end as cluster, count(*) as n, count(*) filter (least(d1, d2) > 1.2) as atypical, avg(least(d1, d2)) as mean_score from d group by 1
"""
)
def cluster_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved model with given centroids, replayed on rows that hold its space's coordinates."""
    df = lines(spark, sf_dir)
    space = spaces.fit_space(df, MEASURES[:2], "scaled")
    model = cluster_models.ClusterModel("given", "kmeans", space, models.Clusters(space.names, ((-1.0, -1.0), (1.0, 1.0)), 1.2), 1.2)
    placed, _ = cluster_models.ClusterModel.from_json(model.to_json()).place(space.project(df), space.stated())
    return placed.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("cluster_atypical").alias("atypical"), F.avg("cluster_score").alias("mean_score"))


@query(
    """
with v as (select l_returnflag y, l_extendedprice v from lineitem),
w as (select *, lag(v, 1) over o a1, lag(v, 2) over o a2, lag(v, 3) over o a3, lead(v, 1) over o b1, lead(v, 2) over o b2, lead(v, 3) over o b3 from v window o as (partition by y order by v)),
r as (select y, v, least(coalesce(v - a3, 'inf'), coalesce(greatest(v - a2, b1 - v), 'inf'), coalesce(greatest(v - a1, b2 - v), 'inf'), coalesce(b3 - v, 'inf'))::double r from w where true),
x as (select y, v, r + 4 * power(2.0::double, -52) * (r + abs(v)) as r from r),
c as (select y, v, count(*) over (partition by y order by v range between r preceding and r following) - 1 as k, count(*) over (order by v range between r preceding and r following) - 1 as m, count(*) over (partition by y) as ny, count(*) over () as n from x),
f as (select unnest([k, m, ny, n]) as n, unnest(['k', 'm', 'ny', 'n']) as what from c),
g as (select what, n, case when n < 20 then list_sum(list_transform(range(1, n), lambda i: 1.0::double / i)) else null end as h, count(*) as c from f group by all),
p as (select what, c, case when n = 1 then -0.5772156649015329 when n < 20 then h - 0.5772156649015329
             else ln(n) - 0.5 / n - 1.0::double / 12 / n / n + 1.0::double / 120 / n / n / n / n - 1.0::double / 252 / n / n / n / n / n / n end::double as psi from g),
s as (select what, sum(c * psi) / sum(c) as mean from p group by what)
select 'l_extendedprice' as feature, greatest(0, sum(case when what in ('n', 'k') then mean else -mean end))::double as mi from s
"""
)
def neighbour_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_information.neighbour_information(lines(spark, sf_dir), ["l_extendedprice"], "l_returnflag")


@query()
def tree_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of a forest that tells customers with much on their account by their spending, for all customers."""
    df = _spending(spark, sf_dir).withColumn("_y", (F.col("c_acctbal") > 4500).cast("double"))
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=20, maxDepth=5, seed=42).fit(VectorAssembler(inputCols=list(SPENDING), outputCol="_x").transform(df))
    return tree_shap.tree_shap(df, SPENDING, ["o_custkey"], model, 1)


@query(
    """
with r as (select l_suppkey, b.b as bag, l_quantity q, row_number() over (partition by l_suppkey, b.b order by md5('42|' || b.b || '|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) rk
  from lineitem, (select unnest(range(0, 3)) as b) b)
select l_suppkey, bag, s.s as size, count(*) as n_rows, avg(q) as l_quantity__mean, stddev_samp(q) as l_quantity__std from r, (select unnest([10, 30, 90]) as s) s where rk <= s.s group by all
"""
)
def nested_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of three sizes from one ordering of the lines."""
    made = bag_studies.nested_bags(lines(spark, sf_dir), "l_suppkey", MEASURES[:1], (10, 30, 90), 3, KEY[:3], ties=("l_quantity", "l_extendedprice"))
    return made.withColumn("bag", F.col("bag").cast("long"))


@query()
def bag_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How suppliers' bags of two sizes fall into density clusters."""
    df = lines(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey")
    return bag_studies.compare_bag_sizes(df, "l_suppkey", MEASURES[:2], (30, 120), 3, KEY[:3], "nation", ties=("l_quantity", "l_extendedprice"))[0]


@query(
    """
with p as (select avg(l_quantity) a1, stddev_pop(l_quantity) s1, avg(l_discount) a2, stddev_pop(l_discount) s2 from lineitem),
z as (select l_returnflag, (l_quantity - a1) / s1 x, (l_discount - a2) / s2 y from lineitem, p),
d as (select *, sqrt(x * x + y * y) f from z), r as (select median(f) radius from d)
select l_returnflag, count(*) as n, avg(x) as l_quantity_z, avg(y) as l_discount_z, any_value(radius) as radius, avg((f <= radius * (1 + 1e-9))::int) as inside_1, avg((f <= radius * (2 * (1 + 1e-9)))::int) as inside_2
from d, r group by 1
"""
)
def distance_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of the flags on two scaled axes, and how many rows lie within the median distance of all rows and twice that."""
    df = lines(spark, sf_dir)
    z = layers.fit_layer(df, ["l_quantity", "l_discount"]).apply(df, "_z")
    return figures.distance_rings(z, ["l_returnflag"], ["l_quantity_z", "l_discount_z"])


@query("select l_suppkey, count(*) as n_rows, least(1.0, 100.0 / count(*))::double as overlap, 100.0 / count(*) > 0.2 as flagged from lineitem where l_suppkey is not null group by 1")
def bag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of rows that two bags of 100 rows of a supplier are expected to have in common."""
    return bag_studies.bag_overlap(lines(spark, sf_dir), "l_suppkey", 100)


@query(
    """
with r as (select l_suppkey, b.b as bag, l_quantity q, l_discount d, row_number() over (partition by l_suppkey, b.b order by md5('42|' || b.b || '|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) rk
  from lineitem, (select unnest(range(0, 3)) as b) b),
g as (select *, sqrt((q - 10) ** 2 + (d - 0.02) ** 2) d1, sqrt((q - 25) ** 2 + (d - 0.05) ** 2) d2, sqrt((q - 40) ** 2 + (d - 0.08) ** 2) d3 from r where rk <= 20),
c as (select *, list_position([d1, d2, d3], least(d1, d2, d3)) as k from g)
select l_suppkey, bag, count(*) as n_rows, avg((k = 1)::int) as cluster_1__share, avg((k = 2)::int) as cluster_2__share, avg((k = 3)::int) as cluster_3__share from c group by all
"""
)
def cluster_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of three given clusters in suppliers' bags of 20 rows."""
    model = models.Clusters(("l_quantity", "l_discount"), ((10.0, 0.02), (25.0, 0.05), (40.0, 0.08)), 0.0)
    made = bag_studies.cluster_shares(lines(spark, sf_dir), model, "l_suppkey", 3, 20, KEY[:3], ties=("l_quantity", "l_extendedprice"))
    return made.withColumn("bag", F.col("bag").cast("long"))


@query()
def turned_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of customers' profiles turned towards the fixed species tree, for every choice of method; every nation is a replicate of the species of its key modulo 6."""
    df = table(spark, sf_dir, "customer").withColumns({"len": F.length("c_mktsegment").cast("double"), "species": F.pmod("c_nationkey", F.lit(len(trees.SPECIES)))})
    df = df.withColumn("both", F.col("c_acctbal") * F.col("len"))
    groups, m = tanglegrams.profiles(df, ["c_acctbal", "len", "both"], ["c_nationkey", "c_custkey"], "species")
    names = [trees.SPECIES[int(g)] for g in groups]
    fixed = trees.linkage(np.array([[trees.DIVERGENCE[a][trees.SPECIES.index(b)] for b in names] for a in names]))
    rows = [tuple(r.values()) for r in tanglegrams.sensitivity(names, m, fixed)]
    return spark.createDataFrame(rows, "standardized boolean, method string, metric string, baker_gamma double, p double, crossings int, crossings_as_built int, tau double, shared_clades int, leaf_order array<string>")
