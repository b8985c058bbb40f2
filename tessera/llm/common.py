"""What several corpus operators share: word counts, shared files, distributed components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run without blanks, tabs and line ends.
WORD = r"[^\x20\x09-\x0D]+"

_OWN_DIR: list[str] = []
#: Lists that take the folders materialize() writes, innermost last.
_TAKERS: list[list[str]] = []
#: Drops a query's shuffle files as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset on a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _OWN_DIR[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors, and needs no shuffle files any more."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if _TAKERS:
        _TAKERS[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete what materialize() wrote for df."""
    delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def delete(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders that materialize() or shared_path() named."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        if "/tessera/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def written_folders() -> Iterator[list[str]]:
    """A list that takes the folders materialize() writes meanwhile."""
    _TAKERS.append([])
    try:
        yield _TAKERS[-1]
    finally:
        _TAKERS.pop()


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles of ended queries: it waits for the driver's JVM to collect, and a driver with little to do seldom does."""
    give_back()
    spark._jvm.java.lang.System.gc()


def give_back() -> None:
    """Return freed memory to the system: the driver and Python workers outlive what a task or fit held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def word_count(text: Column) -> Column:
    """Number of words, long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often, and in whatever lambda, body refers to it."""
    return F.transform(F.array(value), body)[0]


#: A key with this share of all rows or more counts as hot; so there are a thousand at most.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows inner-joined with table, one row per key, whose column `hot` marks keys with a thousandth of rows or more.

    The hot ones, a thousand at most, are broadcast; so no task gets all rows of such a key.
    """
    hot, rest = F.broadcast(table.where("hot").drop("hot")), table.where("not hot").drop("hot")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps until every component is a star around its
    smallest node. Each step is a min aggregation (combined before the shuffle) and an equi-join
    (which AQE splits when a hub is hot); each round is written to the shared folder, so neither
    lineage nor driver state grows. Nodes without edges (self-loops aside) don't appear.
    """
    state = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = _mark(state)
    while True:  # a logarithmic number of rounds
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
                )
            ).alias("e")
        )
        after = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = _mark(after)
        remove(state)
        state = after
        if now == mark:
            break
        mark = now
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Tells two edge sets apart."""
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
    )
