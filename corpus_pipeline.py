"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

A stage's result may read tables that the stage left in the shared folder. run() removes these once
the result is written; where stages are called one by one, the stage that comes after does so when it is given
documents that were written after the result was returned, as results handed on are.
"""

from __future__ import annotations

import functools
import math
import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, linededup, mixing, similar, simhash, toxicity
from tessera.llm.common import collect_garbage, delete, shared_path, written_folders
from tessera.llm.queries import table, vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


class Left(NamedTuple):
    """Folders that a stage's result reads, and when it was returned."""

    stage: str
    since: float
    folders: list[str]


_LEFT: list[Left] = []


def _written_at(spark: SparkSession, files: list[str]) -> float:
    """When the oldest of files was written; infinitely long ago if there is none."""
    found = []
    for f in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        found.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime() / 1000)
    return min(found, default=-math.inf)


def _release(spark: SparkSession, done: list[Left]) -> None:
    for left in done:
        delete(spark, left.folders)
        _LEFT.remove(left)
    if done:
        collect_garbage(spark)


def stage(function: Stage) -> Stage:
    """The stage; first, what results of the stage before needed goes, if docs were written after these were returned and don't read it themselves."""

    @functools.wraps(function)
    def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        order = [f.__name__ for _, f in STAGES]
        before = order[order.index(function.__name__) - 1] if function.__name__ in order[1:] else None
        if any(left.stage == before for left in _LEFT):
            files = docs.inputFiles()
            began = _written_at(spark, files)
            own = {f for f in files for left in _LEFT for folder in left.folders if f"/{folder.rsplit('/', 1)[1]}/" in f}
            _release(spark, [left for left in _LEFT if not own and left.stage == before and began >= left.since])
        with written_folders() as folders:
            out = function(spark, docs, sf_dir)
        if folders:
            _LEFT.append(Left(function.__name__, time.time(), list(folders)))
        return out

    return clean


@stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go; the model learns from the labelled ones that aren't held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


@stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from the texts; n_chars, if there is one, is counted anew (null for null texts). No document goes."""
    done = linededup.drop_repeated_chunks(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Near are fingerprints at distance 2 or less, and texts whose five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return simhash.drop_near_duplicates(docs, gone=similar.similar_to_smaller(docs))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order."""
    return mixing.training_order(mixing.mix(docs)).select(*docs.columns)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each row."""
    return bpe.roundtrip_digests(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_repeated_passages),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor XXH64 fingerprints nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with written_folders() as folders:
            apply.__wrapped__(spark, docs, sf_dir).write.parquet(path)
        delete(spark, folders)
        collect_garbage(spark)
        docs = spark.read.parquet(path)
    return docs
