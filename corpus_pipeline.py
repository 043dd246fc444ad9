"""The corpus pipeline: its stages in order, and a run over the documents of a folder.

Every stage gets what the one before kept, as a DataFrame with the columns of documents, and gives the same; the last adds
``shard`` and ``slot``. Columns that documents brings besides are kept; nulls, ties, repeated rows, empty tables and very long
texts are as the stage's operator defines them: null texts are empty and fall to the quality rules, an empty table gives an empty
one at every stage, repeated rows are one group of near copies, and texts are read whole.

A stage that is called by itself has its result written before the next one is called, as ``run`` does it in the shared folder:
a stage begins by deleting the scratch tables of those that go before it. What the last one made stays until the session ends,
as its result still reads it. Each ``run`` keeps account of its own scratch tables, so runs do not disturb one another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontam, mixing, quality, sharding, simhash
from marlstone.llm.shared import drop, materialize, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_scratch: dict[str, list[str]] = {}


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        order = [g.__name__ for _, g in STAGES]
        for earlier in order[: order.index(f.__name__)]:
            drop(spark, _scratch.pop(earlier, []))
        with recorded(_scratch.setdefault(f.__name__, [])):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return quality.keep_good(docs)


@stage
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.one_of_each(docs)


@stage
def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights."""
    return mixing.mixed_documents(docs)


@stage
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents to shards."""
    return sharding.shard_documents(docs)


STAGES = [("quality rules", good), ("near-duplicates", distinct), ("decontamination", unleaked), ("mixing", mixed), ("sharding", sharded)]

#: Near copies are found by seeded hashes, which SQL has not; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, f) in enumerate(STAGES):
        made, written, last = [], [], i == len(STAGES) - 1
        with recorded(made):
            docs = f.__wrapped__(spark, docs, sf_dir)
        if not last:
            with recorded(written):
                docs = materialize(docs, "stage")
            drop(spark, [*made, *before])  # the last result still reads what came before it
        before = written
    return docs
