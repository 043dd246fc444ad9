"""Helpers that the operators of this package share."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import importable  # noqa: F401  operators take it from here

#: The white space between words, as Java and Python patterns read it.
SPACE = r"[\x20\x09-\x0D]+"

_count = itertools.count()
_records: list[list[str]] = []


def words(text: Column) -> Column:
    """The words of a whole text, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body).getItem(0)


def shingle_hashes(tokens: Column, n: int) -> Column:
    """A 64-bit hash of each run of ``n`` words, in order; empty for fewer words.

    Hashes of runs are put together from those of two shorter runs, so the work for a run grows with log n only.
    """

    def doubled(runs: Column, shift: int) -> Column:
        return let(runs, lambda r: F.transform(r, lambda x, i: F.xxhash64(x, F.get(r, i + shift))))

    def grow(ones: Column) -> Column:
        have, runs, rest = ones, 1, n
        while runs * 2 <= rest:
            have = doubled(have, runs)
            runs *= 2
        if runs < n:  # two runs that overlap cover the rest
            have = doubled(have, n - runs)
        return F.slice(have, F.lit(1), F.greatest(F.size(ones) - n + 1, F.lit(0)))

    return let(F.transform(tokens, lambda x: F.xxhash64(x)), grow)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, whatever columns came with it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        delete_on_exit(spark, path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop has it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete_on_exit(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/marlstone/{name}-{next(_count)}-{uuid.uuid4().hex[:12]}"
    delete_on_exit(spark, path)
    for made in _records:
        made.append(path)
    return path


@contextmanager
def recorded(made: list[str]) -> Iterator[None]:
    """Adds the scratch paths that are made within to a list."""
    _records.append(made)
    try:
        yield
    finally:
        _records.remove(made)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch paths of which no result is to be read any more."""
    for path in paths:
        fs, at = file_system(spark, path)
        fs.delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: it cuts lineage and outlives any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what has been written by now, which it does when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def hint_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted here, are within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def hint_if_light(df: DataFrame, size: Column, most_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows' bytes (``size``, an estimate for a row), summed up here, are within the bound."""
    return F.broadcast(df) if (df.agg(F.sum(size.cast("bigint"))).first()[0] or 0) <= most_bytes else df


def running_totals(df: DataFrame, groups: Sequence[str], order: Sequence[str], weight: Column, name: str, out: tuple[str, str]) -> DataFrame:
    """Each row's place in its group, and the weight of the group's rows before it, without a task that gathers a group.

    Rows are range-partitioned by group and order, with a salt last, so that neither a hot group nor a heap of equal rows
    meets in one task. There are as many partitions as the session sets for shuffles. Totals of the partitions give each its start; a window runs within a partition only. Rows that are
    equal in ``groups`` and ``order`` are interchangeable: they get consecutive places in some order.

    ``out`` names two columns: the place, from 0, and the weight before the row (both long).
    """
    salt, part, w = fresh(df, "_salt", "_part", "_weight")
    salted = df.withColumn(salt, F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())).withColumn(w, weight.cast("long"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(salted.repartitionByRange(n, *groups, *order, salt).withColumn(part, F.spark_partition_id()), name)
    totals = dealt.groupBy(*groups, part).agg(F.count(F.lit(1)).alias("_rows"), F.sum(w).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(part).alias("_p"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum0"),
    )
    inside = Window.partitionBy(part, *groups).orderBy(*order, salt)
    same = F.col(part) == F.col("_p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    placed = dealt.withColumn(out[0], F.row_number().over(inside) - 1).withColumn(out[1], F.coalesce(F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(hint_if_small(starts, 200_000), same, "left").select(
        *df.columns, (F.col(out[0]) + F.col("_rows0")).cast("long").alias(out[0]), (F.col(out[1]) + F.col("_sum0")).cast("long").alias(out[1])
    )
