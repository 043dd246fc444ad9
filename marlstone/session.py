"""A session with the settings that the engine is meant for."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "marlstone", **conf: object) -> SparkSession:
    """ANSI SQL, UTC, adaptive execution with skew joins; ``conf`` keys use ``__`` for dots and go before the defaults."""
    settings = {
        "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where only the driver's own path has it, as in local runs from elsewhere."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster on which it is not installed."""
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / "marlstone.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(home.rglob("*.py")):
            out.write(f, str(f.relative_to(home.parent)))
    spark.sparkContext.addPyFile(str(path))


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share, gone when the driver's JVM ends; a local one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base.removeprefix("file://").removeprefix("file:") if base else tempfile.mkdtemp(prefix="marlstone-")
    if "://" in base:
        raise ValueError(f"a folder of tables must be a mounted path, not {base}")
    path = os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")
    os.makedirs(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{path}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
