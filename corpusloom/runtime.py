"""Session plumbing that every operator shares: code shipping, shared storage, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = str(Path(__file__).resolve().parent)
BROADCAST_LIMIT = 48 << 20  # bytes; a larger side is shuffled instead

_shipped: set[str] = set()
_own_dir: dict[str, str] = {}
_runs: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "corpusloom-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a local master."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if sc.applicationId not in _own_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dir[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="corpusloom-shared-")
        sc.setCheckpointDir(_own_dir[sc.applicationId])
    return _own_dir[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder of this application's own one, which goes when the driver ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _runs:
        _runs[sc.applicationId] = run = f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
        atexit.register(_remove, sc._jvm, sc._jsc, run)
    return f"{_runs[sc.applicationId]}/{name}-{uuid.uuid4().hex}"


def _remove(jvm, jsc, path: str) -> None:
    """Delete a folder through Hadoop, as it may be on any file system; without a JVM any more it stays."""
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives the loss of executors. options: Parquet's."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast if the table, which should be stored already, is small; else leave it to a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


ROW_GROUP = 128 << 20  # bytes that writers put into one row group, which one task reads


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few small files on all cores: splits of a file that is one row group are empty but for one. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < cores * ROW_GROUP and size < (files := len(df.inputFiles())) * ROW_GROUP and files < cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
