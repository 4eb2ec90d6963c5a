"""Session helpers: table loading, reliable checkpoints and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast only when Catalyst's own estimate, or a bound known by construction, is under this size.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per context (they need not have it on their path)."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent
    staging = Path(tempfile.mkdtemp(prefix="millrace-"))
    shutil.copytree(root, staging / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(staging / "millrace_pkg"), "zip", staging / "src"))
    sc._millrace_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One parquet table; ``columns`` prunes early so that the scan's ReadSchema is explicit."""
    ship_package(spark)
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's setting; only a session that runs on one machine may do without one (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined() and (not configured or current.get().startswith(configured.rstrip("/"))):
        return current.get()
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
    sc.setCheckpointDir(configured)
    return configured


#: Tables of ``checkpoint`` that still stand.
_WRITTEN: list[str] = []


def clear_checkpoints(spark: SparkSession) -> int:
    """Remove the tables that ``checkpoint`` wrote so far; for long sessions, between jobs whose results are stored. How many."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _remove(spark, _WRITTEN.pop())
    return n


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder once, as a columnar table, and go on from there.

    The table survives the loss of executors, later reads prune its columns, and its size is known to the optimiser. It is
    removed when the application ends, or by ``clear_checkpoints``.
    """
    spark = df.sparkSession
    path = f"{shared_checkpoint_dir(spark).rstrip('/')}/millrace-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(clear_checkpoints, spark)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reread(parts: list[DataFrame]) -> DataFrame:
    """Checkpointed tables of one schema as one scan: the plan stays small however many there are."""
    paths = sorted({f.rpartition("/")[0] for p in parts for f in p.inputFiles()})
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*paths) if paths else parts[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast when the estimate is under ``limit``; otherwise leave the choice to the optimiser (shuffle join)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def input_partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle width to use where it must be stated: the session's setting, never under ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
