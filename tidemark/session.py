"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes of a batch that Spark hands to Python and takes back, at most as long as no row is larger.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22
#: Tasks that small input tables are dealt to; unset, the files' splits decide.
PARTITIONS_KEY = "spark.tidemark.partitions"


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes.

    ``master`` and the shuffle width are only set for local runs; on a cluster
    they come from spark-submit and AQE sizes the partitions.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # plans here are made of thousands of expressions; noting the caller of each takes longer than planning them
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # the files of a checkpoint go when nothing refers to it any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        b = (
            b.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
            .config("spark.sql.shuffle.partitions", os.environ.get("TIDEMARK_SHUFFLE", "8"))
            .config(PARTITIONS_KEY, (re.findall(r"\d+", master) or [str(os.cpu_count() or 1)])[0])
        )
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    Spark copies the archive to every executor, so nothing has to be installed there.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    if root.is_dir():
        target = Path(tempfile.mkdtemp(prefix="tidemark-zip-")) / "tidemark"
        sc.addPyFile(shutil.make_archive(str(target), "zip", root.parent, root.name))
    # workers that Spark starts on the driver, as for stateful streams, see its paths only
    paths = [str(root.parent), sc.environment.get("PYTHONPATH", "")]
    sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    sc._tidemark_shipped = True
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh one on this machine only where all tasks run on it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-ck-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that a lost executor does not recompute its past."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """What is run meanwhile goes through Python in batches of ``most`` bytes or less.

    Both sides hold a batch several times over, for each Python step of each task; of wide rows, as vectors or blocks of
    them are, Spark's own batches take more than the rest of an executor.
    """
    old = spark.conf.get(BATCH_KEY)
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(old)
    spark.conf.set(BATCH_KEY, f"{min(now, most)}b")
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, old)


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored meanwhile go at its end, but for those that are kept; what is made of them is stored by then."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    outer = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` as a table below the checkpoint folder: ends the lineage too, with compressed columns where a checkpoint has plain rows."""
    folder = (not keep and _scratch.get()) or ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{folder}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
