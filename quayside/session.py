"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
# Rows of the largest input for which shuffles have one part, and bytes up to which small parts are put together and files are cut.
PART_ROWS, PART_BYTES = 200_000, "8m"


def get_session(app: str = "quayside", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume (UTC, AQE, skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Recording the Python line of every column call doubles the time it
        # takes to build a plan of many columns.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local session
    without that setting falls back to a temporary folder of this machine; on
    a cluster the setting is required, since executors must be able to read
    what other executors wrote.
    """
    base = spark.conf.get(_CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_CONF} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(_CHECKPOINT_CONF, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, on every executor.

    Needed once per application, unless the package is installed there.
    """
    context = spark.sparkContext
    if getattr(context, "_quayside_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    archive = shutil.make_archive(
        os.path.join(folder, "quayside"), "zip", os.path.dirname(root), os.path.basename(root)
    )
    context.addPyFile(archive)
    context._quayside_shipped = True


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Compute ``df`` once, write it to the shared folder and return the written table.

    For an intermediate result that several later steps read: without this
    each of them would compute it again. The files outlive a lost executor,
    and their size tells the planner whether the table is small enough to be
    broadcast.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` dealt into parts of about ``rows``, for a step that is dear per row.

    A small file of many short rows is read by one task, and whatever is narrow
    stays in it; sizes on disk do not tell what a row costs. The rows are counted first.
    """
    return df.repartition(max(1, -(-df.count() // rows)))


def deal_shuffles(spark: SparkSession, rows: int) -> None:
    """Cut what is read and shuffled from now on finely enough for an input of ``rows``.

    Ids and object names pack so well that parts of a fair size on disk are many
    times that in a task's memory. Where there are few rows, adaptive execution
    puts the parts together again.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PART_BYTES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", PART_BYTES)
