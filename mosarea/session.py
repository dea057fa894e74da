"""Session helpers: recommended settings and lineage cutting."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

# Settings a cluster job should run with; nothing here depends on data size.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("mosarea")
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = tempfile.mkdtemp(prefix="mosarea-checkpoint-")
    context.setCheckpointDir(shared)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, for tables that a job writes and reads again."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    Used before an iteration re-reads the same aggregate many times: losing an
    executor then costs a file read, not the whole upstream job.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    written = df.checkpoint(eager=True)
    # fresh column identities: the result may be joined with its own inputs
    return written.select(*[F.col(f"`{name}`").alias(name) for name in written.columns])


def written_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the files.

    Unlike after :func:`cut_lineage`, joins know the true size: rows that were unfolded from a small table
    are not taken for a small table and sent through the driver.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Same effect as ``spark-submit --py-files``, for sessions started elsewhere.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="mosarea-py-")) / "mosarea"
    spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    _SHIPPED.add(application)
