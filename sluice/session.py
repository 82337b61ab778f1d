"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the session names.  Only a local session without one, as in tests, gets a folder of its
    own; on a cluster that would lie on one machine's disk, so it is an error there."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sluice-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The same rows as a table written to the shared folder: lineage ends there, and a lost executor costs a read."""
    spark = df.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4()}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a context."""
    context = spark.sparkContext
    if getattr(context, "_sluice_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sluice-package-")) / "sluice.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent).as_posix())
    context.addPyFile(str(archive))
    context._sluice_shipped = True


def scan(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table for work in Python that is heavy per row.  Only its layout may change: files with fewer splits than the cluster
    has cores would leave cores idle, so their rows are dealt out evenly; all rows are read either way."""
    df = table(spark, folder, name)
    if columns:
        df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
