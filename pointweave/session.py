"""Session and checkpoint helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "pointweave") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _own_folder(spark: SparkSession, wanted: str) -> str:
    """A folder of this machine, which only a local session may use."""
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {wanted} to a folder that all executors share")
    return tempfile.mkdtemp(prefix="pointweave-")


def output_folder(spark: SparkSession, what: str) -> str:
    """A new folder for results under ``spark.pointweave.outputDir``, else under ``spark.checkpoint.dir``.

    Only a local session without either (tests) gets a local folder.
    """
    top = spark.conf.get("spark.pointweave.outputDir", None) or spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark, "spark.checkpoint.dir")
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where neither a wheel nor the source folder is installed."""
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="pointweave-"), "pointweave"), "zip", os.path.dirname(here), "pointweave")
    spark.sparkContext.addPyFile(archive)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a local folder instead.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark, "spark.checkpoint.dir"))
    return df.checkpoint()
