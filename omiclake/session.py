"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "omiclake", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and the UTC clock the views rely on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a folder of our own where it is unset.

    On a cluster there is no such folder to be guessed, so that an unset one raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "omiclake")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_scratch: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    """Scratch tables go with the process, if its session still runs."""
    for spark, path in _scratch:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended before
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, "omiclake")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
