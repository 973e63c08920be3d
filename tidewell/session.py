"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the folder in spark.checkpoint.dir, which all executors share.

    A folder of this machine is set only where a local session names none (tests).
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def keep(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back.

    As cut, but the plan that comes after it also knows sizes, and no longer the conditions that held on the way, which
    Catalyst carries through a checkpoint and which grow with each join of a long job.
    """
    path = f"{shared_folder(df.sparkSession)}/tidewell-{df.sparkSession.sparkContext.applicationId}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/tidewell-checkpoints"
    return root


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; a cluster's own settings aren't touched."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("tidewell").config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
