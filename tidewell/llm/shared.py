"""Where jobs put intermediate tables: the folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one named in spark.checkpoint.dir."""
    return f"{shared_root(spark)}/tidewell-{spark.sparkContext.applicationId}"


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local session that names none (tests) gets one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/tidewell-shared"
    return root.rstrip("/")


def keep(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, so a lost executor costs no upstream work.

    free: let the driver collect its garbage at once, upon which Spark deletes the shuffle files of the finished job. For
    jobs of several large rounds; else those files stay until the driver's next collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if free:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def join_heavy(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join with right, which has one row a key and in `rows` how many left rows that meets (null keys meet none).

    A key with more than its share of all rows gets several copies of its right row, and its left rows are dealt to them by
    their contents, so that no task gets them all. Such keys number at most four for each shuffle partition, which is what
    is broadcast. right must be a kept table, as it is read three times.
    """
    share = max(1, int(right.agg(F.sum(rows)).first()[0] or 0) // (4 * int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    copies = F.ceil(F.col(rows) / share).cast("int")
    heavy = right.where(F.col(rows) > share).select(key, copies.alias("__copies"))
    dealt = left.withColumn("__own", F.xxhash64(*left.columns)).join(F.broadcast(heavy), key, "left")
    dealt = dealt.withColumn("__salt", F.coalesce(F.pmod("__own", F.col("__copies")), F.lit(0)).cast("int")).drop("__own", "__copies")
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1))).drop(rows)
    return dealt.join(spread.hint("merge"), [key, "__salt"]).drop("__salt")


def folder(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this application, and what the catalog says of them. Call it once results have been written.

    Indexes with a name or a folder of their own stay.
    """
    system, path = folder(spark, shared_dir(spark))
    inside = f"{system.makeQualified(path).toUri().getPath()}/"
    for t in spark.catalog.listTables():
        if t.name.startswith("digest_index_"):
            told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED `{t.name}`").collect()}
            if inside in told["Location"]:
                spark.sql(f"DROP TABLE `{t.name}`")
    system.delete(path, True)
