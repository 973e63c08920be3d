"""Continuous readings: windows, sessions, the last value per site, and late rows as an output of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replay(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over Parquet files as they arrive; ts becomes a timestamp, as watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily(stream: DataFrame, key: str, value: str, delay: str = "1 day") -> DataFrame:
    """Per key and day: n, least, sum; rows later than the delay no longer count."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.sum(value).alias("total")).select(F.col("window.start").alias("day"), key, "n", "least", "total")


def sliding(stream: DataFrame, key: str, value: str, length: str = "90 days", step: str = "30 days", delay: str = "1 day") -> DataFrame:
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", length, step), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")


def bursts(stream: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Runs of readings at most a gap apart."""
    s = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key)
    return s.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def analyzers(stream: DataFrame, key: str, per_day: int = 12, days: int = 2, delay: str = "60 days") -> DataFrame:
    """(key, day): sent once, when a key has had per_day readings on its `days`-th day.

    State: the counts of the days from `delay` before the watermark on; earlier days are closed, and rows of them no longer
    count. How many closed days were full stays known.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        full, counts, done = state.get if state.exists else (0, "", False)
        closed = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms").strftime("%Y-%m-%d") if state.getCurrentWatermarkMs() > 0 else ""
        open_ = {d: int(n) for d, n in (x.split("=") for x in counts.split(";") if x) if d >= closed}
        sent = None
        for frame in frames:
            for day, n in frame.groupby(frame["ts"].dt.strftime("%Y-%m-%d")).size().items():
                if done or day < closed or open_.get(day, 0) >= per_day:
                    continue
                open_[day] = open_.get(day, 0) + int(n)
                if open_[day] >= per_day:
                    full += 1
                    if full >= days:
                        done, sent = True, day
        state.update((full, ";".join(f"{d}={n}" for d, n in sorted(open_.items())), done))
        if sent:
            yield pd.DataFrame({key: [group[0]], "day": [sent]})

    kind = dict(stream.dtypes)[key]
    return stream.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, day string", "full int, counts string, done boolean", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there into Parquet files under `path` and reads the result; checkpoints lie beside it.

    complete: each batch replaces what the last one wrote; append: batches add to it. Nothing passes the driver.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        at = f"{path}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(f"{path}/latest")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == spark.read.parquet(f"{path}/latest").first()["number"])
    return rows.drop("batch")


def upsert_latest(stream: DataFrame, key: str, path: str, checkpoint: str):
    """Keeps each key's last row in a Parquet table: every batch is merged with it, written aside and swapped in by its number.

    Returns the started query. Readers take the highest `version=` folder.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        rows = batch
        if number:
            rows = batch.unionByName(spark.read.parquet(f"{path}/version={number - 1}"))
        last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "ts").alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(stream: DataFrame, ts: str, delay: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(on time, late): the stream's rows by whether they lie before the watermark, which together are all of them.

    The watermark is what Spark's own would be: the latest time of all earlier batches less the delay. It is kept as a row for
    each batch in a table of its own, so a batch that runs again after a failure is judged alike and overwrites its own files.
    Rows without a time are on time. Runs over all that is there; a later call with the same path goes on from there.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "latest timestamp, batch long"
        spark.createDataFrame([], "latest timestamp").write.mode("overwrite").parquet(f"{path}/seen/batch=-1")
        before = spark.read.schema(schema).parquet(f"{path}/seen").where(F.col("batch") < number).agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("__mark"))
        marked = batch.crossJoin(F.broadcast(before)).withColumn("__late", F.coalesce(F.col(ts) < F.col("__mark"), F.lit(False))).drop("__mark")  # one row
        for late, name in ((False, "on_time"), (True, "late")):
            marked.where(F.col("__late") == late).drop("__late").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.agg(F.max(ts).alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    read = lambda name: stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/{name}")
    return read("on_time"), read("late")
