"""Exact dedup with a persistent digest index, bucketed and sorted by hash.

New rows are reduced to one row per digest (map-side first, so a text with millions of copies leaves one row per task),
anti-joined by sort-merge with the index and appended to it. Only ids and digests are ever shuffled.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import folder, join_heavy, keep, shared_dir, shared_root


class DigestIndex:
    """Table (digest, keep_id) holding each text that was ever kept.

    name: an index of this name is durable: it lies in the folder `tidewell-index` beside the applications' own, where any
    later application opens it, whatever its catalog holds; `path` puts it elsewhere. Without either the index is its maker's
    alone and goes with shared.clear. buckets: of a new index; default is the session's number of shuffle partitions, so that
    each bucket is written by one task. The folder's name tells the buckets of one that exists.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        own = f"digest_index_{uuid.uuid4().hex}"
        root = path or (f"{shared_root(spark)}/tidewell-index/{name}" if name else f"{shared_dir(spark)}/{own}")
        system, at = folder(spark, root)
        found = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
        told = [int(x.removeprefix("buckets-")) for x in found if x.startswith("buckets-")]
        self.buckets = told[0] if told else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = f"{root.rstrip('/')}/buckets-{self.buckets}"
        # The catalog's name follows from the folder, so two folders never share one; what it knows of a deleted folder is dropped.
        self.name = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:32]}" if name or path else own
        if spark.catalog.tableExists(self.name) and not told:
            spark.sql(f"DROP TABLE `{self.name}`")

    def rows(self, kind: str = "bigint") -> DataFrame:
        """kind: of keep_id, in a new index."""
        if not self.spark.catalog.tableExists(self.name):
            system, path = folder(self.spark, self.path)
            system.mkdirs(path)
            self.spark.sql(f"CREATE TABLE `{self.name}` (digest STRING, keep_id {kind}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """groups: digest, keep_id; digests that the index has already are left out by a sort-merge anti-join."""
        known = self.rows(dict(groups.dtypes)["keep_id"])
        self.write(groups.select("digest", "keep_id").join(known.hint("merge"), "digest", "left_anti"), "append")

    def write(self, rows: DataFrame, mode: str) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).mode(mode).format("parquet").saveAsTable(self.name)
        )

    def compact(self) -> None:
        """One sorted file a bucket again, after many appends."""
        self.write(keep(self.rows(), "index-copy"), "overwrite")


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. The batch is appended to the index.

    Texts are equal when byte-identical. Within a batch the largest id stays; a text that the index holds from an earlier
    batch keeps that id, and all its new copies go. group_size counts the batch's rows of the text.
    Null texts count as empty, empty texts are equal to each other. Null ids lose to all others. Of repeated rows with the
    same id and text one stays. Other columns aren't read. An empty table gives no rows. Running a batch again gives the
    same result: its texts are in the index under its own ids.
    """
    rows = keep(
        docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
        .groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")),
        "digests",
    )
    groups = keep(rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("rows")), "digest-groups")
    index.append(groups)
    found = keep(groups.drop("keep_id").join(index.rows().hint("merge"), "digest"), "indexed-groups")
    return (
        join_heavy(rows, found, "digest", "rows")
        # A row of any number of copies comes back so often, a million from each list.
        .select("id", "keep_id", "group_size", "digest", "n", F.explode(F.expr("sequence(0L, (n - 1) div 1000000)")).alias("million"))
        .select("id", "keep_id", "group_size", "digest", F.explode(F.expr("sequence(million * 1000000 + 1, least(n, (million + 1) * 1000000))")).alias("copy"))
        .select(
            F.col("id").alias(id_col), "keep_id", "group_size",
            ((F.col("copy") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("digest").alias("text_sha256"),
        )
    )


def drop_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns under any name; of wholly equal (id, text) rows, one."""
    # One exact key without nulls deals the rows out once, for the join and for the last step.
    key = lambda digest, id_: F.concat_ws("|", digest, F.col(id_).cast("string"))
    kept = exact_dedup(docs, index, id_col, text_col).where("kept").select(key("text_sha256", id_col).alias("key"))
    full = docs.select(key(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), id_col).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return full.join(kept.hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
