"""Exact dedup: a persistent digest index, bucketed and sorted by digest; native, no Python on executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, shared_path


#: Digests of a bucket at most, when the table is made.
PER_BUCKET = 4_000_000


class DigestIndex:
    """Table of one row per digest: (digest, keep_id, group_size), bucketed and sorted by digest.

    ``add(batch)`` dedups a batch within itself and against the index: the batch is pre-aggregated per digest,
    new digests are found by a sort-merge anti-join (the index side needs no shuffle) and appended. Within one
    batch the row with the largest id stays; a text that is in the index already stays where it was first added,
    since what was released earlier can't be taken back. ``group_size`` is that of the batch.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark, self.table, self.buckets = spark, table or f"quern_digests_{uuid.uuid4().hex}", buckets
        self.path = path or shared_path(spark, "digests")

    def _create(self, digests: int) -> None:
        """The table, if there is none yet; without a stated number, buckets follow the first batch's number of digests."""
        if self.spark.catalog.tableExists(self.table):
            found = [r["data_type"] for r in self.spark.sql(f"DESCRIBE FORMATTED {self.table}").collect() if r["col_name"] == "Num Buckets"]
            self.buckets = int(found[0])
            return
        self.buckets = self.buckets or max(24, -(-digests // PER_BUCKET))
        self.spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def drop(self) -> None:
        """Forget the table; its files are in the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, batch: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Rows (id, keep_id, group_size, kept, text_sha256), one for each row of the batch.

        Null texts count as empty. A null id is below every other id; of rows equal in id and text one stays
        (see ``kept``: it then holds for each of the equal rows' ids, so callers need unique ids). An empty
        batch gives no rows. Other columns of the batch don't matter.
        """
        ids = batch.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256).alias("digest"),
        )
        groups = materialise(
            ids.groupBy("digest").agg(F.max("doc_id").alias("top_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups"
        )
        self._create(groups.count())
        new = groups.join(self.read().hint("merge"), "digest", "left_anti").select("digest", F.col("top_id").alias("keep_id"))
        # One file a bucket: the rows are dealt by the hash that the bucketed writer uses.
        (
            new.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.table)
        )
        places = materialise(groups.join(self.read().hint("merge"), "digest").select("digest", "keep_id", "group_size"), "digest-places")
        return _join_back(ids, places)


def _join_back(ids: DataFrame, places: DataFrame, least: int = 64, parts: int = 10_000) -> DataFrame:
    """Give each id its digest's row of ``places`` without one task having all copies of a text.

    Texts with more copies than a ten-thousandth of all rows (and than 64) are fewer than ten thousand,
    whatever the input, and are broadcast; no text of the shuffled rest has more copies than that.
    """
    total = places.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("total")).collect()[0]["total"]
    many = max(least, total // parts)
    hot = F.broadcast(places.filter(F.col("group_size") > many).select("digest", *[F.col(c).alias(f"hot_{c}") for c in ("keep_id", "group_size")]))
    # As many rows as there are hot digests at most, each a digest: which rows to shuffle is known at once.
    flagged = ids.join(hot, "digest", "left")
    of_hot = flagged.filter(F.col("hot_group_size").isNotNull()).select("doc_id", "digest", F.col("hot_keep_id").alias("keep_id"), F.col("hot_group_size").alias("group_size"))
    rest = flagged.filter(F.col("hot_group_size").isNull()).select("doc_id", "digest")
    rest = rest.join(places.filter(F.col("group_size") <= many), "digest").select("doc_id", "digest", "keep_id", "group_size")
    return of_hot.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("digest").alias("text_sha256")
    )


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """Decisions for every row of ``docs`` against ``index``, or against a new one that is dropped again."""
    used = index or DigestIndex(docs.sparkSession)
    found = used.add(docs, id_col, text_col)
    if index is None:
        used.drop()
    return found


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id (largest doc_id of equal texts), group_size, kept, text_sha256."""
    return dedup_exact(documents(spark, sf_dir))
