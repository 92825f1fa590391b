"""Sharding: a keyed permutation of global row numbers deals rows to shards; native, no Python on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, with_row_number
from .feistel import permute


def shard(df: DataFrame, keys: list[str], shards: int, key: int = 20240229, buckets: int = 1024) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long) by the law `rows`: counts of shards differ by one at most.

    A row's global number goes through a Feistel permutation with cycle walking; the permuted number's
    remainder by ``shards`` is the shard and its quotient the slot, so slots are gapless from 0. Both can be
    computed for any row number without the other rows.

    Nulls in ``keys`` are values like any other; rows equal in all keys each get a place; an empty input
    gives no rows. Other columns pass through; the columns shard, slot, row_no and n_rows are replaced.
    """
    plain = df.drop("shard", "slot", "row_no", "n_rows")
    place = permute(F.col("row_no"), F.col("n_rows"), key)
    return (
        with_row_number(plain, keys, buckets)
        .withColumn("__place", place)
        .withColumn("shard", (F.col("__place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"__place div {int(shards)}"))
        .drop("__place")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23, law `rows`. The text itself isn't shuffled, only its size and checksum."""
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    return shard(rows, ["doc_id", "text_crc32", "size"], 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
