"""Helpers shared by the training-data operators: shared storage, tokens, bounded global numbering."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that they need no copy of it.

    Also bounds the bytes of an Arrow batch where the session doesn't, since rows alone don't bound long texts.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    if getattr(context, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"  # read by the driver's own file server alone
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._quern_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one is set in local mode; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quern-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder.

    The reread table carries no partitioning, so a join on it gets exchanges on both sides and
    adaptive execution can broadcast it (if below the threshold) or split its skewed partitions.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def besides(keep: list[str], *made: str) -> list[str]:
    """The columns to keep without those whose names, in any case, are names that the operator makes itself."""
    taken = {c.lower() for c in made}
    return [c for c in keep if c.lower() not in taken]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text; null gives an empty array."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (trimmed == ""), none).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def with_row_number(df: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """Add ``row_no`` (gapless from 0) and ``n_rows`` without sorting all rows in one task.

    Rows go to ``buckets`` hash buckets of all ``keys``; a row's number is the size of the buckets before
    its own plus its rank there in key order. It depends on the rows alone, not on files or partitions.
    The table of bucket sizes has ``buckets`` rows at most, which bounds what is broadcast.
    Rows equal in all keys are interchangeable; each gets a number of its own.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    sizes = df.select(bucket.alias("__b")).groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(every).alias("n_rows"),
    )
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(*keys)).cast("long") - 1
    ranked = df.withColumn("__b", bucket).withColumn("__rank", rank)
    return (
        ranked.join(F.broadcast(offsets), "__b")
        .withColumn("row_no", F.col("__before") + F.col("__rank"))
        .drop("__b", "__before", "__rank")
    )
