"""Where operators put intermediate tables: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below spark.checkpoint.dir and read it back, which cuts its lineage and survives lost executors.

    Where the session names no folder, a local one is set in local mode; elsewhere that is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quern-')}")
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
