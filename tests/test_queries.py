"""Every registered query of the engine against its DuckDB SQL, and the streaming forms against their batch forms."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quern import registry
from quern.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(x):
    return round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE_SQL:
        assert df.count() >= 0
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = db.sql(registry.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert sorted(wanted.columns) == order
    pick = [wanted.columns.index(c) for c in order]
    got = sorted((tuple(rounded(x) for x in r) for r in df.select(*order).collect()), key=repr)
    assert got == sorted((tuple(rounded(r[i]) for i in pick) for r in wanted.fetchall()), key=repr)


def test_streaming_average_equals_the_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "value")
    source = str(tmp_path / "in")
    for k in range(2):
        table.filter(F.col("event_id") < 500 if k == 0 else F.col("event_id") >= 500).coalesce(1).write.mode("append").parquet(source)
    stream = events.read_events(spark, source, "event_id long, user_id long, value double", 1)
    query = events.running_ema(stream, "user_id", "event_id", "value").writeStream.outputMode("update").format("memory").queryName("averages").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = spark.table("averages").groupBy("key").agg(F.max_by(F.struct("ema", "n"), "n").alias("s")).select("key", "s.*")
    both = last.alias("s").join(events.batch_ema(table, "user_id", "event_id", "value").alias("b"), "key")
    assert both.count() == table.select("user_id").distinct().count()
    assert both.filter((F.abs(F.col("s.ema") - F.col("b.ema")) > 1e-6) | (F.col("s.n") != F.col("b.n"))).count() == 0


def test_streaming_counts(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    table.write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string")
    query = events.feedback_counts(stream, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).collect()[0][0] == table.count()
