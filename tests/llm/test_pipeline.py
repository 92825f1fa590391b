"""The pipeline's language stage on texts of learned languages and of none."""

import random

from pyspark.sql import functions as F

from corpus_pipeline import COLUMNS, language_stage

SF = "/root/testdata/sf0.001"


def test_foreign_texts_go_and_clean_ones_stay(spark):
    rng = random.Random(1)
    noise = lambda first, last: " ".join("".join(chr(rng.randint(first, last)) for _ in range(rng.randint(1, 8))) for _ in range(200))
    scripts = [(0x430, 0x44F), (0x3B1, 0x3C9), (0x4E00, 0x8FFF), (97, 122)]
    foreign = [(-1 - k, noise(*scripts[k % 4]), None, "s", 0) for k in range(20)]
    foreign.append((-21, "1 2 3", None, "s", 0))
    clean = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).filter("text rlike '(\\\\S+\\\\s+){50}'")
    bare = clean.filter("doc_id % 10 = 3").withColumn("lang", F.lit(None).cast("string"))
    docs = clean.filter("doc_id % 10 <> 3").unionByName(bare).unionByName(spark.createDataFrame(foreign, clean.schema))
    got = {r["doc_id"]: r["lang"] for r in language_stage(spark, docs, SF).collect()}
    wanted = {r["doc_id"]: r["lang"] for r in clean.collect()}
    assert len(wanted) > 100 and got == wanted
