"""Corpus pipeline: quality rules, language ID, exact dedup, near-duplicate join, best-fit packing.

Each stage takes (spark, docs, sf_dir), reads what its predecessor kept, and returns the kept documents with their
columns; the last returns where each piece of a document stands. ``run`` writes each stage's result as Parquet in the
shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, materialise, ship
from quern.llm.exact_dedup import dedup_exact
from quern.llm.jaccard import surplus
from quern.llm.packing import pack_documents
from quern.llm.quality import clean
from quern.llm.stringkernel import identify, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The least score is so far above the floor, as a part of what lies between the floor and 1.
LANG_MARGIN = 1 / 3


def least_score(languages: int) -> float:
    """Score from which a text counts as one of so many learned languages; 0.5 with four.

    The regressions of a text sum to about 2 - K for K languages, so the best score is 1 / K at least whatever the text.
    With one language there is nothing to tell it from, and every text with letters passes.
    """
    return 1 / languages + LANG_MARGIN * (1 - 1 / languages) if languages > 1 else 0.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents of their host share.

    Null and empty texts fail the rules and go. A null id or source is a value like others. Repeated rows stay or go together.
    """
    ship(spark)
    return clean(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; a null lang gets the predicted one. Learns from the stage's labelled documents.

    Null texts and those without letters go; so does all, if no document has a language. Repeated rows stay or go together.
    """
    ship(spark)
    model = train(docs.select("text", "lang"))
    found = identify(docs, model, "text", COLUMNS)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score(len(model[0]))))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document, with the largest doc_id; a null id is below all others, a null text equals an empty one.

    Of rows equal in id and text, one stays. Rows to drop are told by id and digest, so a dropped text doesn't come
    back by the id of another one.
    """
    found = materialise(dedup_exact(docs), "exact-decisions")
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__text")).distinct()
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    left = docs.select(*COLUMNS, digest.alias("__digest"))
    left = left.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__text")), "left_anti")
    # Rows repeated in id and text are found by their number; only those go through a shuffle.
    again = found.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__text"))
    again = materialise(again, "repeated-rows")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__text"))
    once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "__digest"])
    return left.join(again, same, "left_anti").unionByName(once).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id, a null id coming last; documents without words stay."""
    ship(spark)
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    return docs.select(*COLUMNS).join(materialise(surplus(docs), "near-surplus"), key == F.col("row_hash"), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, bin, offset of each piece; see ``pack_documents`` for nulls, ties and repeated rows."""
    ship(spark)
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("best-fit packing", packing_stage),
]

#: Language ID and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
