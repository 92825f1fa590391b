"""The training-data queries that SQL can express against their SQL; the others by their contract's columns and row counts."""

import duckdb
import pytest

from quern.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rounded(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted = db.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert sorted(wanted.columns) == order
    pick = [wanted.columns.index(c) for c in order]
    got = sorted((tuple(map(rounded, r)) for r in df.select(*order).collect()), key=repr)
    assert got == sorted((tuple(rounded(r[i]) for i in pick) for r in wanted.fetchall()), key=repr)


CONTRACTS = {
    "op2_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_sentencepiece": {"doc_id": "bigint", "ids": "array<int>", "n_ids": "bigint"},
    "op5_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op6_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_query_has_its_columns_and_a_row_a_document(spark, name):
    df = QUERIES[name](spark, SF)
    assert CONTRACTS[name].items() <= dict(df.dtypes).items()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in df.select("doc_id").collect()) == sorted(ids)
