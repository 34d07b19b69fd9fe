"""Every registered query that has SQL, held against DuckDB on the smallest tables."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom import catalog

SF = "/root/testdata/sf0.001"


def rows(cursor_rows):
    return sorted(tuple("null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in cursor_rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = db.sql(f"select * from ({catalog.oracle_sql()[name]})")
    assert columns == sorted(expected.columns)
    assert rows(df.select(*columns).collect()) == rows(db.sql(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall())


def test_spans_expand_to_their_bytes(spark):
    found = catalog.queries()["expanded_spans"](spark, SF)
    assert found.where("not ok").count() == 0 and found.count() > 0


def test_relocated_windows_are_the_passages(spark):
    found = catalog.queries()["relocated_windows"](spark, SF)
    assert found.where("not same_bytes").count() == 0


def test_native_classification_agrees_with_the_kernel(spark):
    from textloom.operators import matching

    pairs = catalog.queries()["match_classification"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = pairs.select("q", "c", pairs.match_kind.alias("native")).join(docs.selectExpr("doc_id as q", "text as source"), "q").join(docs.selectExpr("doc_id as c", "text as candidate"), "c")
    assert matching.classify_pairs(texts).where("native <> match_kind").count() == 0


def test_passage_at_the_end_of_a_very_long_document(spark, tmp_path):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(60)
    spark.createDataFrame([(1, f"{words(130_000)} {passage}"), (2, words(80))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = catalog.queries()["benchmark_contamination"](spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 7)]


def test_documents_of_one_row_group_are_many_tasks(spark, tmp_path):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(3000))) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog._spread_fp(spark, str(tmp_path), ("token_fps",)).select("doc_key", F.spark_partition_id().alias("task"))
    assert made.select("task").distinct().count() > 1 and made.count() == 400
