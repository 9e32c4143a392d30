"""What the text queries move between tasks when they build their index, and documents that have several rows."""

import shutil
import time

import duckdb
import pytest

from lodestone.operators import text_index
from lodestone.plans import catalog


def shuffled(spark):
    """Bytes that tasks have written to shuffles so far."""
    for _ in range(2):  # the second job's end brings the first one's figures
        time.sleep(0.3)
        spark.range(1).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("name", ["search_all_index_terms", "rank_tfidf", "token_stats", "common_terms"])
def test_index_is_built_without_a_shuffle_of_postings(spark, sf_dir, tmp_path, name):
    """A copy of the table is not known to the session, so its index is built here."""
    shutil.copy(f"{sf_dir}/documents.parquet", tmp_path / "documents.parquet")
    before = shuffled(spark)
    catalog.QUERIES[name](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    moved = shuffled(spark) - before
    index = sum(len(open(f.removeprefix("file://"), "rb").read()) for f in catalog.doc_index(spark, str(tmp_path)).inputFiles())
    assert moved < 3 * index  # the terms go twice; postings went before, seven times the index


ROWS = [(1, "license public license zeta"), (1, "license version"), (2, "public"), (2, "public"), (3, ""), (4, None), (None, "idiot one"), (None, "idiot"), (5, "of the and")]


@pytest.mark.parametrize("name", ["search_all_index_terms", "token_stats", "search_all_terms", "search_phrase", "search_posting_list"])
def test_documents_in_several_rows(spark, tmp_path, name):
    spark.createDataFrame(ROWS, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns, want = [c[0] for c in want.description], want.fetchall()
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_common_terms_count_a_document_of_several_rows_once(spark, tmp_path):
    rows = [(i % 100, f"common word{i}" + " longer" * (i // 100)) for i in range(150)]  # 100 documents have common, 50 have longer
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in catalog.QUERIES["common_terms"](spark, str(tmp_path)).collect()] == [("common", 100)]


def test_postings_of_a_row(spark):
    rows = spark.createDataFrame([("a", "zeta beta Zeta, alpha beta zeta"), ("b", "the"), ("c", None)], "doc_id string, text string")
    want = {("alpha", "a", 6, 3, 1, (3,)), ("beta", "a", 6, 3, 2, (1, 4)), ("zeta", "a", 6, 3, 3, (0, 2, 5))}
    for once in (True, False):
        index = text_index.postings(rows, once=once)
        assert dict(index.dtypes)["freq"] == "bigint" and index.columns == ["term", "doc", "doc_len", "doc_terms", "freq", "positions"]
        assert {(r["term"], r["doc"], r["doc_len"], r["doc_terms"], r["freq"], tuple(r["positions"])) for r in index.collect()} == want


def test_a_text_is_tokenized_once(spark):
    rows = spark.createDataFrame([("a", "zeta beta")], "doc_id string, text string")
    assert text_index.postings(rows, once=True)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
