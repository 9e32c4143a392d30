"""The pipeline's stages on a small fixture, and the registered queries against their SQL."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_keep_columns_and_clean_documents(spark, sf_dir, docs, tmp_path):
    now, kept = docs, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert now.dtypes == docs.dtypes, name
            kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    long_enough = {i for i, t in before.items() if len(WORD.findall(t)) >= 20}
    assert set(kept["quality rules"]) <= long_enough and len(kept["quality rules"]) > 0.8 * len(long_enough)
    assert set(kept["line dedup"]) == set(kept["quality rules"])
    # one document of each near-copy group, by brute force on five-word shingles
    sets = {}
    for i, t in kept["line dedup"].items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {("whole", *w)} if w else set()
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    assert set(kept["n-gram Jaccard join"]) == {i for i in sets if root[i] == i}
    assert set(kept["secret scans"]) == set(kept["n-gram Jaccard join"])
    assert now.agg(F.countDistinct("doc_id")).first()[0] == len(kept["secret scans"])


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    by_sequence = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert by_sequence.where("n <> end or n > 2048").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall()))
