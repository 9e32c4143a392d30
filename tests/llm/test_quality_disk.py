"""Operator 8 with a model that is too large to broadcast: what it shuffles, and the same scores."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality_rules as Q


def shuffled(spark) -> int:
    """Bytes that all shuffles so far wrote."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_more_text_shuffles_less_than_half_its_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(Q, "BROADCAST_GRAMS", 0)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    wrote = []
    for times in (1, 25):  # the model's n-grams are the same
        before = shuffled(spark)
        copies = docs.crossJoin(spark.range(times).select(F.col("id").alias("copy"))).drop("copy").coalesce(1)
        assert Q.scored(copies).count() == times * docs.count()
        wrote.append(shuffled(spark) - before)
    assert wrote[1] - wrote[0] < 12 * size


def test_both_ways_give_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ["row", "own", "other", *Q.MEASURES, "perplexity", *Q.SCORES]
    monkeypatch.setattr(Q, "CHUNK", 100_000)
    out = []
    for broadcast in (1 << 21, 0):
        monkeypatch.setattr(Q, "BROADCAST_GRAMS", broadcast)
        out.append(sorted(Q.scored(docs).select(columns).collect(), key=lambda r: r["row"]["doc_id"]))
    assert len(out[0]) == docs.count() and any(r["other"] for r in out[0])
    for a, b in zip(*out):
        assert a[:-5] == b[:-5] and a["perplexity"] == pytest.approx(b["perplexity"], rel=1e-4)
        assert all(abs(a[k] - b[k]) <= 1 for k in Q.SCORES)


def test_both_models_are_the_same(spark):
    texts = ["abcab", "abd", "bca bca", "zq", "ab zq"]  # no byte follows d and q
    top = Q.count_grams(spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string"))
    found = {(r["order"], r["code"]): (r["logp"], r["low"], r["bow"]) for r in Q.trained(top).collect()}
    [(_, at)] = Q._grouped(top.toArrow())
    levels, _ = Q.kneser_ney(at["code"], at["c"])
    want = {(n, int(code)): row for n, (codes, *rows) in levels.items() for code, *row in zip(codes, *rows)}
    assert found.keys() == want.keys() and found[1, ord("q")][2] == 0
    assert all(found[k] == pytest.approx(tuple(want[k]), abs=1e-4) for k in want)
