"""Each stage of the pipeline against brute force, on nulls, copies, clashing columns and an empty table."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import packing, quality_rules, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ["row", "key", "id", "own", "band", "high", "drop", "t1", "task", "chunk", "label_id", "keep"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """Documents of the small tables with copies, nulls and columns of names that the stages use inside."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = given.where("doc_id % 9 = 0")
    nulls = given.where("doc_id < 3").select((F.col("doc_id") + 100_000).alias("doc_id"), *[F.lit(None).cast(t).alias(c) for c, t in given.dtypes if c != "doc_id"])
    # two good documents in one, with a secret
    good = given.where("lang = 'en' and length(text) between 800 and 2500").orderBy("doc_id").limit(6).collect()
    with_secret = [(200_000 + i, f"{a['text']} {b['text']}\nauth: Zq8#vT!xLw2@pRk{i} and more", "en", a["source"], 0) for i, (a, b) in enumerate(zip(good[::2], good[1::2]))]
    out = given.unionByName(spark.createDataFrame(with_secret, given.schema))
    out = out.unionByName(copies).unionByName(copies.withColumn("doc_id", F.lit(None).cast("bigint"))).unionByName(nulls)
    for c in EXTRA:
        out = out.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    return out


@pytest.fixture(scope="module")
def tables(spark, sf_dir, docs, tmp_path_factory):
    """The input and the output of every stage, as lists of rows."""
    folder, now, out = tmp_path_factory.mktemp("stages"), docs, [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf_dir).write.parquet(str(folder / str(i)))
        now = spark.read.parquet(str(folder / str(i)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert now.columns == docs.columns
        out.append(now.collect())
    return out


def rest(row):
    return tuple(v for k, v in row.asDict().items() if k not in ("text", "n_chars"))


def test_quality_keeps_what_the_verdicts_keep(spark, sf_dir, docs, tables):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    told = quality_rules.verdicts(docs, labels=labels).where("kept").select("doc_id").collect()
    assert Counter(r["doc_id"] for r in tables[1]) == Counter(r["doc_id"] for r in told)
    assert not Counter(tables[1]) - Counter(tables[0]) and all(len(WORD.findall(r["text"])) >= 20 for r in tables[1])


def test_line_dedup_equals_brute_force(tables):
    sites, first = defaultdict(set), {}
    for r in tables[1]:
        for line in (r["text"] or "").split("\n"):
            if WORD.search(line):
                sites[line] |= {r["source"]} - {None}
                first[line] = min((x for x in (first.get(line), r["doc_id"]) if x is not None), default=None)
    want = Counter()
    for r in tables[1]:
        text = "\n".join(x for x in (r["text"] or "").split("\n") if len(sites[x]) < 10 or first[x] == r["doc_id"])
        want[rest(r), text, len(text)] += 1
    assert Counter((rest(r), r["text"], r["n_chars"]) for r in tables[2]) == want


def test_one_of_each_near_copy_group_stays(tables):
    sets = []
    for r in tables[2]:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([("whole", *w)] if w else []))
    different = sorted({s for s in sets if s}, key=len)
    root = {s: s for s in different}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            if 100 * len(a) < 80 * len(b):
                break
            if 100 * len(a & b) >= 80 * len(a | b) and find(a) is not find(b):
                root[find(a)] = find(b)
    least = {}
    for r, s in zip(tables[2], sets):
        if s:
            name = r["doc_id"] if r["doc_id"] is not None else float("inf")
            least[find(s)] = min(name, least.get(find(s), name))
    kept = [r["doc_id"] if r["doc_id"] is not None else float("inf") for r in tables[3]]
    assert sorted(kept) == sorted(list(least.values()) + [r["doc_id"] for r, s in zip(tables[2], sets) if not s])
    assert not Counter(tables[3]) - Counter(tables[2])


def test_secrets_are_masked_as_scanned(spark, docs, tables):
    rank = secret_scan.ranked_words(spark.createDataFrame([(r["text"],) for r in tables[3]], "text string"))
    rank |= {w: min(n, rank.get(w, n)) for w, n in secret_scan.RANK.items()}
    want = Counter()
    for r in tables[3]:
        text = r["text"] and secret_scan.mask(r["text"], secret_scan.scan(r["text"], secret_scan.MIN_BITS, rank))
        want[rest(r), text, text and len(text)] += 1
    assert Counter((rest(r), r["text"], r["n_chars"]) for r in tables[4]) == want
    assert any("[SECRET]" in (r["text"] or "") for r in tables[4])


def test_pieces_make_up_the_documents(tables):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in tables[4]:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, packing.END], "<u4")
        for at in range(0, len(ids), packing.LIMIT):
            want[r["doc_id"], at, len(ids[at : at + packing.LIMIT]), zlib.crc32(ids[at : at + packing.LIMIT].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in tables[5]) == want
    sequences = defaultdict(list)
    for r in tables[5]:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= packing.LIMIT
    assert sorted(sequences) == list(range(len(sequences)))


def test_an_empty_table_goes_through(spark, sf_dir, docs):
    now = docs.limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        assert out.collect() == []
        now = out if i + 1 < len(corpus_pipeline.STAGES) else now


def test_ties_between_packs_give_the_same_patterns():
    given = {5: 3, 3: 3, 2: 9}
    assert packing.patterns(given, 8) == packing.patterns(dict(reversed(given.items())), 8)
