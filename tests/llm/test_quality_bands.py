"""Bands of operator 8: broken words go, a wrong language code stays, labels set the width."""

import numpy as np

from lodestone.llm import quality_rules

SYLLABLES = {"xx": ["la", "ri", "mo", "ten", "shu", "ka", "vel", "dor"], "yy": ["gno", "ptil", "zur", "fex", "baw", "qui", "hym", "jod"]}


def prose(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(n))


def broken(rng, lang):
    return "".join(c + "-" * (rng.random() < 0.12) for c in prose(rng, lang))


def test_broken_words_go_and_a_wrong_language_code_stays(spark):
    rng = np.random.default_rng(5)
    given = [(i, prose(rng, ("xx", "yy")[i % 2]), ("xx", "yy")[i % 2]) for i in range(300)]
    given += [(900 + i, broken(rng, "xx"), "xx") for i in range(6)]
    given += [(950, prose(rng, "yy"), "xx"), (951, prose(rng, "xx", 30) + "\n" + prose(rng, "yy", 30), "yy")]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(docs).collect()}
    assert all(kept[i] for i in [*range(300), 950, 951])
    assert not any(kept[900 + i] for i in range(6))


def test_labels_set_the_width(spark):
    rng = np.random.default_rng(6)
    given = [(i, prose(rng, "xx"), "xx") for i in range(600)]
    # a style that is labelled good stays although the default width rejects it
    given += [(1000 + i, broken(rng, "xx"), "xx") for i in range(30)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in given], "doc_id bigint, quality int")
    plain = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(docs).collect()}
    told = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(docs, labels=labels).collect()}
    assert not any(plain[1000 + i] for i in range(30)) and sum(told[1000 + i] for i in range(30)) >= 25
    assert sum(told.values()) >= 0.99 * len(given)
