"""Operator 8's model, scores and bands against brute force, on both ways of applying the model."""

from collections import Counter

import numpy as np
import pytest

from lodestone.llm import quality_rules as Q

SYLLABLES = ["la", "ri", "mo", "ten", "shu", "ka", "vel", "dor", "é"]


def fixture():
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("".join(rng.choice(SYLLABLES, 3)) for _ in range(int(rng.integers(22, 60)))), ("xx", "yy", None)[i % 3]) for i in range(90)]
    noise = "".join(chr(c) for c in rng.integers(33, 127, 900))
    return [*rows, (900, " ".join(noise[i : i + 9] for i in range(0, 900, 9)), "xx"), (901, None, "xx"), (902, "", "yy"), (903, "a b", "zz"), (904, "GRM " * 30, "yy"), (905, rows[0][1], "yy")]


def brute_model(texts):
    """log2 probability of n-grams at any order, by dictionaries."""
    codes = [b"\0" * (Q.ORDER - 1) + t for t in texts]
    levels = {Q.ORDER: Counter(s[i - Q.ORDER + 1 : i + 1] for s in codes for i in range(Q.ORDER - 1, len(s)))}
    for n in range(Q.ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def cuts(counts):
        n = [sum(v == k for v in counts.values()) for k in range(1, 5)]
        out = [0.5, 1.0, 1.5]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            out = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else out[k] for k in range(3)]
        return [min(max(x, 0), k + 1) for k, x in enumerate(out)]

    cut = {n: cuts(c) for n, c in levels.items()}
    follow = {n: {} for n in levels}
    for n, counts in levels.items():
        for g, c in counts.items():
            follow[n].setdefault(g[:-1], []).append(c)

    def probability(gram):
        if not gram:
            return 1 / 256
        n = len(gram)
        seen = follow[n].get(gram[:-1])
        if not seen:
            return probability(gram[1:])
        less = lambda c: cut[n][min(c, 3) - 1] if c else 0
        own = levels[n].get(gram, 0)
        return (own - less(own) + sum(map(less, seen)) * probability(gram[1:])) / sum(seen)

    return codes, probability


def brute_scores(rows):
    """Per document: bits a byte and the scores at both orders."""
    texts = {lang: [(t or "").encode() for _, t, x in rows if x == lang] for lang in {r[2] for r in rows}}
    model = {lang: brute_model(t) for lang, t in texts.items()}

    def bits(lang, text, a=0, b=None):
        padded, p = b"\0" * (Q.ORDER - 1) + text, model[lang][1]
        at = range(a, len(text) if b is None else b)
        return np.array([[-np.log2(p(padded[i + Q.ORDER - n : i + Q.ORDER])) for i in at] for n in (Q.ORDER, Q.LOW)]).sum(axis=1)

    size = {lang: sum(map(len, t)) for lang, t in texts.items()}
    usual = {lang: sum(bits(lang, t) for t in own) / size[lang] for lang, own in texts.items() if size[lang]}
    out = []
    for _, text, lang in rows:
        text = (text or "").encode()
        if not text:
            out.append((0, 0, 0))
            continue
        own = bits(lang, text) / len(text)
        score = own - usual[lang]
        if max(score) > Q.FAR:
            white = b" \t\n\x0b\x0c\r"
            starts = [i for i in range(len(text)) if text[i] not in white and (i == 0 or text[i - 1] in white)]
            edges = sorted({0, *starts[Q.RUN :: Q.RUN], len(text)})
            own, score = np.zeros(2), np.zeros(2)
            for a, b in zip(edges, edges[1:]):
                price = {x: bits(x, text, a, b) for x in sorted(usual, key=lambda x: "" if x is None else "=" + x)}
                for k in range(2):
                    best = min(price, key=lambda x: price[x][k])
                    own[k] += price[best][k] / len(text)
                    score[k] += (price[best][k] - usual[best][k] * (b - a)) / len(text)
            score = np.maximum(score, 0)
        out.append((own[0], *score))
    return out


@pytest.mark.parametrize("broadcast", [1 << 21, 0])
def test_scores_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(Q, "BROADCAST_GRAMS", broadcast)
    monkeypatch.setattr(Q, "BLOCK", 700)  # texts are priced in parts
    monkeypatch.setattr(Q, "CHUNK", 3000)
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    found = {r["row"]["doc_id"]: r for r in Q.scored(docs).collect()}
    assert len(found) == len(rows)
    for (i, text, _), (bits, high, low) in zip(rows, brute_scores(rows)):
        assert np.log2(found[i]["perplexity"]) == pytest.approx(bits, abs=1e-3), text
        assert abs(found[i]["high"] - high * Q.BINS) <= 0.51 + 1e-3 * Q.BINS and abs(found[i]["low"] - low * Q.BINS) <= 0.51 + 1e-3 * Q.BINS


@pytest.mark.parametrize("labelled", [0, 60])
def test_bands_and_kept_equal_brute_force(spark, monkeypatch, labelled):
    monkeypatch.setattr(Q, "LEAST_GOOD", 25)
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(labelled)] + [(900, 0)], "doc_id bigint, quality int")
    found = [r for r in Q.scored(docs).collect()]
    want, stats = {}, {}
    for own in {r["own"] for r in found}:
        for k in ("high", "low"):
            x = np.array([r[k] for r in found if r["own"] == own and r["n_words"] >= Q.MIN_WORDS], float)
            if len(x):
                middle = np.median(x)
                stats[own, k] = middle, max(Q.LEAST_DEVIATION, np.median(abs(x - middle)))
    good = {(own, k): [(r[k] - stats[own, k][0]) / stats[own, k][1] for r in found if r["own"] == own and r["n_words"] >= Q.MIN_WORDS and r["row"]["doc_id"] < labelled] for own, k in stats}
    tail = (1 - Q.GOOD_SHARE) / 2

    def inside(own, scores):
        out = True
        for k, score in scores.items():
            if (own, k) not in stats:
                return None
            near, every = good[own, k], [x for (_, j), z in good.items() for x in z if j == k]
            use = near if len(near) >= 25 else every if len(every) >= 25 else None
            down, up = (max(Q.LEAST_WIDTH, -np.quantile(use, tail)), max(Q.LEAST_WIDTH, np.quantile(use, 1 - tail))) if use else (Q.LOWER, Q.UPPER)
            middle, deviation = stats[own, k]
            out &= middle - down * deviation - 1e-9 <= score <= middle + up * deviation + 1e-9
        return bool(out)

    for r in found:
        sound = r["n_words"] >= Q.MIN_WORDS and 100 * r["n_repeat_words"] <= Q.MAX_REPEAT * r["n_words"]
        own = inside(r["own"], {"high": r["high"], "low": r["low"]})
        want[r["row"]["doc_id"]] = sound and (own is not False or inside(r["other"], {"high": r["other_high"], "low": r["other_low"]}) is True)
    out = {r["doc_id"]: r for r in Q.verdicts(docs, labels=labels).collect()}
    assert {i: r["kept"] for i, r in out.items()} == want
    assert not out[900]["kept"] and not out[900]["base_failed"]


@pytest.mark.parametrize("texts", [[None], [""], ["a b"], ["", " \n "], ["one"], ["x" * 1024 + "\n" + "y" * 1024], ["1 2 3 4 5 6 7"], ["w " * 8]])
def test_small_tables(spark, texts):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    out = Q.verdicts(docs).collect()
    assert [r["n_words"] for r in sorted(out)] == [len((t or "").split()) for t in texts] and not any(r["kept"] for r in out)


def test_lines_and_windows_are_told_apart(spark):
    morse = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    mirror = morse.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{morse}\n{mirror}", "en"), (2, f"{morse}\n{mirror}\n{morse}", "en"), (3, " ".join([morse, *"1234567", mirror, *"1234567"]), "en")], "doc_id bigint, text string, lang string")
    out = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in Q.verdicts(docs).collect()}
    assert out == {1: (0, 0), 2: (1, 0), 3: (0, 0)}
