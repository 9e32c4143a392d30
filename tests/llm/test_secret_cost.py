"""Operator 3's price against the minimum over all segmentations, its words, and clean prose."""

import math
import random

from lodestone.llm import secret_scan as S

RANK = S.RANK | {"ingredient": 40, "northwestern": 300, "relationship": 120, "ring": 9}


def brute_force(value, rank):
    """The least price of cutting the value into spans, every span tried."""
    low = value.lower()
    plain = low.translate(S.LEET)

    def span(a, b):
        out = sum(map(S.char_bits, value[a:b]))
        for word, extra in ((low[a:b], 0), (plain[a:b], 2)):
            if b - a > 1 and word in rank:
                out = min(out, math.log2(rank[word] + 1) + extra + (0 if value[a:b] == low[a:b] else 2))
        if any(p.fullmatch(low, a, b) for p in S.DATES):
            out = min(out, S.YEAR_BITS if b - a == 4 else S.DATE_BITS)
        if b - a >= 3:
            for p in range(1, (b - a) // 2 + 1):
                if all(value[k] == value[k - p] for k in range(a + p, b)):
                    out = min(out, sum(map(S.char_bits, value[a : a + p])) + math.log2((b - a) / p))
            steps = [S._step(low[k - 1], low[k]) for k in range(a + 1, b)]
            if None not in steps:
                out = min(out, S.WALK_BITS + math.log2(b - a) + S.TURN_BITS * sum(x != y for x, y in zip(steps, steps[1:])))
        return out + S.SPAN_BITS

    best = [0.0]
    for b in range(1, len(value) + 1):
        best.append(min(best[a] + span(a, b) for a in range(b)))
    return best[-1]


def test_price_is_the_minimum_over_all_segmentations():
    rng = random.Random(7)
    parts = ["ab", "abc", "qwe", "asdf", "1234", "1998", "20240131", "31-12-1999", "password", "P4ssw0rd", "ring", "aaaa", "xyzxyz", "Zq", "#", "é", "20", "2020", "987", "test", "abcdeabcde"]
    for n in range(3000):
        if n % 2:
            value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        else:
            value = "".join(rng.choice(rng.choice(["ab", "abc1", "qwertyuiop", "1234567890", "aA1!"])) for _ in range(rng.randint(1, 18)))
        want = brute_force(value, RANK)
        assert math.isclose(S.guess_bits(value, rank=RANK), want, abs_tol=1e-9), value
        limit = rng.choice([20.0, 36.0])
        got = S.guess_bits(value, limit, RANK)
        assert math.isclose(got, want, abs_tol=1e-9) if want < limit else got >= limit, value


def test_words_are_ranked_by_their_count_in_all_documents(spark):
    texts = ["Thing thing other, zebra9zebra", "thing other éa xy", None, "", "unique", "a" * 30 + " a" * 30, "end", "end of"]
    rank = S.ranked_words(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert list(rank) == ["thing", "end", "other", "zebra"]
    assert list(S.ranked_words(spark.createDataFrame([(t,) for t in texts], "text string"), size=2)) == ["thing", "end"]


def test_clean_prose_has_no_guess_spans(spark):
    prose = ["compass: northwestern winds", "auth: relationship status", "the passphrase: ingredient list", "credentials: northwestern", "bypass: qz81kd92mxw0", "authentic: Zq8vTxLw2pRk9", "bearer: relationship"]
    held = [f"{i} northwestern relationship ingredient status" for i in range(5)]
    rows = [(i, t) for i, t in enumerate(prose + held)] + [(99, "auth: Zq8#vT!xLw2@pRk9"), (100, "userPassword: Zq8#vT!xLw2@pRk9")]
    out = {r["doc_id"]: r["n_guess"] for r in S.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {i: int(i >= 99) for i, _ in rows}


def test_long_values_stay_cheap_to_price():
    rng = random.Random(5)
    for value in ("a" * 30_000, "ab" * 20_000, "qwertyuiop" * 3_000, "".join(rng.choices("ab", k=20_000)), "".join(rng.choices("abcdefghij0123456789", k=30_000)), "password" * 4_000):
        S.guess_bits(value, S.MIN_BITS)
