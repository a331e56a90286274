"""The Katz model against a plain dictionary version, and its distributions' sums."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm.katz import START, discounts, encode, fit_katz, pack, score_katz, unpack


def tokens_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w] + [""]


class Plain:
    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for text in texts:
            w = tokens_of(text)
            self.words.update(w)
            self.pairs.update(zip([None, *w[:-1]], w))
        self.total = sum(self.words.values())
        self.d1 = discounts(Counter(self.words.values()))
        self.d2 = discounts(Counter(self.pairs.values()))
        kept = sum(self.down(self.d1, n) for n in self.words.values())
        self.over, self.left = (self.total, self.total - kept) if kept < self.total - 1e-9 else (self.total + 1, 1)
        self.after = {}
        for (v, w), n in self.pairs.items():
            self.after.setdefault(v, {})[w] = n

    def down(self, d, n):
        return n * (d[n] if n < len(d) else 1)

    def single(self, w):
        return self.down(self.d1, self.words[w]) / self.over if self.words[w] else self.left / self.over

    def given(self, v, w):
        after = self.after.get(v)
        if not after:
            return self.single(w)
        n = sum(after.values())
        kept = sum(self.down(self.d2, m) for m in after.values())
        over, left = (n, n - kept) if kept < n * (1 - 1e-12) else (n + 1, 1)
        if w in after:
            return self.down(self.d2, after[w]) / over
        return left / over / (1 - sum(map(self.single, after))) * self.single(w)

    def score(self, text):
        w = tokens_of(text)
        known = sum(self.words[x] > 0 for x in w)
        base = sum(math.log10((self.words[x] + 1) / (self.total + len(self.words) + 1)) for x in w)
        return len(w), known, base, sum(math.log10(self.given(v, x)) for v, x in zip([None, *w[:-1]], w))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice(['Wort', 'mot', 'word', 'é'])}{i}" for i in range(150)]
    weights = [1 / (i + 1) for i in range(150)]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))
        rows.append((rng.choice([i, i, 7, None]), text, rng.random() < 0.8))
    rows += [(1, None, True), (2, "", False), (3, "UNSEEN wort0 never\xa0met", False), (4, "wort0 " * 5000, True), (5, "only\x85here", None)]
    return rows


@pytest.mark.parametrize("words,pairs", [(1 << 20, 1 << 20), (20, 15), (0, 0)])  # all frequent, some, none
def test_against_a_plain_model(spark, words, pairs):
    rows = corpus(words, 250)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, known boolean, id string, n int").repartition(5)
    blocks = encode(df, F.col("known")).cache()
    model = fit_katz(blocks, hot_words=words, hot_pairs=pairs)
    assert len(model.n) <= words and len(model.pair_keys) <= pairs
    plain = Plain([t for _, t, k in rows if k])
    assert (model.tokens, model.types) == (plain.total, len(plain.words))
    got = sorted((r.id or "", r.learned, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in score_katz(blocks, model).collect())
    want = sorted((str(i) if i is not None else "", bool(k), *(round(x, 6) for x in plain.score(t))) for i, t, k in rows)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=2e-6)
    unknown = "a word that nobody has seen"
    for v in [None, "", *list(plain.words)[:30]]:  # every distribution sums to one over the words and the unknown word
        assert sum(plain.given(v, w) for w in [*plain.words, unknown]) == pytest.approx(1)


def test_other_texts_than_those_learned(spark):
    rows = corpus(9, 120)
    model = fit_katz(encode(spark.createDataFrame(rows, "doc_id long, text string, known boolean"), F.col("known")), hot_words=10, hot_pairs=4)
    plain = Plain([t for _, t, k in rows if k])
    other = [(1, "wort0 brand new mot1 wort0"), (2, "wort0 wort0"), (3, None)]
    got = {int(r.id): (r.n_tokens, r.n_known, r.base_score, r.score) for r in score_katz(encode(spark.createDataFrame(other, "doc_id long, text string"), F.lit(False)), model).collect()}
    for i, text in other:
        assert got[i] == pytest.approx(plain.score(text), abs=1e-6)


def test_nothing_learned_and_nothing_at_all(spark):
    blocks = encode(spark.createDataFrame([(1, "a b", False), (2, None, None)], "doc_id long, text string, known boolean"), F.col("known"))
    got = {r.id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score_katz(blocks, fit_katz(blocks)).collect()}
    assert got == {"1": (3, 0, 0, 0.0, 0.0), "2": (1, 0, 0, 0.0, 0.0)}
    empty = encode(spark.createDataFrame([], "doc_id long, text string"), F.lit(True))
    assert score_katz(empty, fit_katz(empty)).collect() == []


def test_discounts_and_packing():
    assert discounts({}).tolist() == [1.0] and discounts({1: 5}).tolist() == [1.0]
    having = {1: 1000, 2: 400, 3: 220, 4: 140, 5: 100, 6: 70}
    d = discounts(having)
    assert len(d) == 6 and sum((1 - d[r]) * r * having[r] for r in range(1, 6)) == pytest.approx(having[1])  # Good-Turing's unseen mass
    assert len(discounts(having | {6: 0})) == 5
    for a in (np.array([], np.int64), np.array([START, 0, 1 << 62, 5]), np.arange(1000, dtype=np.int32)):
        assert unpack(pack(a), a.dtype.type).tolist() == a.tolist()
