import re

import numpy as np
import pytest

import skyledger.llm.jaccard as J

SCHEMA = "doc_id long, text string, component_id string, n int, sig long"


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                par[find(i)] = find(j)
    out = []
    for i, (k, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((k, len(sets[i]), min(same) if same and (sets[i]) else k))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(k, t, "", 1, 2) for k, t in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in J.jaccard_components(df).collect()), key=str)


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(int(rng.integers(0, edits + 1))):
            w[int(rng.integers(len(w)))] = f"e{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small,rounds", [(False, 2), (True, 2), (True, 0)])
def test_against_brute_force(spark, monkeypatch, small, rounds):
    monkeypatch.setattr(J, "ROUNDS", rounds)
    if small:  # long lists, salts and frequent classes also come up
        monkeypatch.setattr(J, "SHORT_LIST", 4)
        monkeypatch.setattr(J, "CHUNK", 5)
        monkeypatch.setattr(J, "HOT_LIST", 20)
        monkeypatch.setattr(J, "BROADCAST_IDS", 1)
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for size, copies, edits in [(30, 25, 2), (60, 40, 3), (200, 30, 9), (12, 10, 1), (9, 8, 1), (400, 12, 16)]:
        texts += family(rng, rng.choice(vocab, size), copies, edits)
    passage = " ".join(rng.choice(vocab, 50))
    texts += [f"{passage} {' '.join(rng.choice(vocab, int(rng.integers(0, 14))))}" for _ in range(40)]
    texts += ["a b c", "A  B\tc", "a b c d", "a b c d e", "x", "x", "", None, "  \n", "é à É", "É à É", "the the the the the the the the"]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)) + 100, texts, strict=True)]
    rows += [rows[0], rows[1], (None, rows[2][1]), (None, "alone in the table with its own words"), (None, None), (rows[3][0], "same id but another text altogether here")]
    assert run(spark, rows) == brute(rows)


def test_short_texts_with_odd_characters_stay_apart(spark):
    rows = [(1, "a\x00b c"), (2, "a b\x00c"), (3, "a\x00b\tc"), (4, "ab c"), (5, "a bc")]
    assert run(spark, rows) == brute(rows) and [r[2] for r in run(spark, rows)] == [1, 2, 1, 4, 5]


def test_bracket_property():
    ends = J.brackets(85, 3000)
    at = lambda n: int(np.searchsorted(ends, n, "right")) - 1
    for n in range(1, 2000):
        assert at(100 * n // 85) - at(n) <= 1


def test_signatures_meet():
    """Sets that link share a signature, whatever tokens are frequent."""
    rng = np.random.default_rng(2)
    ends = J.brackets(85)
    for _ in range(1500):
        counts = np.where(rng.random(J.BUCKETS) < rng.choice([0.0, 0.5, 0.9, 1.0]), 1000, rng.integers(1, 9, J.BUCKETS))
        n = int(rng.integers(6, 120))
        pool = np.unique(rng.integers(0, 2**63, 4 * n).astype(np.uint64))
        rng.shuffle(pool)
        drop = int(rng.integers(0, max(1, n // 6)))
        a, b = np.sort(pool[:n]), np.sort(pool[drop : n + int(rng.integers(0, max(1, n // 6)))])
        if J.enough(a, b, 85) and len(b) >= 6:
            assert np.intersect1d(J.signatures(a, counts, 100, 85, ends)[0], J.signatures(b, counts, 100, 85, ends)[0]).size


def test_empty_table(spark):
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        J.jaccard_components(spark.createDataFrame([], SCHEMA), percent=50)


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    ruled = 0
    for _ in range(1500):
        n = int(rng.integers(6, 700))
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        drop = int(rng.integers(0, n // 4 + 1))
        a, b = np.unique(pool[:n]), np.unique(pool[drop : n + int(rng.integers(0, n // 4 + 1))])
        ok = J.may_link(J.sketch(a), J.sketch(b), len(a) + len(b), 85)
        assert ok or not J.enough(a, b, 85)
        ruled += not ok
    assert ruled > 300 and len(J.sketch(a[:0])) == 32


def test_five_words_at_eighty_percent(spark):
    """Sets of 4 and 5 link at 80, and so does a pair between 0.80 and 0.85; each size's signatures meet."""
    ws = [f"w{i}" for i in range(60)]
    changed = [*ws[:30], "other", *ws[31:]]  # 51 shared of 61 five-word shingles: 0.836
    two = [*[f"v{i}" for i in range(94)]]
    other = [*two[:30], "y", *two[31:60], "z", *two[61:]]  # 80 of 100: exactly 0.8
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, " ".join(ws)), (4, " ".join(changed)), (5, " ".join(two)), (6, " ".join(other)), (7, "a b c d e f g x")]
    df = spark.createDataFrame([(k, t, "", 1, 2) for k, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(df, n=5, percent=80).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    assert [J.least_size(p) for p in (80, 84, 85, 90)] == [4, 6, 6, 9]
    rng, ends = np.random.default_rng(6), J.brackets(80)
    met = 0
    for _ in range(1500):
        counts = np.where(rng.random(J.BUCKETS) < rng.choice([0.0, 0.5, 0.9, 1.0]), 1000, rng.integers(1, 9, J.BUCKETS))
        n = int(rng.integers(4, 90))
        pool = np.unique(rng.integers(0, 2**63, 4 * n).astype(np.uint64))
        rng.shuffle(pool)
        drop = int(rng.integers(0, n // 5 + 1))
        a, b = np.sort(pool[:n]), np.sort(pool[drop : n + int(rng.integers(0, n // 4 + 2))])
        if J.enough(a, b, 80) and min(len(a), len(b)) >= J.least_size(80):
            met += 1
            assert np.intersect1d(J.signatures(a, counts, 100, 80, ends)[0], J.signatures(b, counts, 100, 80, ends)[0]).size
            assert J.may_link(J.sketch(a), J.sketch(b), len(a) + len(b), 80)
    assert met > 300


def test_pairs_of_near_texts_are_made_once(spark):
    """Nodes 1 to 4 share four lists, two of them the same; each pair across components comes from the first only."""
    lists = {10: [1, 2, 3], 11: [1, 2, 3, 4], 12: [1, 2, 3, 4], 13: [2, 3, 4], 14: [3, 5]}
    rows = [(sig, (k, 100 << 8), (1 if k < 3 else k, 0)) for sig, nodes in lists.items() for k in nodes]
    df = spark.createDataFrame(rows, "sig long, node struct<d1: long, d2: long>, label struct<d1: long, d2: long>")
    kept = J.distinct_lists(df.drop("label"))
    assert sorted({r.sig for r in kept.collect()}) == [10, 11, 13, 14] and kept.count() == 12
    got = sorted((r.a.d1, r.b.d1) for r in J.pairs_across(df, 85).collect())
    assert got == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (3, 5)]
