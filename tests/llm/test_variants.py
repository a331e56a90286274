"""Spelling variants against all pairs, the tries against sets, and edge rows."""

import random
import zlib

from pyspark.sql import functions as F

from skyledger.llm.variants import Trie, one_deleted, roots, spelling_variants, word_counts


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, ratio=5):
    form, out = {}, {}
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def words_of(seed, letters, most):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(60)]
    out = set(base)
    for w in base:
        for _ in range(4):
            i = rng.randint(0, len(w))
            out.add(rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return {w: rng.choice([1, 2, 5, 9, 25, 26, 130, 700, 4000]) for w in sorted(out)}


def test_tries_find_each_neighbour_once():
    for seed in range(20):
        counts = words_of(seed, "abé\U0001f600" if seed % 2 else "aab", 6)
        names = sorted(counts)
        trie = Trie(*Trie.pack(names, [counts[w] for w in names]))
        for word in [*names, "", "zzz", "aaaaaaaaaa"]:
            assert sorted(trie.near(word)) == sorted((v, counts[v]) for v in names if one_apart(word, v)), word
    assert list(Trie(*Trie.pack([], [])).near("a")) == []


def test_against_all_pairs(spark):
    for seed, shard, batch in ((1, 100_000, 1 << 20), (2, 20, 1500), (3, 60, 1)):  # one trie; several to a batch; one each
        counts = words_of(seed, "abcö", 7)
        df = spark.createDataFrame([(n, w, 1) for w, n in counts.items()], "n long, word string, form int").repartition(3)
        rows = spelling_variants(df, shard_words=shard, batch_bytes=batch).collect()
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == brute(counts)
        assert len(rows) == len(counts)


def test_nulls_and_nothing(spark):
    rows = [(None, 4), ("a", None), ("b", 0), ("word", 3), ("words", 15), ("", 2), ("x", 2)]
    got = {r.word: tuple(r) for r in spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {"word": ("word", "words", "words", 3, 1, 15), "words": ("words", None, "words", 15, 1, None), "": ("", None, "", 2, 1, None), "x": ("x", None, "x", 2, 1, None)}
    assert spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_long_chains_reach_their_root(spark):
    rows = [(f"w{i:03}", f"w{i + 1:03}" if i < 100 else None) for i in range(101)]
    assert {r.root for r in roots(spark.createDataFrame(rows, "word string, form string")).collect()} == {"w100"}


def test_counts_of_words(spark):
    rng = random.Random(4)
    vocabulary = ["Anmeldung", "straßen", "ÀÈÌÒÙàèìòù", "letters", "short", "Zzyzzyx", "extraordinary"]
    docs = [(i if i % 9 else None, "".join(rng.choice(vocabulary) + rng.choice([" ", "1", "\n", "-", "Ā", "×", "÷"]) for _ in range(60))) for i in range(300)]
    docs += [(1, None), (2, ""), (3, "123 !!"), (4, "letters" * 30_000)]
    want: dict = {}
    for k, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 6:
                    want[run] = want.get(run, 0) + 1
            run = ""
    df = spark.createDataFrame([(k, t, "x", 2) for k, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = {r.word: r.n for r in word_counts(df, one_deleted(F.col("doc_id"), 199)).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5}
    assert len(want) > len(vocabulary)  # some runs did lose a code point
