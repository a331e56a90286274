"""The prefix trie against a dictionary of prefixes; the loser tree against sorting."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skyledger.llm.common import crc_bucket
from skyledger.llm.trie import Run, merge, prefix_trie, turn_paths, with_openings


def brute(seqs):
    """seqs: id -> list of (role, text)."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
        ends[tuple(s)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def test_merging_is_sorting():
    rng = random.Random(3)
    turns = [bytes([i]) * 16 for i in range(3)]
    for k in (1, 2, 3, 5, 8, 13):
        runs, want = [], {}
        for r in range(k):
            paths = sorted({b"".join(rng.choices(turns, k=rng.randint(0, 7))) for _ in range(rng.randint(1, 40))})
            entries = [(p, [x for x in p[::16]], rng.randint(1, 5), rng.randint(0, 99)) for p in paths]
            for p, s, n, i in entries:
                m, j = want.get(p, (0, 99))
                want[p] = (m + n, min(i, j))
            runs.append(Run(Run.pack(entries)))
        got, before = list(merge(runs)), b""
        assert [(p, n, i) for p, _, n, i, _ in got] == [(p, *want[p]) for p in sorted(want)]
        for p, sizes, _, _, lcp in got:
            common = next((i for i in range(min(len(p), len(before)) // 16) if p[16 * i : 16 * i + 16] != before[16 * i : 16 * i + 16]), min(len(p), len(before)) // 16)
            assert sizes == [x for x in p[::16]] and lcp == common
            before = p


@pytest.mark.parametrize("batch", [3, 1000])  # many short runs, and one a task
def test_against_prefixes(spark, batch):
    rng = random.Random(batch)
    common = [("user", "hot first turn é"), ("assistant", "same answer")]
    rows = []
    for c in [*range(-20, 160), 10**12]:
        kind = rng.random()
        seq = [*common] if kind < 0.4 else [] if kind < 0.5 else [common[0]]
        seq += [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "", "ü" * 9])) for _ in range(rng.randint(0, 4))]
        if c == 77:
            seq = [("user", str(i)) for i in range(300)]
        rows += [(c, t, role, text, "x") for t, (role, text) in enumerate(seq)]
    rows += [(500, 1, "user", "copy", "x"), (501, 1, "user", "copy", "x"), (None, 1, "user", "nobody's", "x")]
    rows += [(502, None, "user", "null first", "x"), (502, 0, None, None, "x"), (502, 0, "user", "b", "x"), (502, 0, "user", "b", "x"), (502, 0, "assistant", "z", "x")]
    rows += [(c, 0, "user", "no base", "x") for c in range(601, 605)]  # some lose their only turn
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string").repartition(3)
    paths = turn_paths(df)
    conv = F.col("conv_id")
    got = prefix_trie(paths, run_bytes=1).collect()
    own = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute(own), key=repr)
    openings = prefix_trie(with_openings(paths, conv - conv % 5, crc_bucket(conv, 9))).collect()
    rebuilt = {}
    for c, s in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + s[h:]
    assert any(not s for s in rebuilt.values())
    assert sorted((tuple(r) for r in openings), key=repr) == sorted(brute(rebuilt), key=repr)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(turn_paths(empty)).collect() == []
