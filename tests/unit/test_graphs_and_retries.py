"""Fingerprints of graphs by a plain recursion; retry chains streamed and in one table."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators.fingerprint import installed_violations, tree_digests
from skyledger.streaming import retries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(payloads, edges):
    known = {}

    def digest(node):
        if node not in known:
            buckets = {}
            for c in {c for p, c in edges if p == node}:
                d, h = digest(c)
                buckets.setdefault(d[:3], []).append((d, h))
            own = sha("-" if payloads[node] is None else f"={payloads[node]}")
            lines = [f"{b}:{sha(chr(10).join(sorted(d for d, _ in ds)))}" for b, ds in sorted(buckets.items())]
            known[node] = sha("\n".join([own, *lines])), max((h + 1 for ds in buckets.values() for _, h in ds), default=0)
        return known[node]

    return {n: digest(n) for n in payloads}


def test_digests_by_recursion(spark):
    rng = random.Random(5)
    payloads = {str(i): rng.choice([None, "", "a", "bé", str(i)]) for i in range(120)}
    edges = [(str(i), str(rng.randrange(i))) for i in range(1, 120) for _ in range(rng.randint(0, 4))]
    edges += [("119", str(i)) for i in range(100)] + edges[:20]
    nodes = spark.createDataFrame([(i, p, "x") for i, p in payloads.items()] + [(None, "y", "x")], "id string, payload string, digest string")
    links = spark.createDataFrame([(p, c, 1) for p, c in edges] + [(None, "1", 1), ("1", None, 1)], "parent string, child string, id int")
    got = tree_digests(nodes, links).collect()
    assert {r.id: (r.digest, r.height) for r in got} == plain(payloads, edges) and len(got) == 120
    assert {r.id: r.children for r in got} == {n: len({c for p, c in edges if p == n}) for n in payloads}
    changed = tree_digests(nodes.withColumn("payload", F.when(F.col("id") == "0", "new").otherwise(F.col("payload"))), links)
    above = {"0"}
    for p, c in sorted(edges, key=lambda e: int(e[0])):
        above |= {p} if c in above else set()
    before = {r.id: r.digest for r in got}
    assert {r.id for r in changed.collect() if r.digest != before[r.id]} == above
    assert tree_digests(nodes.limit(0), links.limit(0)).collect() == []


@pytest.mark.parametrize("edges,message", [([("a", "b"), ("b", "c"), ("c", "b")], "cycle"), ([("a", "a")], "cycle"), ([("a", "z")], "unknown")])
def test_what_is_no_tree_is_refused(spark, edges, message):
    nodes = spark.createDataFrame([(x, x) for x in "abc"], "id string, payload string")
    with pytest.raises(ValueError, match=message):
        tree_digests(nodes, spark.createDataFrame(edges, "parent string, child string"))
    with pytest.raises(ValueError, match="repeat"):
        tree_digests(nodes.unionAll(nodes), spark.createDataFrame([], "parent string, child string"))


def test_installed_packages(spark):
    rows = [
        ("", None, None, None, None), ("node_modules/a", "1.2.3", "https://packages.example/a.tgz", "i1", None), ("node_modules/b", "1.2", "http://elsewhere.example/b", None, False),
        ("node_modules/c", "1.0.0-rc.1+x", None, "i3", True), ("node_modules/d", "1.0.0", "file:../d", "i4", None),
    ]
    installed = spark.createDataFrame(rows, "location string, version string, resolved string, integrity string, link boolean")
    plan = spark.createDataFrame([("a", "1.2.3", "i1"), ("c", "1.0.0-rc.1+x", "other"), ("e", "1.0.0", None)], "name string, version string, integrity string")
    got = sorted(tuple(r) for r in installed_violations(installed, plan, "packages.example").collect())
    assert got == sorted([("version", "node_modules/b"), ("origin", "node_modules/b"), ("link", "node_modules/c"), ("origin", "node_modules/d"), ("plan", "node_modules/c"), ("plan", "node_modules/e")])


def attempts_of(seed, chains, budget):
    rng, rows = random.Random(seed), []
    for c in range(chains):
        for a in range(1, budget + 2):
            passed = rng.random() < 0.35
            rows.append((f"c{c}", a, passed if passed or rng.random() < 0.9 else None))
            if passed:
                break
    return rows


def test_streamed_chains_equal_the_table(spark, tmp_path):
    budget, incoming = 3, tmp_path / "in"
    rows = attempts_of(1, 60, budget) + [("open", 1, False), ("gap", 1, False), ("gap", 3, True)]
    incoming.mkdir()
    swapped = [r for r in rows if not (r[0] == "c7" and r[1] == 1)] + [r for r in rows if r[0] == "c7" and r[1] == 1]  # c7's first comes last
    for n in range(5):
        part = [r for i, r in enumerate(swapped) if i * 4 // len(swapped) == n] if n < 4 else [("later", 1, True), ("later", 1, True)]
        lines = [{"chain": c, "attempt": a, "passed": p, "at": f"2024-01-01T{(20 if n == 4 else n):02}:{i % 50:02}:00Z"} for i, (c, a, p) in enumerate(part + part[:3])]
        (incoming / f"{n}.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
        os.utime(incoming / f"{n}.json", (1_700_000_000 + n,) * 2)
    retries.use_rocks(spark)
    stream = spark.readStream.schema("chain string, attempt int, passed boolean, at timestamp").option("maxFilesPerTrigger", 1).json(str(incoming))
    query = retries.retry_stream(stream, budget=budget, idle="8 hours", late="0 seconds").writeStream.format("memory").queryName("chains").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    got = {r.chain: r for r in spark.table("chains").collect()}
    table = spark.createDataFrame(rows + [("later", 1, True)], "chain string, attempt int, passed boolean").where("chain not in ('open', 'gap')")
    want = {r.chain: r for r in retries.bounded_chains(table, budget=budget).collect()}
    assert {c: r for c, r in got.items() if r.outcome != "abandoned"} == want and len(want) == 61
    gone = {c: (r.attempts, r.everPassed, r.passedAt) for c, r in got.items() if r.outcome == "abandoned" and r.attempts}
    assert gone == {"open": (1, False, None), "gap": (1, False, None)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0  # every chain is over
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_parts_hold_many_chains(spark, tmp_path):
    """Far fewer states than chains, which end across batches; those of a part that fell silent go, the others stay."""
    incoming = tmp_path / "in"
    incoming.mkdir()
    silent = {f"c{c}" for c in range(200) if c % 10 == 7}
    waves = [[(f"c{c}", 1, c % 2 == 0, "00") for c in range(200)], [(f"c{c}", 2, c % 3 == 0, "01") for c in range(1, 200, 2) if f"c{c}" not in silent]]
    waves[1] += [(f"c{c}", 3, True, "01") for c in range(1, 200, 2) if c % 3 and f"c{c}" not in silent] + [(f"open{c}", 1, False, "09") for c in range(30)]
    for n, wave in enumerate([*waves, [("last", 1, True, "12")]]):
        (incoming / f"{n}.json").write_text("".join(json.dumps({"chain": c, "attempt": a, "passed": p, "at": f"2024-01-01T{hour}:00:00Z"}) + "\n" for c, a, p, hour in wave[::-1]))
        os.utime(incoming / f"{n}.json", (1_700_000_000 + n,) * 2)
    retries.use_rocks(spark)
    stream = spark.readStream.schema("chain string, attempt int, passed boolean, at timestamp").option("maxFilesPerTrigger", 1).json(str(incoming))
    chains = retries.retry_stream(stream, budget=2, idle="8 hours", together=3)
    query = chains.writeStream.format("memory").queryName("parts_of_chains").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.table("parts_of_chains").collect()
    table = spark.createDataFrame([r[:3] for w in waves for r in w] + [("last", 1, True)], "chain string, attempt int, passed boolean")
    want = retries.bounded_chains(table, budget=2).collect()
    assert sorted(r for r in got if r.outcome != "abandoned") == sorted(want) and len(want) == 181
    assert sorted((r.chain, r.attempts) for r in got if r.outcome == "abandoned") == sorted((c, 1) for c in silent)
    assert 1 <= query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # 30 open chains


def test_levels_leave_out_the_edges_below_them(spark, monkeypatch):
    """A level writes the edges that no lower level has used; digests are kept only for nodes that still wait."""
    import skyledger.operators.fingerprint as FP

    written = []
    keep = FP.stored

    def spy(df):
        out = keep(df)
        if "parent" in out.columns:
            written.append((sorted(out.columns), out.count()))
        return out

    monkeypatch.setattr(FP, "stored", spy)
    nodes = spark.createDataFrame([(x, x) for x in "abcdefgh"], "id string, payload string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), *[("b", x) for x in "efgh"]], "parent string, child string")
    got = {r.id: r.height for r in FP.tree_digests(nodes, edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0, "f": 0, "g": 0, "h": 0}
    assert [n for columns, n in written if columns == ["child", "digest", "parent"]] == [7, 2, 1, 0]
    assert [n for columns, n in written if columns == ["digest", "parent"]] == [0, 0, 0, 0]
