"""The commit log under concurrent writers, and ingestion: every line in exactly one table, also after a replay."""

import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from skyledger.sources.commits import CommitConflict, CommitLog, create_if_absent, read_text
from skyledger.streaming import ingestion as I
from skyledger.streaming.state import INDEX, ingest


def test_a_document_appears_once_and_whole(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    won = []
    writers = [threading.Thread(target=lambda i=i: won.append((create_if_absent(spark, path, f"text é {i}" * 100), i))) for i in range(8)]
    (tmp_path / "a").mkdir()
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    (first,) = [i for ok, i in won if ok]
    assert read_text(spark, path) == f"text é {first}" * 100 and [p.name for p in (tmp_path / "a").iterdir() if not p.name.endswith(".crc")] == ["b.json"]


def test_parent_checked_commits(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.head().number == -1 and log.read("t", "n long").count() == 0
    one = log.commit(log.head(), "one", {"t": {"a": log.write(spark.range(3).toDF("n"), "t")}})
    stale = log.head()
    both = {"t": {"b": log.write(spark.range(10, 12).toDF("n"), "t")}, "index": {"all": log.write(spark.range(1).toDF("n"), "index")}}
    two = log.commit(stale, "two", both)
    lost = log.write(spark.range(100, 101).toDF("n"), "t")
    with pytest.raises(CommitConflict):
        log.commit(stale, "too late", {"t": {"c": lost}})
    assert sorted(r.n for r in log.read("t", "n long").collect()) == [0, 1, 2, 10, 11]
    assert log.read("t", "n long", one).count() == 3 and log.read("index", "n long", one).count() == 0  # readers see whole versions
    three = log.update("gone", lambda head: {"t": {"a": None}})
    assert (three.parent, three.number) == (two.number, 2) and log.read("t", "n long").count() == 2 and log.at(1) == two
    assert log.update("nothing", lambda head: None) == three
    assert log.unnamed("t") == [lost] or log.unnamed("t") == [lost.replace("file://", "file:")]
    assert len(log.unnamed("t", keep=1)) == 2


def test_no_commit_is_lost(spark, tmp_path):
    log, tries, start = CommitLog(spark, f"file://{tmp_path}/log"), [], threading.Barrier(4)

    def add(i):
        def change(head):
            if not tries.count(i):
                tries.append(i)
                start.wait()  # all begin at the same head, so that all but one must try again
            else:
                tries.append(i)
            n = int(head.tables.get("sum", {}).get("total", "0"))
            return {"sum": {"total": str(n + i)}}

        log.update(f"add {i}", change)

    writers = [threading.Thread(target=add, args=(i,)) for i in (1, 10, 100, 1000)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert log.head().tables["sum"]["total"] == "1111" and log.numbers() == [0, 1, 2, 3] and len(tries) > 4
    assert [log.at(i).parent for i in range(4)] == [-1, 0, 1, 2]


def line(owner, client, run, content, sid=None, key=None):
    return json.dumps({"ownerId": owner, "clientRunId": client, "runId": run, "contentHash": content, "submissionId": sid, "keyHash": key})


def rows_of(log):
    accepted = [(r.ownerId, r.clientRunId, r.runId, r.contentHash, r.submissionId, r.status) for r in log.read("accepted", I.ACCEPTED).collect()]
    refused = [(r.line, r.status, r.code, r.message) for r in log.read("refused", I.REFUSED).collect()]
    return sorted(accepted, key=repr), sorted(refused, key=repr)


def test_each_line_once_also_after_replays(spark, tmp_path):
    first = [
        line("o", "c1", "r1", "h1", "s1"), line("o", "c1", "r1", "h1", "s1"), "garbage", "{}", "", "[1]", "null", line("o", "", "r", "h"), line("o", None, None, "h"),
        "x" * 5000, json.dumps({"ownerId": "o", "pad": "é" * 300}),
    ]
    second = [line("o", "c1", "r1", "h1", "s7"), line("o", "c1", "r2", "h2", "s2"), line("p", "c3", "r1", "h3", "s3"), line("p", "c4", "r4", "h4"), '{"ownerId": "o"', "garbage"]
    incoming, root, checkpoint = tmp_path / "in", f"file://{tmp_path}/store", str(tmp_path / "cp")
    incoming.mkdir()
    for n, rows in enumerate((first, second)):
        (incoming / f"{n}.jsonl").write_text("\n".join(rows) + "\n")
        assert I.ingest_stream(spark, str(incoming), root, checkpoint, max_bytes=600).awaitTermination(120)
    log = CommitLog(spark, root)
    accepted, refused = rows_of(log)
    assert accepted == sorted([
        ("o", "c1", "r1", "h1", "s1", 201), ("o", "c1", "r1", "h1", "s1", 200), ("o", "c1", "r1", "h1", "s1", 200), ("p", "c4", "r4", "h4", "h4", 201)], key=repr)
    bad = [(x, 400, "invalid-json", "not a JSON object") for x in ("garbage", "garbage", "", "[1]", "null", '{"ownerId": "o"')]
    bad += [("{}", 400, "invalid-submission", "missing: ownerId, clientRunId, runId, contentHash"), (first[7], 400, "invalid-submission", "missing: clientRunId"), (first[8], 400, "invalid-submission", "missing: clientRunId, runId")]
    bad += [(None, 413, "payload-too-large", "more than 600 bytes")] * 2
    bad += [(x, 400, "invalid-submission", "already used for different content") for x in second[1:3]]
    assert refused == sorted(bad, key=repr)
    assert len(accepted) + len(refused) == len(first) + len(second)
    assert {r.sha256 for r in log.read("refused", I.REFUSED).where("line is null").collect()} == {hashlib.sha256(x.encode()).hexdigest() for x in (first[9], first[10])}
    before = log.head()
    (slot,) = [s for s in before.tables["accepted"] if s.endswith("1")]
    replay = spark.createDataFrame([(x,) for x in second], "value string")
    assert I.commit_batch(log, replay, slot, max_bytes=600) == before  # a replayed batch changes nothing
    third = I.commit_batch(log, replay, "other-000000000", max_bytes=600)  # the same lines as news: nothing is created
    assert third.number == before.number + 1 and rows_of(log)[0].count(("p", "c4", "r4", "h4", "h4", 200)) == 1
    compacted = I.compact(log, slot)
    assert len(compacted.tables["keys"]) == 2 and log.read("keys", I.KEYS).drop("bucket").distinct().count() == 2
    assert I.compact(log, slot) == compacted
    I.commit_batch(log, spark.createDataFrame([(line("o", "c1", "r1", "h9"),)], "value string"), "other-000000001")
    assert rows_of(log)[1].count((line("o", "c1", "r1", "h9"), 400, "invalid-submission", "already used for different content")) == 1
    none = I.commit_batch(log, spark.createDataFrame([], "value string"), "other-000000002")
    assert log.read("accepted", I.ACCEPTED, none).count() == 6


def test_keys_name_the_owner(spark):
    accounts = spark.createDataFrame([("k1", "owner-1"), ("k2", "owner-2")], "keyHash string, ownerId string")
    lines = [line("someone else", "c", "r", "h", key="k1"), line("o", "c", "r", "h", key="k9"), line("o", "c", "r", "h"), line(None, "c", None, "h", key="k2"), "}"]
    got = I.judge_lines(spark.createDataFrame([(x,) for x in lines], "value string"), accounts).orderBy(F.col("line")).collect()
    assert sorted((r.ownerId, r.status, r.message) for r in got if r.status is None) == [("owner-1", None, None)]
    assert sorted((r.status, r.message) for r in got if r.status is not None) == [(400, "missing: runId"), (400, "not a JSON object"), (401, "no account has this key"), (401, "no account has this key")]


def test_an_overtaken_batch_is_judged_again(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    one, two = (spark.createDataFrame([(line(o, "c", "r-" + o, "same", o),)], "value string") for o in ("a", "b"))
    overtaken, commit = [], CommitLog.commit

    class Slow(CommitLog):
        def commit(self, parent, title, changes):
            if not overtaken:
                overtaken.append(1)
                I.commit_batch(log, two, "two")
            return commit(self, parent, title, changes)

    I.commit_batch(Slow(spark, log.root), one, "one")
    assert [(r[4], r[5]) for r in rows_of(log)[0]] == [("b", 200), ("b", 201)]  # the same content: only one was created


def one_by_one(rows):
    kept, out = [], {}
    for owner, client, run, content, sid in sorted(rows, key=lambda r: (r[4], r[0], r[1], r[2])):
        mine = next((k for k in kept if k[:2] == (owner, client)), None)
        same = next((k for k in kept if k[3] == content), None)
        if mine:
            got = ("duplicate", mine[4]) if mine[3] == content else ("conflict", sid)
        elif same:
            got = ("duplicate", same[4])
        elif any(k[2] == run for k in kept):
            got = ("conflict", sid)
        else:
            got = ("created", sid)
            kept.append((owner, client, run, content, sid))
        out[sid] = got
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_are_settled_as_if_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("op"), f"c{rng.randrange(12)}", f"r{rng.randrange(14)}", f"h{rng.randrange(12)}", f"s{i:03}") for i in range(150)]
    known = [("o", "c1", "r1", "h1", "a0"), ("p", "c2", "r2", "h2", "a1")]
    index = spark.createDataFrame(known, INDEX)
    got = {r.submissionId: (r.outcome, r.countedId) for r in ingest(index, spark.createDataFrame(rows, INDEX).repartition(3)).collect()}
    want = one_by_one([(*k[:4], k[4]) for k in known] + rows)
    assert got == {s: o for s, o in want.items() if s.startswith("s")} and {o for o, _ in got.values()} == {"created", "duplicate", "conflict"}
    rest = spark.createDataFrame([("o", None, None, f"n{i}", None) for i in range(4)], INDEX)
    assert [r.outcome for r in ingest(index, rest).collect()] == ["created"] * 4  # null keys clash with nothing
    twice = spark.createDataFrame([("o", "x", "y", "z", "s")] * 3, INDEX)
    assert sorted(r.outcome for r in ingest(index, twice).collect()) == ["created", "duplicate", "duplicate"]


@pytest.mark.parametrize("few", [0, 2])
def test_a_submission_meets_nothing_that_comes_after_it(spark, few):
    """s4 can't be created, as its run is in by s0, but waits for s3, whose client it has; meanwhile s5, of the same content, is created."""
    keys = [("u", "r0", "h0"), ("t", "r0", "h1"), ("v", "r5", "h1"), ("b", "r5", "h3"), ("b", "r0", "h4"), ("y", "r6", "h4")]
    rows = [("o", *k, f"s{i}") for i, k in enumerate(keys)]
    got = {r.submissionId: (r.outcome, r.countedId) for r in ingest(spark.createDataFrame([], INDEX), spark.createDataFrame(rows, INDEX), few=few).collect()}
    assert got == one_by_one(rows) and got["s4"] == ("conflict", "s4") and got["s5"] == ("created", "s5")


def test_a_clash_with_an_earlier_run_is_refused_in_rounds_too(spark, monkeypatch):
    """The same submissions as lines: s4 is in the refused table, and not accepted as a duplicate of s5."""
    monkeypatch.setattr(I, "ingest", lambda index, batch: ingest(index, batch, few=0))
    keys = [("u", "r0", "h0"), ("t", "r0", "h1"), ("v", "r5", "h1"), ("b", "r5", "h3"), ("b", "r0", "h4"), ("y", "r6", "h4")]
    names = ("clientRunId", "runId", "contentHash")
    lines = [json.dumps({"ownerId": "o", "submissionId": f"s{i}"} | dict(zip(names, k, strict=True))) for i, k in enumerate(keys)]
    judged = I.judge_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    accepted, refused = I.settle(judged, spark.createDataFrame([], INDEX))
    assert {r.line: (r.status, r.message) for r in refused.collect()} == {lines[i]: (400, "already used for different content") for i in (1, 3, 4)}
    assert sorted((r.submissionId, r.code) for r in accepted.collect()) == [(s, "created") for s in ("s0", "s2", "s5")]


def test_the_rest_of_a_long_chain_is_served_by_one_task(spark):
    """Rounds settle all of it, or some of it, or none: the outcome is the same."""
    rng = random.Random(9)
    some = lambda kind, n: None if rng.random() < 0.05 else f"{kind}{rng.randrange(n)}"
    rows = [(some("o", 3), some("c", 12), some("r", 25), some("h", 30), f"s{i:04}" if rng.random() < 0.9 else None) for i in range(400)]
    index = spark.createDataFrame([("o1", "c1", "r1", "h1", "before"), ("o2", "c2", "r90", "h90", "before too")], INDEX)
    got = [sorted(map(str, ingest(index, spark.createDataFrame(rows, INDEX).coalesce(1), few=few).collect())) for few in (0, 150, 50_000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 400
    chain = [("o", f"c{i // 2}", f"r{i}", f"h{(i + 1) // 2}", f"s{i:04}") for i in range(60)]  # each waits for the one before
    spark.sparkContext.setJobGroup("served", "")
    assert ingest(index.limit(0), spark.createDataFrame(chain, INDEX)).count() == 60
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("served")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 20
