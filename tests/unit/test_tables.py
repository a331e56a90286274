"""Constraints, statistics, summaries, events, sources, sinks and streams on literal rows."""

import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from skyledger import schema
from skyledger.operators import events as EV
from skyledger.operators import quality as Q
from skyledger.operators import stats as ST
from skyledger.operators import summary as S
from skyledger.sources import readers as R
from skyledger.sources import writers as W
from skyledger.sources.commits import CommitLog
from skyledger.streaming import ingestion
from skyledger.streaming import state as STATE


def test_ranks_correlation_overlap(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", 3.0)], "g string, v double")
    assert sorted(r.x for r in df.select(ST.average_rank("v", ["g"]).alias("x")).collect()) == [1.0, 2.5, 2.5, 4.0]
    rows = [("a", i, v) for i, v in enumerate([1.0, 2.0, 3.0])] + [("b", i, v) for i, v in enumerate([3.0, 2.0, 1.0])] + [("c", i, 5.0) for i in range(3)]
    got = {(r.left, r.right): r.rho for r in ST.spearman_pairs(spark.createDataFrame(rows, "m string, i int, v double"), [], "m", "i", "v").collect()}
    assert abs(got["a", "b"] + 1) < 1e-12 and abs(got["a", "a"] - 1) < 1e-12 and got["a", "c"] is None
    fails = [("x", t, t < 54) for t in range(226)] + [("y", t, t < 45 or 54 <= t < 64) for t in range(226)] + [("z", t, False) for t in range(226)]
    got = {(r.left, r.right): r for r in ST.failure_overlap(spark.createDataFrame(fails, "m string, t int, f boolean"), [], "m", "t", F.col("f")).collect()}
    assert (got["x", "y"].shared, got["x", "y"].onlyLeft, got["x", "y"].onlyRight, round(got["x", "y"].jaccard, 3)) == (45, 9, 10, 0.703)
    assert got["z", "z"].jaccard == 1.0 and got["x", "z"].jaccard == 0.0 and got["z", "z"].bothPass == 226


def test_box_and_variance(spark):
    (r,) = ST.box_stats(spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)], "g string, v double"), ["g"], "v").collect()
    assert (r.q1, r.median, r.q3, r.whiskerLow, r.whiskerHigh, r.outliers, r["mean"]) == (2.0, 3.0, 4.0, 1.0, 4.0, [100.0], 22.0)
    flat = spark.createDataFrame([(a, b, float(a)) for a in (1, 2) for b in (1, 2)], "a int, b int, v double")
    (r,) = ST.variance_shares(flat, [], "a", "b", "v").collect()
    assert (round(r.firstShare), round(r.secondShare), round(r.remainder)) == (100, 0, 0)


def test_constraints(spark):
    lines = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":1}',), ('{"a":1,"b":"x","c":0}',), ("nope",)], "value string")
    assert len(Q.exact_keys(lines, ["a", "b"]).collect()) == 3 and len(Q.exact_keys(lines, ["a", "b"], ["c"]).collect()) == 2
    kinds = {"a": "count", "b": "string", "c": "number?", "d": "boolean"}
    typed = spark.createDataFrame([('{"a":1,"b":"x","c":null,"d":true}',), ('{"a":-1,"b":"x","c":1.5,"d":true}',), ('{"a":1,"b":2,"c":"y","d":null}',)], "value string")
    assert sorted(r.message for r in Q.scalar_types(typed, kinds).collect()) == ["a must be count", "b must be string; c must be number?; d must be boolean"]
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, ["a", "a"]), (4, [""]), (5, [])], "k int, l array<string>")
    assert sorted(r.key for r in Q.list_constraints(lists, F.col("k"), "l").collect()) == ["2", "3", "4"]
    rounds = spark.createDataFrame([(1, 2, 3, 5, 7, 17, 2, 3, 1, 0.5, True, True, "pass"), (2, 2, None, 5, 7, 17, 4, 3, 5, -1.0, True, True, "eof"), (3, None, None, None, None, None, None, None, None, None, False, True, "eof")], "k int, inputTokens long, outputTokens long, cacheReadTokens long, cacheWriteTokens long, totalTokens long, failedToolCalls int, toolCallCount int, invalidToolCalls int, costUsd double, exactPassed boolean, normalizedPassed boolean, difference string")
    assert sorted(r.rule for r in Q.row_checks(rounds, F.col("k"), Q.token_checks()).collect()) == ["V05 all or none", "V05 total", "V06 cost", "V06 exact", "V06 failed", "V06 invalid"]
    a, b = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "k int, v string, n int"), spark.createDataFrame([(1, "x", 9), (3, "z", 2)], "k int, v string, n int")
    assert len(Q.changed_rows(a, b, ["n"]).collect()) == 2 and len(Q.misaligned(a, b, ["k"], ["n"]).collect()) == 3
    files = Q.compare_files(spark.createDataFrame([("t", "a", b"1"), ("t", "b", b"2"), ("u", "a", b"1")], "k string, path string, content binary"), spark.createDataFrame([("t", "a", b"0"), ("t", "c", b"3"), ("u", "a", b"1")], "k string, path string, content binary"), ["k"])
    got = {r.k: (r.differing, r.unexpected, r.missing, r.exact) for r in files.collect()}
    assert got == {"t": (["a"], ["b"], ["c"], False), "u": ([], [], [], True)}
    with pytest.raises(ValueError, match="V09"):
        Q.require(Q.duplicates(a.unionAll(a), ["k"]))


def test_event_dialects(spark):
    def metrics(dialect, events):
        lines = spark.createDataFrame([("f", json.dumps(e) if isinstance(e, dict) else e) for e in events], "file string, value string")
        return EV.event_metrics(EV.parse_events(lines), dialect, ["file"]).collect()[0]

    r = metrics("messages", [{"type": "tool_execution_start", "toolName": "edit"}, {"type": "tool_execution_end", "isError": True, "result": {"isError": True}}, {"type": "message_end", "message": {"role": "assistant", "usage": {"input": 100, "output": 20, "cacheRead": 10, "cacheWrite": 5, "totalTokens": 135, "cost": {"total": 0.01}}}}, {"type": "message_update", "message": {"role": "assistant", "usage": {"input": 9}}}, "broken {"])
    assert (r.toolCalls, r.modelRounds, r.errors, r.totalTokens, r.costUsd, r.failedToolCalls, r.inputTokens, r.eventCount) == (1, 1, 0, 135, 0.01, 1, 100, 4)
    done = {"type": "item.completed", "item": {"type": "command_execution", "id": "1", "command": "ls", "exit_code": 2}}
    r = metrics("items", [done, {"type": "item.completed", "item": {"type": "reasoning"}}, {"type": "turn.completed", "usage": {"input_tokens": 100, "cached_input_tokens": 60, "cache_write_input_tokens": 10, "output_tokens": 20}}, {"type": "turn.failed"}])
    assert (r.toolCalls, r.modelRounds, r.errors, r.inputTokens, r.totalTokens, r.failedToolCalls, r.costUsd) == (1, None, 1, 30, 120, 1, None)
    r = metrics("turns", [{"type": "tool/call", "data": {"name": "bash", "arguments": '{"command":"ls"}'}}, {"type": "assistant/message"}, {"type": "turn/end", "data": {"reason": {"kind": "aborted"}}}])
    assert (r.toolCalls, r.modelRounds, r.errors, r.totalTokens) == (1, 1, 1, None)
    assert metrics("executions", [{"type": "assistant.turn_start"}, {"type": "session.error"}]).errors == 1
    calls = spark.createDataFrame([("f", 0, json.dumps(done)), ("f", 1, json.dumps({"type": "item.completed", "item": {"type": "file_change", "status": "completed"}}))], "file string, seq int, value string")
    facts = EV.tool_facts(EV.parse_events(calls), "items", ["file"], "seq").orderBy("ordinal").collect()
    assert [(f.tool, f.category, f.outcome, f.commandFeatures) for f in facts] == [("command_execution", "command", "error", ["list"]), ("file_change", "mutation", "completed", [])]
    assert EV.count_malformed(spark.createDataFrame([("f", "{"), ("f", "  "), ("f", "{}")], "file string, value string"), ["file"]).collect()[0].malformed == 1
    timeline = [{"type": "thread/tokenUsage/updated", "data": {"tokenUsage": {"last": {"totalTokens": 5, "inputTokens": 3}}}}, {"type": "thread/contextWindowUsage/updated"}, {"type": "turn/completed", "data": {"status": "failed"}}, {"type": "item/completed", "data": {"item": {"type": "fileRead"}}}, {"type": "item/completed", "data": {"item": {"type": "plan"}}}, {"type": "other"}]
    times = spark.createDataFrame([("f", json.dumps(x)) for x in timeline], "file string, value string")
    r = EV.timeline_metrics(EV.parse_events(times), ["file"]).collect()[0]
    assert (r.modelRounds, r.errors, r.totalTokens, r.inputTokens, r.toolCalls, r.eventCount) == (1, 1, 5, 3, 1, 6)
    more = times.unionAll(spark.createDataFrame([("f", json.dumps({"type": "thread/contextWindowUsage/updated"}))], times.schema))
    assert EV.timeline_metrics(EV.parse_events(more), ["file"]).collect()[0].totalTokens is None
    odd = spark.createDataFrame([("f", json.dumps({"type": "item/completed", "data": {"item": {"type": "strange"}}}))], "file string, value string")
    with pytest.raises(Exception, match="unknown timeline item: strange"):
        EV.timeline_metrics(EV.parse_events(odd), ["file"]).collect()
    tools = spark.createDataFrame([(1, EV.PROFILE_TOOLS), (2, ["read", "bash"])], "k int, tools array<string>")
    assert [(r.k, r.missing[0], len(r.missing)) for r in EV.profile_errors(tools).collect()] == [(2, "codemode", 8)]


def test_summaries(spark):
    cases = spark.createDataFrame([("p", "t1", ["eof", "other-text", "pass"]), ("p", "t2", ["pass"]), ("p", "t3", [])], "profileId string, trialId string, kinds array<string>")
    (r,) = S.failure_summary(cases).collect()
    assert (r.chains, r.recovered, r.damagingCount, r.damagingTrials, r.initial, r.terminal) == (3, 2, 1, ["t1"], {"eof": 1, "pass": 1, "infrastructure": 1}, {"pass": 2, "infrastructure": 1})
    tasks = spark.createDataFrame([("passed",), ("failed",), ("missing",), ("timeout",)], "taskId string")
    out = [("passed", "a", True, False), ("passed", "b", True, False), ("failed", "a", False, False), ("failed", "b", True, False), ("missing", "a", True, False), ("timeout", "a", True, True), ("timeout", "b", True, False)]
    got = {r.taskId: r.included for r in S.focused_tasks(tasks, spark.createDataFrame(out, "taskId string, profileId string, passed boolean, timedOut boolean"), spark.createDataFrame([("a",), ("b",)], "profileId string")).collect()}
    assert got == {"passed": False, "failed": True, "missing": True, "timeout": True}
    chain = spark.createDataFrame([("c", 1, False, 2.0), ("c", 2, True, None)], "c string, n int, ok boolean, s double")
    (r,) = S.retry_chains(chain, ["c"], "n", F.col("ok"), F.col("s")).collect()
    assert (r.firstPassed, r.lastPassed, r.passedAt, r.totalSeconds) == (False, True, 2, None)
    assert [r.tools for r in S.tools_in_force(spark.createDataFrame([("f", 1, "a", True), ("f", 2, "b", True), ("f", 3, "a", False)], "f string, s int, t string, on boolean"), ["f"], "s", "t", "on").collect()] == [["b"]]
    assert {r.k: r.reopened for r in S.reopened(spark.createDataFrame([("x", 1, "closed"), ("x", 2, "open"), ("y", 1, "open")], "k string, s int, st string"), "k", "s", "st").collect()} == {"x": True, "y": False}
    patterns = S.tool_patterns(spark.createDataFrame([("a", 2, "write"), ("a", 1, "read"), ("b", 1, None)], "r string, ordinal int, tool string"), ["r"], [])
    assert {r.pattern: r.n for r in patterns.collect()} == {"read → write": 1, "no recorded tools": 1}
    assert S.usage_totals(spark.createDataFrame([(None,), (2,)], "x int"), ["x"]).collect()[0].x == 2 and S.usage_totals(spark.createDataFrame([], "x int"), ["x"]).collect()[0].x is None


def test_sources_and_sinks(spark, tmp_path):
    good = tmp_path / "trials.jsonl"
    row = {c: None for c in schema.columns(schema.TRIALS) if c != "runId"} | {"trialId": "t", "rounds": 1, "firstExactPassed": True}
    good.write_text(json.dumps(row) + "\n\n")
    own = schema.TRIALS.replace("runId string, ", "")
    assert R.strict_json_lines(spark, str(good), own).count() == 1
    good.write_text(json.dumps(row | {"extra": 1}) + "\n")
    with pytest.raises(ValueError, match="V01"):
        R.strict_json_lines(spark, str(good), own)
    good.write_text(json.dumps(row) + "\n")
    tables = R.bundle(spark, str(tmp_path), "run-1")
    assert tables["trials"].collect()[0].runId == "run-1" and tables["rounds"].count() == 0
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        R.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    assert R.lenient_json_lines(spark, str(tmp_path / "bad.jsonl")).count() == 0
    W.write_csv(spark.createDataFrame([('a,"b"', None), ("c", "d")], "x string, y string").coalesce(1), str(tmp_path / "csv"))
    assert sorted((r.x, r.y) for r in R.csv_rows(spark, str(tmp_path / "csv"), 2).collect())[0][0] == 'a,"b"'
    with pytest.raises(ValueError):
        R.csv_rows(spark, str(tmp_path / "csv"), 40)
    W.write_json_lines(tables["trials"], str(tmp_path / "out"), gzip=True, partition_by=["runId"])
    assert (tmp_path / "out" / "runId=run-1").exists()
    assert W.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |\n"
    d = W.table_digest(spark.createDataFrame([(2,), (1,)], "a int"), ["a"]).collect()[0]
    import hashlib

    assert (d.rows, d.sha256) == (2, hashlib.sha256(b'{"a":1}\n{"a":2}\n').hexdigest())
    assert W.badges(spark.createDataFrame([("ide", 0.92), ("No", 0.1), ("x", None)], "n string, s double"), "n", "s").count() == 2
    assert W.replace_strings(spark.createDataFrame([("aXa", ["X"], 1)], "s string, l array<string>, n int"), "X", "Y").collect()[0].l == ["Y"]
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        info = tarfile.TarInfo("a/b.txt")
        info.size = 2
        tar.addfile(info, io.BytesIO(b"hi"))
    archives = spark.createDataFrame([("p", buffer.getvalue())], "path string, content binary")
    assert bytes(R.archive_entries(archives).collect()[0].content) == b"hi"
    with pytest.raises(Exception, match="limit"):
        R.archive_entries(archives, entry=1).collect()


def test_ingestion_and_streams(spark, tmp_path):
    index = spark.createDataFrame([("o", "c1", "r1", "h1", "s1")], STATE.INDEX)
    batch = spark.createDataFrame([("o", "c1", "r1", "h1", "x1"), ("o", "c1", "r9", "h9", "x2"), ("p", "c1", "r2", "h1", "x3"), ("p", "c2", "r1", "h2", "x4"), ("p", "c3", "r3", "h3", "x5"), ("q", "c9", "r4", "h3", "x6")], STATE.INDEX)
    got = {r.submissionId: (r.outcome, r.countedId) for r in STATE.ingest(index, batch).collect()}
    assert {k: v[0] for k, v in got.items()} == {"x1": "duplicate", "x2": "conflict", "x3": "duplicate", "x4": "conflict", "x5": "created", "x6": "duplicate"}
    assert got["x1"][1] == "s1" and got["x6"][1] == "x5"
    incoming, store = tmp_path / "in", tmp_path / "index"
    incoming.mkdir()
    for n, rows in enumerate([[("o", "c", "r", "h", "s1")], [("o", "c", "r", "h", "s2"), ("o", "d", "q", "g", "s3")]]):
        (incoming / f"{n}.json").write_text("".join(json.dumps(dict(zip(schema.columns(STATE.INDEX), x, strict=True))) + "\n" for x in rows))
        ingestion.ingest_stream(spark, str(incoming), f"file://{store}", str(tmp_path / "cp")).awaitTermination(90)
    created = CommitLog(spark, f"file://{store}").read("accepted", ingestion.ACCEPTED).where("status = 201")
    assert sorted(r.submissionId for r in created.collect()) == ["s1", "s3"]
    lines = ['data: {"type":"response.output_item.done","output_index":1,"item":{"b":2}}', 'data: {"type":"response.output_item.done","output_index":0,"item":{"a":1}}', "event: x", 'data: {"type":"response.completed","response":{"output":[]}}']
    out = STATE.patch_lines(spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "response string, seq int, line string")).orderBy("seq").collect()
    assert out[3].line.endswith('"output":[{"a":1},{"b":2}]}}') and out[2].line == "event: x"
    assert STATE.windowed_counts(spark.createDataFrame([("2024-01-01 00:10:00", 1)], "t string, k int").withColumn("t", F.to_timestamp("t")), "t", ["k"]).collect()[0].n == 1


def test_patched_stream_and_store(spark, tmp_path):
    incoming = tmp_path / "lines"
    incoming.mkdir()
    item = 'data: {"type":"response.output_item.done","output_index":0,"item":{"a":1}}'
    for n, line in enumerate([item, "event: ping", 'data: {"type":"response.completed","response":{"output":[]}}']):
        (incoming / f"{n}.json").write_text(json.dumps({"response": "r", "seq": n, "line": line, "at": f"2024-01-01T00:00:0{n}Z"}) + "\n")
        os.utime(incoming / f"{n}.json", (1_700_000_000 + n,) * 2)  # files arrive in this order
    for name, time in (("patched", None), ("timed", "at")):
        stream = spark.readStream.schema("response string, seq long, line string, at timestamp").option("maxFilesPerTrigger", 1).json(str(incoming))
        query = STATE.patch_stream(stream, time).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert query.awaitTermination(60)  # it ends by itself
        got = [r.line for r in spark.table(name).orderBy("seq").collect()]
        assert got[0] == item and got[2].endswith('"output":[{"a":1}]}}')
    for run in ("run-1", "run-2"):
        folder = tmp_path / "store" / "accepted" / run
        folder.mkdir(parents=True)
        for name, ddl in schema.TABLES.items():
            row = {c: None for c in schema.columns(ddl) if c != "runId"}
            (folder / f"{name}.jsonl").write_text(json.dumps(row | ({"trialId": "t"} if name == "trials" else {})) + "\n")
    e = R.store(spark, str(tmp_path / "store"))
    assert sorted(r.runId for r in e.trials.collect()) == ["run-1", "run-2"] and e.rounds.count() == 2


def test_evidence_violations(spark):
    from tests.unit.test_leaderboard import evidence, round_, trial

    good = {"exactPassed": True, "normalizedPassed": True, "difference": "pass", "toolCallsObserved": True, "toolCallCount": 0}
    fine = evidence(spark, trials=[trial("t", "unique-10-plain", 1, True, True)], rounds=[round_("t", 0, **good)])
    assert Q.validate(fine).collect() == [] and Q.declared_tasks(fine.trials, fine.runs).collect() == [] and Q.smoke_gate(fine.trials, fine.profiles).collect() == []
    bad = evidence(spark, trials=[trial("t", "other", 2, False, True), trial("t", "other", 2, True, True, profileId="gone")], rounds=[round_("t", 1, **good), round_("x", 0, **(good | {"difference": "odd", "toolCallCount": 3}))], calls=[{"runId": "run-a", "roundId": "t/1", "ordinal": 2, "tool": "x", "category": "none"}])
    rules = {r.rule for r in Q.validate(bad).collect()}
    assert rules >= {"V09 trials", "V07 trials", "V07 rounds", "V08 rounds", "V08 first", "V10 count", "O02 contiguous", "V04 difference", "V04 category"}
    assert {r.rule for r in Q.declared_tasks(bad.trials, bad.runs).collect()} == {"V14 task"} and Q.manifest_counts(bad).collect()[0].toolCalls == 1
    assert {r.rule for r in Q.harness_versions(bad.runs, bad.profiles).collect()} == set()


def test_lines_are_parsed_once_for_all_fields(spark):
    import skyledger.operators.quality as QUALITY

    lines = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":-1,"b":2}',), ("{",)], "value string")
    found = QUALITY.scalar_types(lines, {"a": "count", "b": "string", "c": "number?"})
    assert sorted((r.key, r.message) for r in found.collect()) == [("{", "a must be count; b must be string"), ('{"a":-1,"b":2}', "a must be count; b must be string")]
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
