"""Hand-computed cases of the leaderboard, families, tools and states."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from skyledger import schema
from skyledger.evidence import Evidence, conform
from skyledger.operators import families as FA
from skyledger.operators import leaderboard as L
from skyledger.operators import summary as S
from skyledger.operators.cells import benchmark_counts
from skyledger.streaming import state as STATE

RUN = ("run-a", "sub-a", "contract", "set", "verifier", (5, 0, 10, 120000), (("org/edit", "1", "contract", "edit", "h"), ("set", ["replace-all-1-plain", "unique-10-plain"]), [], ("runner", "runner", "1")), ("hub", "acct", "url"))


def evidence(spark, runs=(RUN,), profiles=None, trials=None, rounds=None, calls=()):
    def rows(ddl, given):
        return conform(spark.createDataFrame([{**r} for r in given], ddl) if given else spark.createDataFrame([], ddl), ddl)

    full = lambda ddl, given: rows(ddl, [{c: r.get(c) for c in schema.columns(ddl)} for r in given])
    profiles = profiles if profiles is not None else [profile()]
    trials = trials if trials is not None else TRIALS
    rounds = rounds if rounds is not None else ROUNDS
    return Evidence(spark.createDataFrame(list(runs), schema.RUNS), full(schema.PROFILES, profiles), full(schema.TRIALS, trials), full(schema.ROUNDS, rounds), full(schema.TOOL_CALLS, list(calls)))


def profile(**more):
    return {"runId": "run-a", "profileId": "p", "model": "acme/model", "modelFamily": "acme/model", "harnessFamily": "ide", "harnessVersion": "4.5.6", "agentFamily": "ide", "agentVersion": "4.5.6", "thinking": "low", "provider": "acme", "configurationHash": "c1", "configurationLabels": []} | more


def trial(trial_id, task, rounds, first, final, **more):
    return {"runId": "run-a", "trialId": trial_id, "taskId": task, "profileId": "p", "rounds": rounds, "firstExactPassed": first, "finalExactPassed": final} | more


def round_(trial_id, n, seconds=None, cost=None, tokens=None, **more):
    return {"runId": "run-a", "roundId": f"{trial_id}/{n}", "trialId": trial_id, "round": n, "seconds": seconds, "costUsd": cost, "totalTokens": tokens, "timedOut": False} | more


TRIALS = [trial("pass", "replace-all-1-plain", 2, True, True), trial("fail", "unique-10-plain", 1, None, True)]
ROUNDS = [round_("pass", 0, 2.0, 0.1, 100), round_("pass", 1, 3.0, 0.2, 200), round_("fail", 0, 5.0)]


def test_base_case(spark):
    (row,) = L.exact_configurations(evidence(spark), with_provenance=True, with_samples=True).collect()
    assert (row.observations, row.recoveryRounds, row.firstExactRate, row.finalExactRate, row.recoveryGain, row.score, row.coverage, row.complete) == (2, 1, 0.5, 1.0, 0.5, 0.625, 1.0, True)
    assert (row.duration_total, row.duration_n, row.cost_total, row.cost_n, row.tokens_total, row.tokens_n) == (10.0, 2, 0.1 + 0.2, 1, 300.0, 1)
    assert (row.durationAverageCase, row.durationCoveredRun) == (5.0, 10.0)
    assert (row.runIds, row.concurrency, row.configurationHash, row.taskFamilies) == (["run-a"], 10, "c1", ["Replace all", "Unique match"])
    assert row.configurationTaskCells[0].taskId == "replace-all-1-plain" and row.configurationTaskCells[0].samples[0].tokens == 300


def test_repeated_task_is_task_balanced(spark):
    e = evidence(spark, runs=[RUN, ("run-b", "sub-b", *RUN[2:])], profiles=[profile(), profile(runId="run-b")], trials=[*TRIALS, trial("again", "replace-all-1-plain", 1, False, False, runId="run-b")], rounds=[*ROUNDS, round_("again", 0, runId="run-b")])
    (row,) = L.leaderboard(e).collect()
    assert (row.observations, row.firstExactRate, row.finalExactRate, row.score) == (3, 0.25, 0.75, 0.375)


def test_second_mode_and_filters(spark):
    e = evidence(spark, profiles=[profile(), profile(profileId="q", thinking="high")], trials=[*TRIALS, trial("t3", "unique-10-plain", 1, False, False, profileId="q")], rounds=[*ROUNDS, round_("t3", 0)])
    (row,) = L.leaderboard(e).collect()
    assert (row.qualityScore, row.coverage, row.score, row.thinking, row.evidenceUnit, row.benchmarkId) == (0.3125, 0.75, 0.234375, "All · 2 modes", "task-modes", "All · 1 family")
    (row,) = L.exact_configurations(e, {"taskFamily": ["Replace all"]}).collect()
    assert (row.observations, row.firstExactRate, row.coverage, row.complete) == (1, 1.0, 0.5, False)
    assert L.exact_configurations(e, {"model": ["other/model"], "reasoning": ["low"]}).collect()[0].thinking == "low"
    order = [r.thinking for r in L.ordered(L.exact_configurations(e), "reasoning", "asc", rolled=False).collect()]
    assert order == ["low", "high"]


def test_coverage_rule_and_quarantine(spark):
    (row,) = L.exact_configurations(evidence(spark, trials=[trial("pass", "unique-10-plain", 2, True, True)], rounds=[round_("pass", 0, 2.0, 0.1, 100, timedOut=True, providerFailure="rate-limit")])).collect()
    assert (row.duration_n, row.timeouts, row.providerFailureTrials, row.durationTotalObserved) == (0, 0, 0, None)
    for n, bad, eligible in ((49, 49, True), (50, 9, True), (50, 10, False)):
        e = evidence(spark, trials=[trial(str(i), "unique-10-plain", 1, True, True) for i in range(n)], rounds=[round_(str(i), 0, 1.0, providerFailure="rate-limit" if i < bad else None) for i in range(n)])
        assert L.exact_configurations(e).collect()[0].rankingEligible is eligible


def test_order_nulls_last_and_natural(spark):
    e = evidence(spark, profiles=[profile(profileId=f"p{i}", agentVersion=v, modelFamily=m) for i, (v, m) in enumerate([("1.10.0", "a"), ("1.2.3", "a"), (None, "a")])], trials=[trial(f"t{i}", "unique-10-plain", 0, True, True, profileId=f"p{i}") for i in range(3)], rounds=[])
    rows = L.exact_configurations(e)
    assert [r.agentVersion for r in L.ordered(rows, "agentVersion", "asc", rolled=False).collect()] == ["1.2.3", "1.10.0", None]
    assert [r.agentVersion for r in L.ordered(rows, "agentVersion", "desc", rolled=False).collect()] == ["1.10.0", "1.2.3", None]
    assert [r.agentVersion for r in L.ordered(L.rollup(rows), "agentVersion", "asc").collect()][-1] is None


def test_family_median_and_empty(spark):
    rows = spark.createDataFrame([(s, s, s, s, 1.0, True, True, 10, 10, 5, "h", "1.0") for s in (0.91, 0.89, 0.87, 0.2)] + [(0.5, 0.5, 0.5, 0.5, 0.5, False, True, 5, 10, 5, "g", "2.0")], "firstExactRate double, finalExactRate double, qualityScore double, score double, coverage double, complete boolean, rankingEligible boolean, taskCount long, benchmarkTaskCount long, observations long, harnessFamily string, harnessVersion string")
    got = {r.harnessFamily: r for r in FA.family_score(rows, ["harnessFamily"]).collect()}
    assert abs(got["h"].score - 0.88) < 1e-12 and abs(got["h"].scoreDistribution.mean - 0.7175) < 1e-12 and got["h"].completeConfigurationCount == 4
    assert got["g"].score is None and got["g"].scoreDistribution is None and got["g"].configurationCount == 1
    assert {r.harnessFamily for r in FA.latest_harness_groups(rows).collect()} == {"h", "g"}
    d = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "v double").agg(FA.distribution(F.col("v")).alias("d")).collect()[0].d
    assert (d.count, d.min, d.p25, d.median, d.p75, d.max) == (2, 1.0, 1.25, 1.5, 1.75, 2.0) or d["count"] == 2


def test_tools(spark):
    calls = [{"runId": "run-a", "roundId": r, "ordinal": i, "tool": t} for i, (r, t) in enumerate([("pass/0", "read"), ("pass/1", "read"), ("pass/1", "replace"), ("gone/0", "read")])]
    e = evidence(spark, calls=calls)
    got = {r.tool: (r.calls, round(r.share, 9), r.callsPerTrial) for r in S.tool_usage(e).collect()}
    assert got == {"read": (2, round(2 / 3, 9), 1.0), "replace": (1, round(1 / 3, 9), 0.5)}
    assert [t.tool for t in S.tool_lists(S.tool_usage(e)).collect()[0].tools] == ["read", "replace"]
    assert sorted(r.n for r in S.tool_trial_counts(e, "read").collect()) == [0, 2]


def test_state_equals_rebuild_and_conflicts(spark):
    e = evidence(spark, runs=[RUN, ("run-b", "sub-b", *RUN[2:])], profiles=[profile(), profile(runId="run-b")], trials=[*TRIALS, trial("again", "replace-all-1-plain", 1, False, False, runId="run-b")], rounds=[*ROUNDS, round_("again", 0, 4.0, runId="run-b")])
    one, two = (STATE.create_state(e.only([r])) for r in ("run-a", "run-b"))
    both = STATE.append_state(STATE.append_state(one, two), one)
    pick = lambda df: df.select("observations", "score", "duration_total", "durationCoveredRun", "recoveryRounds").collect()
    assert pick(L.exact_from_cells(STATE.merge_cells(both), benchmark_counts(e.runs))) == pick(L.exact_configurations(e))
    STATE.verify_state(both, e.runs)
    with pytest.raises(ValueError, match="differ"):
        STATE.verify_state(one, e.runs)
    changed = evidence(spark, trials=[trial("pass", "replace-all-1-plain", 2, False, True), TRIALS[1]])
    with pytest.raises(ValueError, match="conflicting"):
        STATE.append_state(both, STATE.create_state(changed))
    for name in ("rounds", "profiles"):  # other evidence behind the same trials is no duplicate
        other = e.only(["run-a"])
        column = {"rounds": "seconds", "profiles": "adapterVersion"}[name]
        moved = getattr(other, name).withColumn(column, F.lit("99").cast(getattr(other, name).schema[column].dataType))
        assert STATE.classify_runs(both, STATE.create_state(replace(other, **{name: moved}))).collect()[0].outcome == "conflict"
    binding = STATE.state_binding(both, e.runs.withColumn("position", F.when(F.col("runId") == "run-b", 0).otherwise(1)), "position")
    STATE.verify_state(both, e.runs.withColumn("position", F.when(F.col("runId") == "run-b", 0).otherwise(1)), binding, "position")
    with pytest.raises(ValueError, match="not bound"):
        STATE.verify_state(both, e.runs, binding)
    with pytest.raises(ValueError, match="twice"):
        STATE.verify_state(both.unionAll(both), e.runs)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = S.efficiency(e.trials, e.rounds)
    assert rows(STATE.state_efficiency(both).select(want.columns)) == rows(want)
    assert rows(STATE.state_tool_counts(both, "read")) == rows(S.tool_trial_counts(e, "read").select("runId", "trialId", "profileId", "n"))
    assert STATE.materialize(both).count() == 3
    assert STATE.remove_run(both, "run-b").select("runId").distinct().count() == 1
    with pytest.raises(ValueError):
        STATE.remove_run(both, "none")


def test_an_appended_state_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    ddl = "runId string, trialId string, digest string"
    rows = [(run, f"{run}{i}", run) for run in "abc" for i in range(10)] + [(None, "none", "d")]
    state, new = (spark.createDataFrame([r for r in rows if r[0] in runs], ddl).mapInArrow(counted, ddl) for runs in (("a", "b"), ("b", "c", None)))
    both = STATE.append_state(state, new)
    made.value = 0
    assert sorted(both.collect(), key=str) == sorted(rows, key=str) and made.value == 41


def test_digests_tell_values_apart(spark):
    def digest(trials=(), calls=()):
        e = evidence(spark, profiles=[], trials=[{"runId": "a", **r} for r in trials], rounds=[], calls=[{"runId": "a", **r} for r in calls])
        return STATE.run_digests(e).collect()

    differ = [
        ([{"taskId": "x"}], [{"profileId": "x"}], "trials"), ([{"taskId": None}], [{"taskId": ""}], "trials"), ([{"rounds": 0}], [{"rounds": None}], "trials"), ([{"rounds": 1}], [{"rounds": 1}] * 2, "trials"), ([{"rounds": 1}] * 2, [{"rounds": 2}] * 2, "trials"),
        ([{"commandFeatures": []}], [{"commandFeatures": None}], "calls"), ([{"commandFeatures": [None]}], [{"commandFeatures": []}], "calls"), ([{"commandFeatures": ["x", None]}], [{"commandFeatures": [None, "x"]}], "calls"),
    ]
    for one, two, name in differ:
        assert digest(**{name: one}) != digest(**{name: two}), (one, two)
    same = [{"runId": "a", "trialId": str(i), "rounds": i} for i in range(5)]
    assert digest(same) == digest(same[::-1])
    e = evidence(spark, profiles=[], trials=same, rounds=[])
    wide = replace(e, trials=e.trials.withColumn("rounds", F.col("rounds").cast("long")))
    assert STATE.run_digests(wide).collect() == STATE.run_digests(e).collect()


def test_complete_runs_and_exclusion(spark):
    e = evidence(spark, profiles=[profile(), profile(profileId="lazy", configurationHash="c2")])
    assert FA.complete_evidence(e).trials.count() == 0  # lazy has no trials
    kept, applied = S.exclude(e, spark.createDataFrame([(2, "c2"), (1, "c2")], "position int, configurationHash string"))
    assert FA.complete_evidence(kept).trials.count() == 2 and applied.collect()[0].position == 1
    assert FA.complete_harness_groups(kept).collect()[0].score == 0.625
    assert {r.facet for r in FA.facets(e).collect()} >= {"model", "harness", "taskFamily"}
