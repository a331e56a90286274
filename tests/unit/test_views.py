"""Maintained views against a rebuild, and which folders a change touches."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from skyledger.evidence import from_star
from skyledger.operators.cells import round_stats, trial_facts
from skyledger.plans.queries import QUERIES
from skyledger.sources.commits import CommitConflict, CommitLog
from skyledger.sources.writers import stored
from skyledger.streaming import state as STATE
from skyledger.streaming import views as V

SF = "/root/testdata/sf0.001"


def same(a, b):
    rows = lambda df: sorted(repr([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(b.columns)).collect())
    assert rows(a) == rows(b)


def test_changes_touch_their_groups_only(spark, tmp_path):
    e = from_star(spark, SF)
    state, counts = stored(STATE.create_state(e)), stored(V.run_counts(e.runs))
    kept = V.MaintainedViews(CommitLog(spark, f"file://{tmp_path}/log"), state.schema)
    assert kept.view("exact").count() == 0
    for run in ("AFRICA", "ASIA"):
        kept.apply(f"add {run}", state.where(F.col("runId") == run), counts.where(F.col("runId") == run))
    first = kept.apply("add the rest", state.where("runId not in ('AFRICA', 'ASIA')"), counts.where("runId not in ('AFRICA', 'ASIA')"))
    total = counts.groupBy(*V.BENCHMARK).agg(F.max("benchmarkTasks").alias("benchmarkTasks"))

    def rebuilt(rows):
        for name, make in V.VIEWS.items():
            same(kept.view(name), make(rows, total))

    rebuilt(state)
    corrected = state.where("runId = 'ASIA' and cast(trialId as long) % 3 > 0").withColumn("digest", F.lit("corrected"))
    second = kept.apply("correct ASIA", corrected, counts.where("runId = 'ASIA'"))
    rest = state.where("runId <> 'ASIA'")
    rebuilt(rest.unionByName(corrected))
    asia = {r.modelFamily for r in state.where("runId = 'ASIA'").select("modelFamily").distinct().collect()}
    for name in V.VIEWS:
        was, now = first.tables[f"view-{name}"], second.tables[f"view-{name}"]
        assert was.keys() == now.keys() and sum(was[t] != now[t] for t in was) == len(asia) < len(was)
    third = kept.apply("remove AFRICA", remove=["AFRICA"])
    rebuilt(rest.where("runId <> 'AFRICA'").unionByName(corrected))
    assert len(third.tables["view-exact"]) < len(second.tables["view-exact"]) and set(third.tables["state"]) == {"AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"}
    same(kept.view("totals", first), V.totals_view(state, total))  # an older version stays whole
    with pytest.raises(ValueError, match="no runs"):
        kept.apply("again", remove=["AFRICA"])
    with pytest.raises(ValueError, match="added and removed"):
        kept.apply("both", corrected, counts.where("runId = 'ASIA'"), remove=["ASIA"])
    # a benchmark that grows touches all groups, as their coverage is measured by it
    grown = counts.where("runId = 'ASIA'").withColumn("benchmarkTasks", F.col("benchmarkTasks") + 100)
    fourth = kept.apply("grow", corrected, grown)
    assert all(fourth.tables["view-exact"][t] != third.tables["view-exact"][t] for t in third.tables["view-exact"])
    assert kept.view("exact").agg(F.max("coverage")).first()[0] < kept.view("exact", third).agg(F.max("coverage")).first()[0]


def test_an_overtaken_change_is_made_again(spark, tmp_path):
    rows = [("r1", "t1", "a", "x"), ("r2", "t2", "a", "y"), ("r3", "t3", None, "z")]
    state = spark.createDataFrame(rows, "runId string, trialId string, modelFamily string, harnessFamily string")
    views = {"n": lambda state, counts: state.groupBy("modelFamily").agg(F.count("*").alias("n"))}
    log, commit, overtaken = CommitLog(spark, f"file://{tmp_path}/log"), CommitLog.commit, []
    other = V.MaintainedViews(log, state.schema, views=views)

    class Slow(CommitLog):
        def commit(self, parent, title, changes):
            if not overtaken:
                overtaken.append(1)
                other.apply("between", state.where("runId = 'r2'"))
            return commit(self, parent, title, changes)

    V.MaintainedViews(Slow(spark, log.root), state.schema, views=views).apply("first", state.where("runId = 'r1'"))
    assert [tuple(r) for r in other.view("n").collect()] == [("a", 2)]  # both runs count, whoever came first
    other.apply("a null group", state.where("runId = 'r3'"))
    assert sorted((tuple(r) for r in other.view("n").collect()), key=str) == [("a", 2), (None, 1)]
    with pytest.raises(CommitConflict):
        log.commit(log.at(0), "stale", {})


def test_a_change_makes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    ddl = "runId string, trialId string, modelFamily string, harnessFamily string"
    rows = spark.createDataFrame([(f"r/{i % 5} = ü", f"t{i}", "ab"[i % 2], "x") for i in range(20)], ddl).mapInArrow(counted, ddl)
    views = {"n": lambda state, counts: state.groupBy("modelFamily").agg(F.count("*").alias("n"))}
    log = CommitLog(spark, f"file://{tmp_path}/log")
    kept = V.MaintainedViews(log, rows.schema, views=views)
    version = kept.apply("runs of odd names", rows)
    assert made.value == 20 and set(version.tables["state"]) == {f"r/{i} = ü" for i in range(5)}
    assert kept.state(slots=["r/3 = ü"]).count() == 4 and sorted(tuple(r) for r in kept.view("n").collect()) == [("a", 10), ("b", 10)]
    assert log.unnamed("state") == []  # nothing is left beside the folders that the version names


def test_measures_stay_with_chosen_runs(spark):
    e = from_star(spark, SF)
    some = e.only(["ASIA", "EUROPE"])
    assert some.measured is not None
    same(trial_facts(some), trial_facts(some, stats=round_stats(some.rounds)))
    stored_rounds = e.with_rounds(stored(e.rounds))
    same(STATE.create_state(stored_rounds).drop("tools"), STATE.create_state(e).drop("tools"))


def test_copied_evidence_is_the_same(spark):
    e = from_star(spark, SF)
    made = []
    copies = e.copied(lambda df: made.append(df) or stored(df))
    assert len(made) == 5  # trials and their measures are one table
    same(STATE.run_digests(copies), STATE.run_digests(e))
    same(trial_facts(copies.only(["ASIA"])), trial_facts(e.only(["ASIA"])))
    assert copies.trials.schema.simpleString() == e.trials.schema.simpleString() and replace(e).copied(stored).measured is None


def test_three_states_derive_their_evidence_once(spark):
    plan = QUERIES["incremental_equals_rebuild"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_custkey" not in plan and "seenRounds" in plan


def test_documents(spark):
    e = from_star(spark, SF)
    views = json.loads(V.views_document({"totals": V.totals_view(STATE.create_state(e), None)}, {"totals": ["modelFamily", "harnessFamily"]}).first()[0])
    assert views["schemaVersion"] == 1 and views["totals"] == sorted(views["totals"], key=lambda r: (r["modelFamily"], r["harnessFamily"]))
    community = json.loads(V.community_document(e.runs, e.profiles).first()[0])
    assert [c["account"] for c in community["contributors"]] == [f"account-{i}" for i in range(5)] and {h["contributors"] for h in community["harnesses"]} == {5}
