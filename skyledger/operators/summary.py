"""Summaries of trials and rounds: rates, efficiency, tools, community, reports, contingency, retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.evidence import Evidence, finite
from skyledger.functions.classify import eof_pass


def pass_summary(trials: DataFrame, key: Sequence[str]) -> DataFrame:
    """Trials and pass rates per key. Keyed by profileId alone, equal ids of different runs merge; add runId to keep them apart."""
    first, final = F.coalesce("firstExactPassed", F.lit(False)), F.coalesce("finalExactPassed", F.lit(False))
    return trials.groupBy(*key).agg(F.count("*").alias("trials"), F.count_if(first).alias("firstPasses"), F.count_if(final).alias("finalPasses")).withColumns({"firstRate": F.col("firstPasses") / F.col("trials"), "finalRate": F.col("finalPasses") / F.col("trials")})


def macro_rate(trials: DataFrame) -> DataFrame:
    """Mean over tasks of the tasks' pass rates, one row."""
    per = pass_summary(trials, ["taskId"])
    return per.agg(F.avg("firstRate").alias("macroFirstRate"), F.avg("finalRate").alias("macroFinalRate"), F.count("*").alias("tasks"))


USAGE = ["costUsd", "inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens", "totalTokens", "seconds"]


def efficiency(trials: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per run and profile, sums that stay null without observations, and how many there were."""
    owner = trials.select("runId", "trialId", "profileId")
    sums = [x for c in USAGE for x in (F.sum(c).alias(c), F.count(c).alias(f"{c}Observed"))]
    return rounds.join(owner, ["runId", "trialId"]).groupBy("runId", "profileId").agg(F.count("*").alias("rounds"), *sums)


def usage_totals(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Sums with missing values as 0, but null for no records at all."""
    return records.agg(*[F.when(F.count("*") > 0, F.sum(F.coalesce(F.col(c), F.lit(0)))).alias(c) for c in fields])


TOOL_KEY = ["modelFamily", "harnessFamily", "harnessVersion"]


def tool_usage(evidence: Evidence) -> DataFrame:
    """Calls, share and calls per trial of each tool, per model, harness and version.

    Calls are counted per round before they meet trials; a call of an unknown round is dropped, a group without calls stays.
    """
    who = evidence.profiles.select("runId", "profileId", F.element_at(F.split(F.coalesce("modelFamily", "modelId", "model"), "/"), -1).alias("modelFamily"), F.coalesce("harnessFamily", "harnessId").alias("harnessFamily"), "harnessVersion")
    trials = evidence.trials.select("runId", "trialId", "profileId").join(who, ["runId", "profileId"])
    groups = trials.groupBy(*TOOL_KEY).agg(F.count("*").alias("trials"))
    per_round = evidence.tool_calls.groupBy("runId", "roundId", "tool").agg(F.count("*").alias("calls"))
    calls = per_round.join(evidence.rounds.select("runId", "roundId", "trialId"), ["runId", "roundId"]).join(trials, ["runId", "trialId"])
    tools = calls.groupBy(*TOOL_KEY, "tool").agg(F.sum("calls").alias("calls"))
    of = tools.toDF(*[f"_{c}" for c in TOOL_KEY], "tool", "calls")
    on = F.lit(True)
    for c in TOOL_KEY:
        on = on & groups[c].eqNullSafe(of[f"_{c}"])
    total = F.sum("calls").over(Window.partitionBy(*TOOL_KEY))
    joined = groups.join(of, on, "left").withColumn("calls", F.coalesce("calls", F.lit(0))).withColumn("total", total)
    return joined.select(*TOOL_KEY, "trials", "tool", "calls", F.coalesce(F.try_divide("calls", "total"), F.lit(0.0)).alias("share"), (F.col("calls") / F.col("trials")).alias("callsPerTrial"))


def tool_lists(usage: DataFrame) -> DataFrame:
    """One row per group; its tools most used first, ties by name."""
    entry = F.struct((-F.col("calls")).alias("order"), "tool", "calls", "share", "callsPerTrial")
    tools = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("tool").isNotNull(), entry))))
    return usage.groupBy(*TOOL_KEY, "trials").agg(F.sum("calls").alias("calls"), F.transform(tools, lambda t: t.dropFields("order")).alias("tools"))


def tool_trial_counts(evidence: Evidence, tool: str) -> DataFrame:
    """How often each trial called the tool, zeros included."""
    wanted = evidence.tool_calls.where(F.col("tool") == tool).groupBy("runId", "roundId").agg(F.count("*").alias("n"))
    per = wanted.join(evidence.rounds.select("runId", "roundId", "trialId"), ["runId", "roundId"]).groupBy("runId", "trialId").agg(F.sum("n").alias("n"))
    return evidence.trials.select("runId", "trialId", "profileId").join(per, ["runId", "trialId"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def round_tools(calls: DataFrame) -> DataFrame:
    """Calls per run, round and tool; rows with an empty key are dropped."""
    whole = F.lit(True)
    for c in ("runId", "roundId", "tool"):
        whole = whole & (F.coalesce(F.col(c), F.lit("")) != "")
    return calls.where(whole).groupBy("runId", "roundId", "tool").agg(F.count("*").alias("calls"))


def community(runs: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contributors and harness families with distinct runs and configurations."""
    used = profiles.select("runId", F.coalesce("harnessFamily", "harnessId").alias("harnessFamily"), F.coalesce("configurationHash", F.concat_ws("/", "runId", "profileId")).alias("hash"))
    joined = runs.select("runId", F.col("submittedBy.platform").alias("platform"), F.col("submittedBy.accountId").alias("accountId"), F.col("submittedBy.profileUrl").alias("profileUrl")).join(used, "runId", "left")
    named = joined.where("accountId is not null and profileUrl is not null")
    people = named.groupBy("platform", "accountId").agg(F.max("profileUrl").alias("profileUrl"), F.count_distinct("runId").alias("runs"), F.count_distinct("hash").alias("configurations"))
    harnesses = joined.where("harnessFamily is not null").groupBy("harnessFamily").agg(F.count_distinct("runId").alias("runs"), F.count_distinct("hash").alias("configurations"))
    return people, harnesses


def trial_measures(trials: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per trial the first and last round's outcome, eof passes, recoveries, timeouts, seconds."""
    ok, eof = F.coalesce("exactPassed", F.lit(False)), F.coalesce(eof_pass(F.coalesce("exactPassed", F.lit(False)), F.col("difference"), F.coalesce("timedOut", F.lit(False)), F.col("exitCode")), F.lit(False))
    per = rounds.groupBy("runId", "trialId").agg(F.min_by(ok, "round").alias("first"), F.max_by(ok, "round").alias("final"), F.min_by(eof, "round").alias("firstEof"), F.max_by(eof, "round").alias("finalEof"), F.count("*").alias("n"), F.count_if(F.coalesce("timedOut", F.lit(False))).alias("timeouts"), F.sum(finite(F.col("seconds"))).alias("seconds"))
    joined = trials.select("runId", "trialId", "profileId", "taskId", "infrastructureFailure").join(per, ["runId", "trialId"], "left")
    no = F.lit(False)
    return joined.select("runId", "trialId", "profileId", "taskId", *[F.coalesce(c, no).alias(c) for c in ("first", "final", "firstEof", "finalEof")], F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - 1).alias("recoveries"), F.coalesce("timeouts", F.lit(0)).alias("timeouts"), (F.col("n").isNull() | F.col("infrastructureFailure").isNotNull()).alias("infra"), "seconds")


def scoreboard(measures: DataFrame, key: Sequence[str] = ("profileId",)) -> DataFrame:
    """Counters per key, and the share of first failures that recovered."""
    n = lambda c: F.count_if(c)
    rows = measures.groupBy(*key).agg(F.count("*").alias("trials"), n(F.col("first")).alias("firstPassed"), n(F.col("final")).alias("finalPassed"), n(F.col("firstEof")).alias("firstEofPassed"), n(F.col("finalEof")).alias("finalEofPassed"), F.sum("recoveries").alias("recoveries"), n(~F.col("final") & (F.col("recoveries") > 0)).alias("exhausted"), F.sum("timeouts").alias("timeouts"), n(F.col("infra")).alias("infrastructureFailures"), F.avg("seconds").alias("meanSeconds"), n(~F.col("first") & F.col("final")).alias("recovered"))
    return rows.withColumn("recoveryRate", F.try_divide("recovered", F.col("trials") - F.col("firstPassed")))


def margins(measures: DataFrame, one: str, two: str) -> DataFrame:
    """The same counters summed over each of two dimensions, in one pass of grouping sets."""
    rows = measures.groupingSets([[one], [two]], one, two).agg(F.grouping(one).alias("_g"), F.count("*").alias("trials"), F.count_if("first").alias("firstPassed"), F.count_if("final").alias("finalPassed"), F.sum("recoveries").alias("recoveries"), F.sum("timeouts").alias("timeouts"))
    return rows.select(F.when(F.col("_g") == 0, one).otherwise(two).alias("dimension"), F.when(F.col("_g") == 0, F.col(one)).otherwise(F.col(two)).alias("value"), "trials", "firstPassed", "finalPassed", "recoveries", "timeouts")


def contingency(rows: DataFrame, on: Sequence[str], side: str, left: str, right: str, passed: str) -> DataFrame:
    """Both, only left, only right, neither, over keys that both sides have."""
    one = rows.where(F.col(side) == left).select(*on, F.col(passed).alias("l"))
    two = rows.where(F.col(side) == right).select(*on, F.col(passed).alias("r"))
    return one.join(two, list(on)).agg(F.count_if(F.expr("l and r")).alias("both"), F.count_if(F.expr("l and not r")).alias("onlyLeft"), F.count_if(F.expr("r and not l")).alias("onlyRight"), F.count_if(F.expr("not l and not r")).alias("neither"))


def peer_losses(rows: DataFrame, task: str, profile: str, passed: str, chosen: Column) -> DataFrame:
    """Tasks that a chosen profile failed and other profiles passed, with the winners."""
    lost = rows.where(chosen & ~F.col(passed)).select(F.col(task).alias("task"), F.col(profile).alias("loser")).distinct()
    won = rows.where(F.col(passed)).select(F.col(task).alias("_task"), F.col(profile).alias("winner")).distinct()
    return lost.join(won, (F.col("task") == F.col("_task")) & (F.col("winner") != F.col("loser"))).groupBy("task", "loser").agg(F.array_sort(F.collect_set("winner")).alias("winners"))


def retry_chains(rows: DataFrame, chain: Sequence[str], attempt: str, passed: Column, seconds: Column) -> DataFrame:
    """Per chain of attempts the first and last outcome, whether and when it passed; seconds null if any is missing."""
    return rows.groupBy(*chain).agg(F.count("*").alias("attempts"), F.min_by(passed, attempt).alias("firstPassed"), F.max_by(passed, attempt).alias("lastPassed"), F.bool_or(passed).alias("everPassed"), F.min(F.when(passed, F.col(attempt))).alias("passedAt"), F.when(F.count(seconds) == F.count("*"), F.sum(seconds)).alias("totalSeconds"))


def failure_summary(cases: DataFrame, top: int = 10) -> DataFrame:
    """Per profile histograms of initial and terminal kinds, and the recoveries that did damage.

    cases: profileId, trialId, kinds (array of difference kinds by round; empty: infrastructure). A recovery does damage
    when a chain that began with a mere layout difference has another text later. top bounds the list, not the count.
    """
    initial = F.when(F.size("kinds") == 0, "infrastructure").otherwise(F.try_element_at("kinds", F.lit(1)))
    terminal = F.when(F.size("kinds") == 0, "infrastructure").otherwise(F.try_element_at("kinds", F.lit(-1)))
    later = F.slice("kinds", 2, F.size("kinds"))
    damaging = initial.isin("eof", "line-breaks", "ascii-layout") & F.array_contains(later, "other-text")
    rows = cases.select("profileId", "trialId", initial.alias("initial"), terminal.alias("terminal"), damaging.alias("damaging"), F.size("kinds").alias("rounds"))
    count = lambda kind: rows.groupBy("profileId", F.col(kind).alias("k")).agg(F.count("*").alias("n")).groupBy("profileId").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(kind))
    listed = rows.groupBy("profileId").agg(F.count("*").alias("chains"), F.sum("rounds").alias("rounds"), F.count_if(F.col("terminal") == "pass").alias("recovered"), F.count_if(F.col("terminal") != "pass").alias("exhausted"), F.count_if(F.col("damaging")).alias("damagingCount"), F.slice(F.array_sort(F.collect_list(F.when(F.col("damaging"), F.col("trialId")))), 1, top).alias("damagingTrials"))
    return listed.join(count("initial"), "profileId").join(count("terminal"), "profileId")


def focused_tasks(tasks: DataFrame, outcomes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Tasks with the reasons for which a profile keeps them in; none: excluded.

    outcomes: taskId, profileId, passed (null: unknown), timedOut. Timeout goes before failed, failed before missing.
    """
    per = outcomes.groupBy("taskId", "profileId").agg(F.bool_or(F.coalesce("timedOut", F.lit(False))).alias("t"), F.bool_and("passed").alias("p"))
    grid = tasks.select("taskId").distinct().crossJoin(F.broadcast(profiles.select("profileId").distinct()))
    reason = F.when(F.coalesce("t", F.lit(False)), "timeout").when(F.col("p").eqNullSafe(False), "failed").when(F.col("p").isNull(), "missing-or-unknown")
    rows = grid.join(per, ["taskId", "profileId"], "left").groupBy("taskId").agg(F.array_sort(F.collect_list(F.when(reason.isNotNull(), F.concat("profileId", F.lit(": "), reason)))).alias("reasons"))
    return rows.withColumn("included", F.size("reasons") > 0)


def exclude(evidence: Evidence, hashes: DataFrame, packages: DataFrame | None = None) -> tuple[Evidence, DataFrame]:
    """Profiles named by a policy go, with their trials, rounds and calls.

    hashes: position, configurationHash; packages: position, package. The first decision by position counts. Also the decisions.
    """
    p = evidence.profiles
    found = p.join(hashes.select("position", "configurationHash"), "configurationHash").select("runId", "profileId", "position")
    if packages is not None and "packages" in p.columns:
        found = found.unionByName(p.select("runId", "profileId", F.explode("packages").alias("package")).join(packages.select("position", "package"), "package").select("runId", "profileId", "position"))
    applied = found.groupBy("runId", "profileId").agg(F.min("position").alias("position"))
    profiles = p.join(applied, ["runId", "profileId"], "left_anti")
    trials = evidence.trials.join(profiles.select("runId", "profileId"), ["runId", "profileId"], "left_semi")
    rounds = evidence.rounds.join(trials.select("runId", "trialId"), ["runId", "trialId"], "left_semi")
    calls = evidence.tool_calls.join(rounds.select("runId", "roundId"), ["runId", "roundId"], "left_semi")
    return Evidence(evidence.runs, profiles, trials, rounds, calls, evidence.configurations), applied


def tool_patterns(calls: DataFrame, key: Sequence[str], scope: Sequence[str], order: str = "ordinal", top: int = 10) -> DataFrame:
    """Sequences of tools per key, and the most frequent ones of each scope with their share."""
    entry = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "tool")))
    per = calls.groupBy(*scope, *key).agg(F.array_join(F.transform(F.filter(entry, lambda x: x["tool"].isNotNull()), lambda x: x["tool"]), " → ").alias("pattern"))
    counted = per.withColumn("pattern", F.when(F.col("pattern") == "", "no recorded tools").otherwise(F.col("pattern"))).groupBy(*scope, "pattern").agg(F.count("*").alias("n"))
    total = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    if not scope:  # a running total over few rows is not worth one task for all patterns
        whole = counted.agg(F.sum("n").alias("total"))
        return counted.crossJoin(F.broadcast(whole)).withColumn("share", F.col("n") / F.col("total")).orderBy(F.desc("n"), "pattern").limit(top)
    ranked = counted.withColumn("total", F.sum("n").over(total)).withColumn("rank", F.row_number().over(total.orderBy(F.desc("n"), "pattern")))
    return ranked.where(F.col("rank") <= top).withColumn("share", F.col("n") / F.col("total"))


def mutation_modes(rounds: DataFrame, native: Column, shell: Column, key: Sequence[str]) -> DataFrame:
    """Per round whether natively edited, by the shell, both, or neither."""
    per = rounds.groupBy(*key).agg(F.bool_or(native).alias("native"), F.bool_or(shell).alias("shell"))
    return per.withColumn("mode", F.when(F.col("native") & F.col("shell"), "mixed").when(F.col("native"), "native").when(F.col("shell"), "shell").otherwise("none"))


def scope_counts(rows: DataFrame, one: str, two: str, counters: dict[str, Column]) -> DataFrame:
    """The same counters overall, by each of two dimensions, and by both, in one pass of grouping sets."""
    aggs = [c.alias(n) for n, c in counters.items()]
    return rows.groupingSets([[], [one], [two], [one, two]], one, two).agg(F.grouping_id().alias("_g"), *aggs).withColumn("scope", F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, one).when(F.col("_g") == 2, two).otherwise(f"{one}+{two}")).drop("_g")


def label_counts(rows: DataFrame, labels: str, chain: str, scope: Sequence[str]) -> DataFrame:
    """Calls and distinct chains of every label."""
    each = rows.select(*scope, chain, F.explode(labels).alias("label"))
    return each.groupBy(*scope, "label").agg(F.count("*").alias("calls"), F.count_distinct(chain).alias("chains"))


def tools_in_force(events: DataFrame, key: Sequence[str], seq: str, tool: str, added: str) -> DataFrame:
    """Replay of tools added and removed; those whose last event is an addition, sorted."""
    last = events.groupBy(*key, tool).agg(F.max_by(added, seq).alias("on"))
    return last.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("on"), F.col(tool)))).alias("tools"))


def reopened(events: DataFrame, key: str, seq: str, status: str) -> DataFrame:
    """Keys of which a closed event precedes an open one."""
    before = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    closed = F.max(F.col(status) == "closed").over(before)
    return events.withColumn("_c", F.coalesce(closed, F.lit(False))).groupBy(key).agg(F.bool_or(F.col("_c") & (F.col(status) == "open")).alias("reopened"))


def normalized_report(evidence: Evidence) -> DataFrame:
    """Per profile trials, passes, rounds, timeouts, seconds, calls by category, and its configuration's labels.

    The terminal round is the one with the largest number.
    """
    measures = scoreboard(trial_measures(evidence.trials, evidence.rounds), ["runId", "profileId"])
    owner = evidence.rounds.select("runId", "roundId", "trialId").join(evidence.trials.select("runId", "trialId", "profileId"), ["runId", "trialId"])
    per_round = evidence.tool_calls.groupBy("runId", "roundId", "category").agg(F.count("*").alias("n"))
    calls = per_round.join(owner, ["runId", "roundId"]).groupBy("runId", "profileId", "category").agg(F.sum("n").alias("n"))
    histogram = calls.groupBy("runId", "profileId").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    out = measures.join(histogram, ["runId", "profileId"], "left")
    if evidence.configurations is None:
        return out
    labels = evidence.configurations.select("configurationHash", F.col("configurationLabels").alias("labels")).dropDuplicates(["configurationHash"])
    named = evidence.profiles.select("runId", "profileId", "configurationHash").join(labels, "configurationHash", "left").drop("configurationHash")
    return out.join(named, ["runId", "profileId"], "left")


def first_proof(runs: DataFrame, proofs: DataFrame) -> DataFrame:
    """Each run with its proof of the smallest executionId; without one, an id made of run and attempt."""
    best = proofs.groupBy("runId").agg(F.min("executionId").alias("_e"))
    return runs.join(best, "runId", "left").withColumn("executionId", F.coalesce("_e", F.concat(F.lit("official-"), "runId", F.lit("-"), F.coalesce("attempt", F.lit(1)).cast("string")))).drop("_e")


def contributors_badge(people: DataFrame) -> DataFrame:
    """Distinct contributors, and the maintainer."""
    return people.select("platform", "accountId").distinct().agg((F.count("*") + 1).alias("contributors"))


def trials_of_cases(cases: DataFrame, trials: str = "trials") -> DataFrame:
    """Nested trials of several documents as rows; a (profile, task) pair that repeats fails."""
    from skyledger.operators.quality import duplicates, require

    rows = cases.select("profileId", F.explode(trials).alias("t")).select("profileId", "t.*")
    require(duplicates(rows, ["profileId", "taskId"], "S09 trial"))
    return rows


def first_seen(rows: DataFrame, key: Sequence[str], carried: Sequence[str], order: str) -> DataFrame:
    """Per key the other columns of its first row under an order; never of just any row."""
    return rows.groupBy(*key).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in carried])


def with_suffix(rows: DataFrame, column: str, suffix: str = "-ide") -> DataFrame:
    """rows of profiles with the suffix."""
    return rows.where(F.col(column).endswith(suffix))


def failed_first(rows: DataFrame, passed: str = "firstExactPassed") -> DataFrame:
    """rows that did not pass at first; unknown counts as not passed."""
    return rows.where(~F.coalesce(F.col(passed), F.lit(False)))


def below(rows: DataFrame, value: str, limit: float = 75.0) -> DataFrame:
    """rows with a value under the limit."""
    return rows.where(F.col(value) < limit)


def batches(rows: DataFrame, kinds: dict[str, int], kind: str, order: Sequence[str]) -> DataFrame:
    """The first rows of each kind, as many as the kind's allowance: a bounded batch of waiting candidates."""
    most = F.lit(0)
    for name, n in kinds.items():
        most = F.when(F.col(kind) == name, n).otherwise(most)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("rank") <= most)
