"""Scores of families of configurations: medians of complete rows, grouping sets, latest versions, complete runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.evidence import Evidence, finite
from skyledger.functions.identity import version_key


def distribution(value: Column) -> Column:
    """Count, min, quartiles by linear interpolation, max and mean of finite values; null without any."""
    v = finite(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return F.when(F.count(v) > 0, F.struct(F.count(v).alias("count"), F.min(v).alias("min"), q[0].alias("p25"), q[1].alias("median"), q[2].alias("p75"), F.max(v).alias("max"), F.avg(v).alias("mean")))


def family_score(rows: DataFrame, key: Sequence[str], score: str = "score") -> DataFrame:
    """Medians over complete rows; partial rows only count. A group without complete rows has null scores."""
    complete = F.coalesce("complete", F.lit(False))
    of = lambda c: F.when(complete, F.col(c))
    return rows.groupBy(*key).agg(
        *[F.percentile(finite(of(c)), 0.5).alias(c) for c in ("firstExactRate", "finalExactRate", "qualityScore", "coverage")], F.percentile(finite(of(score)), 0.5).alias("score"), distribution(of(score)).alias("scoreDistribution"),
        F.coalesce(F.max(of("taskCount")), F.lit(0)).cast("long").alias("taskCount"), F.coalesce(F.max(of("benchmarkTaskCount")), F.lit(0)).cast("long").alias("benchmarkTaskCount"), F.coalesce(F.sum(of("observations")), F.lit(0)).cast("long").alias("observations"), F.count("*").alias("configurationCount"), F.count_if(complete).alias("completeConfigurationCount"),
    )


FACETS = {"route": ["provider", "modelFamily"], "family": ["modelFamily"], "agent": ["agentFamily"], "harness": ["harnessFamily"], "thinking": ["thinking"]}


def family_group_scores(rows: DataFrame, score: str = "score") -> DataFrame:
    """The five one-facet groupings of eligible rows, as facet, key and A22's columns.

    Rows are spread over their facets in one pass, so there is one shuffle for all five.
    """
    label = lambda cols: F.concat_ws("/", *cols)
    facets = F.array(*[F.struct(F.lit(n).alias("facet"), label(cols).alias("key")) for n, cols in FACETS.items()])
    eligible = rows.where(F.coalesce("rankingEligible", F.lit(True)))
    return family_score(eligible.withColumn("_f", F.explode(facets)).select("*", "_f.facet", "_f.key"), ["facet", "key"], score)


def model_leaderboard(rows: DataFrame, score: str = "score") -> DataFrame:
    """Route scores with the harnesses of their eligible rows; best first, null scores as 0."""
    eligible = rows.where(F.coalesce("rankingEligible", F.lit(True)))
    harnesses = eligible.groupBy("provider", "modelFamily").agg(F.array_sort(F.collect_set("harnessFamily")).alias("harnesses")).select(F.col("provider").alias("_p"), F.col("modelFamily").alias("_m"), "harnesses")
    scores = family_score(eligible, ["provider", "modelFamily"], score)
    joined = scores.join(harnesses, scores.provider.eqNullSafe(F.col("_p")) & scores.modelFamily.eqNullSafe(F.col("_m"))).drop("_p", "_m")
    return joined.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "modelFamily", "provider")


def latest_version(rows: DataFrame, family: str, version: str) -> DataFrame:
    """The latest version of each family."""
    return rows.where(F.col(version).isNotNull()).groupBy(family).agg(F.max_by(version, version_key(F.col(version))).alias(version))


def latest_harness_groups(rows: DataFrame, score: str = "score") -> DataFrame:
    """Scores of each harness family at its latest version."""
    latest = latest_version(rows, "harnessFamily", "harnessVersion")
    return family_score(rows.join(latest, ["harnessFamily", "harnessVersion"]), ["harnessFamily", "harnessVersion"], score)


def complete_runs(trials: DataFrame, declared: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Runs of which every profile covers exactly the canonical number of tasks (relational division).

    declared: declaredTasks per run; the canonical number is the largest of all. profiles without trials fail their run.
    """
    tasks = trials.groupBy("runId", "profileId").agg(F.count_distinct("taskId").alias("tasks"))
    if profiles is not None:
        tasks = profiles.select("runId", "profileId").distinct().join(tasks, ["runId", "profileId"], "left")
    most = declared.agg(F.max("declaredTasks").alias("canonical"))  # one row
    covered = F.coalesce(F.col("tasks"), F.lit(0)) == F.col("canonical")
    return tasks.crossJoin(F.broadcast(most)).groupBy("runId").agg(F.bool_and(covered).alias("complete"), F.count("*").alias("profiles")).where("complete").select("runId", "profiles")


def complete_evidence(evidence: Evidence) -> Evidence:
    """A26 over all tables: only what belongs to complete runs stays."""
    declared = evidence.runs.select("runId", F.size("definitions.taskSet.taskIds").alias("declaredTasks"))
    keep = complete_runs(evidence.trials, declared, evidence.profiles).select("runId")
    return Evidence(*[getattr(evidence, n).join(keep, "runId", "left_semi") for n in ("runs", "profiles", "trials", "rounds", "tool_calls")])


def complete_harness_groups(evidence: Evidence) -> DataFrame:
    """A25 over complete runs, with null scores for harness families that have none."""
    from skyledger.operators.leaderboard import leaderboard

    scored = latest_harness_groups(leaderboard(complete_evidence(evidence)))
    families = evidence.profiles.select(F.coalesce("harnessFamily", "harnessId").alias("harnessFamily")).distinct()
    return families.join(scored, "harnessFamily", "left")


def facets(evidence: Evidence) -> DataFrame:
    """The sorted distinct values of every filter facet, one row per facet."""
    from skyledger.operators.cells import trial_facts

    facts = trial_facts(evidence)
    pair = lambda a, b: F.when(F.col(b).isNotNull(), F.concat(F.col(a), F.lit("\t"), F.col(b)))
    columns = {"benchmark": F.col("benchmarkId"), "benchmarkVersion": pair("benchmarkId", "benchmarkVersion"), "runner": F.col("runnerFamily"), "provider": F.col("provider"), "model": F.element_at(F.split("modelFamily", "/"), -1), "agent": F.col("agentFamily"), "agentVersion": pair("agentFamily", "agentVersion"), "harness": F.col("harnessFamily"), "harnessVersion": pair("harnessFamily", "harnessVersion"), "reasoning": F.col("thinking"), "taskFamily": F.col("taskFamily")}
    small = facts.select(*[c.alias(n) for n, c in columns.items()]).distinct()
    values = small.select(F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in columns])).alias("f")).select("f.*").where("value is not null")
    return values.groupBy("facet").agg(F.array_sort(F.collect_set("value")).alias("values"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group under a total order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)
