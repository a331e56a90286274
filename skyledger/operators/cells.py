"""From evidence to per-trial facts and per-task cells: the core that leaderboards, families and states share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.evidence import METRICS, Evidence, round_sums
from skyledger.functions.classify import task_family
from skyledger.functions.identity import canonical_model, canonical_policy

BENCHMARK = ["benchmarkId", "benchmarkVersion", "contract", "verifierSha256"]
#: Fields of the comparison and rollup keys: fixed values.
COMPARISON = [
    "benchmarkId", "benchmarkVersion", "contract", "verifierSha256", "runnerFamily", "modelFamily", "modelVersion", "agentFamily", "agentVersion", "harnessFamily", "harnessVersion", "provider", "transport", "harnessKind", "adapterVersion", "configurationLabels", "thinking",
]
ROLLUP = ["verifierSha256", "modelFamily", "modelVersion", "agentFamily", "agentVersion", "harnessFamily", "harnessVersion", "provider", "configurationLabels", "transport", "harnessKind", "adapterVersion"]
PROVENANCE = ["runId", "profileId", "submissionId", "taskSetSha256", "policy", "runnerVersion", "concurrency", "configurationHash"]


def round_stats(rounds: DataFrame) -> DataFrame:
    """Rounds, timeouts, provider failure, and total and count of each metric, per trial."""
    return rounds.groupBy("runId", "trialId").agg(*round_sums())


def run_identity(runs: DataFrame) -> DataFrame:
    benchmark, policy = F.col("definitions.benchmark"), F.col("policy")
    return runs.select(
        "runId", F.coalesce(benchmark["id"], "contract").alias("benchmarkId"), benchmark["version"].alias("benchmarkVersion"), "contract", "verifierSha256", "submissionId", "taskSetSha256", canonical_policy(policy).alias("policy"),
        F.col("definitions.runner.id").alias("runnerFamily"), F.col("definitions.runner.version").alias("runnerVersion"), policy["concurrency"].alias("concurrency"), F.size(F.coalesce("definitions.taskSet.taskIds", F.array().cast("array<string>"))).alias("declared"),
    )


def benchmark_counts(runs: DataFrame) -> DataFrame:
    """The largest declared task count of each benchmark; filters never touch it."""
    return run_identity(runs).where("declared >= 1").groupBy(*BENCHMARK).agg(F.max("declared").cast("long").alias("benchmarkTasks"))


def profile_identity(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "runId", "profileId", F.coalesce("modelFamily", "modelId", "model").alias("modelFamily"), F.coalesce("modelVersion", "model").alias("modelVersion"), "agentFamily", "agentVersion", F.coalesce("harnessFamily", "harnessId").alias("harnessFamily"), "harnessVersion", "provider", "transport", "harnessKind", "adapterVersion",
        F.array_sort(F.coalesce("configurationLabels", F.array().cast("array<string>"))).alias("configurationLabels"), "thinking", F.coalesce("configurationHash", F.concat_ws("/", "runId", "profileId")).alias("configurationHash"),
    )


def identities(evidence: Evidence) -> DataFrame:
    """A row per profile of a known run, with the identity of both."""
    return run_identity(evidence.runs).join(profile_identity(evidence.profiles), "runId")


def selected(value: Column, chosen: Sequence | None) -> Column:
    """an empty selection takes everything; a selection that lists None takes nulls too."""
    if not chosen:
        return F.lit(True)
    some = F.coalesce(value.isin([x for x in chosen if x is not None]), F.lit(False))
    return some | value.isNull() if None in chosen else some


def matches(filters: Mapping[str, Sequence]) -> Column:
    """conjunction of facet selections. Version facets are given as family, tab, version."""
    pair = lambda a, b: F.concat(F.coalesce(F.col(a), F.lit("")), F.lit("\t"), F.coalesce(F.col(b), F.lit("")))
    columns = {
        "benchmark": F.col("benchmarkId"), "benchmarkVersion": pair("benchmarkId", "benchmarkVersion"), "runner": F.col("runnerFamily"), "provider": F.col("provider"), "agent": F.col("agentFamily"), "agentVersion": pair("agentFamily", "agentVersion"),
        "harness": F.col("harnessFamily"), "harnessVersion": pair("harnessFamily", "harnessVersion"), "reasoning": F.col("thinking"), "taskFamily": F.col("taskFamily"),
    }
    out = F.lit(True)
    for facet, chosen in filters.items():
        if facet == "model":
            out = out & selected(canonical_model(F.col("modelFamily")), [x and x.split("/")[-1] for x in chosen])
        elif facet in columns:
            out = out & selected(columns[facet], chosen)
    return out


def trial_facts(evidence: Evidence, filters: Mapping[str, Sequence] | None = None, stats: DataFrame | None = None, *, known: DataFrame | None = None, beside: Sequence[DataFrame] = ()) -> DataFrame:
    """A row per trial of a known run and profile, with identity, passes and metrics.

    A metric counts only if all declared rounds were seen and each reported it. Rounds are aggregated before the join;
    evidence that comes with measured trials needs neither. known: identities(), where they are at hand; beside: tables by
    runId and trialId. The further columns of both follow the facts. Trials get what is beside them while they are narrow.
    """
    known = identities(evidence) if known is None else known
    source = evidence.measured if stats is None else None
    together = source is not None
    carried = [c for c in source.columns if c not in evidence.trials.columns] if together else []
    trials = (source if together else evidence.trials).select("runId", "trialId", "taskId", "profileId", F.coalesce("firstExactPassed", F.lit(False)).alias("first"), F.coalesce("finalExactPassed", F.lit(False)).alias("final"), "rounds", "infrastructureFailure", task_family(F.col("taskId")).alias("taskFamily"), *carried)
    key = ["runId", "trialId"]
    if not together:
        trials = trials.join(round_stats(evidence.rounds) if stats is None else stats, key, "left")
    further = {c: f"_beside_{c}" for t in beside for c in t.columns if c not in key}  # facts have names of their own
    for t in beside:
        trials = trials.join(t.withColumnsRenamed(further), key, "left")
    joined = trials.join(known, ["runId", "profileId"]).where(matches(filters or {}))
    rest = [c for c in known.columns if c not in {*COMPARISON, *PROVENANCE, "declared", "runnerVersion"}]
    whole = F.coalesce(F.col("seenRounds") == F.col("rounds"), F.lit(False))
    values = [F.when(whole & (F.col(f"{m}_seen") == F.col("rounds")), F.col(f"{m}_sum")).alias(m) for m in METRICS]
    return joined.select(
        *COMPARISON, *[c for c in PROVENANCE if c not in COMPARISON], "trialId", "taskId", "taskFamily", "first", "final", "rounds", F.coalesce(F.col("infrastructureFailure") != "", F.lit(False)).alias("infra"),
        F.when(whole, F.col("timeouts")).otherwise(0).alias("timeouts"), (whole & F.coalesce("providerFailed", F.lit(False))).alias("providerFailed"), *values,
        *[F.col(own).alias(c) for c, own in further.items()], *rest,
    )


def cells(facts: DataFrame, key: Sequence[str] = COMPARISON) -> DataFrame:
    """A13 in numbers: per key and task what leaderboards need; sums and counts, so cells of several runs merge."""
    metric = [x for m in METRICS for x in (F.sum(m).alias(f"{m}_total"), F.count(m).alias(f"{m}_n"))]
    return facts.groupBy(*key, "taskId").agg(
        F.count("*").alias("n"), F.count_if("first").alias("firstPasses"), F.count_if("final").alias("finalPasses"), F.sum(F.greatest(F.lit(0), F.col("rounds") - 1)).alias("recoveryRounds"), F.count_if("infra").alias("infrastructureFailures"), F.sum("timeouts").alias("timeouts"), F.count_if("providerFailed").alias("providerFailureTrials"), *metric,
    )


def task_samples(facts: DataFrame, key: Sequence[str] = COMPARISON) -> DataFrame:
    """Per key and task the trials themselves, ordered by trial."""
    sample = F.struct("trialId", F.col("first").alias("firstExactPassed"), F.col("final").alias("finalExactPassed"), F.col("duration").alias("seconds"), F.col("cost").alias("costUsd"), "tokens")
    return facts.groupBy(*key, "taskId").agg(F.array_sort(F.collect_list(sample)).alias("samples"))
