"""Leaderboards over cells: exact configurations, their rollup, and the orders in which both are listed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.evidence import Evidence
from skyledger.functions.identity import metric_average, natural_key, reasoning_rank
from skyledger.operators.cells import BENCHMARK, COMPARISON, METRICS, ROLLUP, benchmark_counts, cells, task_samples, trial_facts

QUARANTINE_TRIALS, QUARANTINE_RATE = 50, 0.2


def sorted_set(c: str) -> Column:
    """Distinct non-null values in order."""
    return F.array_sort(F.collect_set(c))


def only_one(values: Column, otherwise: Column | None = None) -> Column:
    """The value of a singleton, else null or the given value."""
    return F.when(F.size(values) == 1, F.element_at(values, 1)).otherwise(F.lit(None) if otherwise is None else otherwise)


def quarantined(observations: Column, failures: Column) -> Column:
    """Enough trials, and a fifth or more of them failed by the provider."""
    return (observations >= QUARANTINE_TRIALS) & (F.try_divide(failures, observations) >= QUARANTINE_RATE)


def exact_from_cells(task_cells: DataFrame, counts: DataFrame) -> DataFrame:
    """A01, A04-A06, A09-A11, A14 from cells: one row per comparison key."""
    metric = [x for m in METRICS for x in (F.sum(f"{m}_total").alias(f"{m}_total"), F.sum(f"{m}_n").alias(f"{m}_n"))]
    rows = task_cells.groupBy(*COMPARISON).agg(
        F.sum("n").alias("observations"), F.sum("firstPasses").alias("firstExactPasses"), F.sum("finalPasses").alias("finalExactPasses"), F.avg(F.col("firstPasses") / F.col("n")).alias("firstExactRate"), F.avg(F.col("finalPasses") / F.col("n")).alias("finalExactRate"), F.count("*").alias("taskCount"),
        F.sum("recoveryRounds").alias("recoveryRounds"), F.sum("infrastructureFailures").alias("infrastructureFailures"), F.sum("timeouts").alias("timeouts"), F.sum("providerFailureTrials").alias("providerFailureTrials"),
        F.sum(F.when(F.col("duration_n") > 0, F.col("duration_total") / F.col("duration_n"))).alias("_run"), F.count_if(F.col("duration_n") > 0).alias("coveredTasks"), *metric,
    )
    same = [rows[c].eqNullSafe(counts[c]) for c in BENCHMARK]
    joined = rows.join(counts, same[0] & same[1] & same[2] & same[3], "left").select(*[rows[c] for c in rows.columns], F.coalesce("benchmarkTasks", "taskCount").alias("benchmarkTaskCount"))
    quality, coverage = 0.75 * F.col("firstExactRate") + 0.25 * F.col("finalExactRate"), F.col("taskCount") / F.col("benchmarkTaskCount")
    out = F.col("observations"), F.col("providerFailureTrials")
    return joined.withColumns({
        "recoveryGain": F.col("finalExactRate") - F.col("firstExactRate"), "qualityScore": quality, "coverage": coverage, "score": quality * coverage, "complete": F.col("taskCount") == F.col("benchmarkTaskCount"), "rankingEligible": ~quarantined(*out), "rankingEligibilityReason": F.when(quarantined(*out), "provider-failure-rate"), "providerFailureRate": F.try_divide(out[1], out[0]),
        "durationAverageCase": metric_average(F.col("duration_total"), F.col("duration_n")), "durationCoveredRun": F.when(F.col("coveredTasks") == F.col("taskCount"), F.col("_run")), "durationTotalObserved": F.when(F.col("duration_n") > 0, F.col("duration_total")),
    }).drop("_run")


def provenance(facts: DataFrame, key: Sequence[str] = COMPARISON) -> DataFrame:
    """Which runs, submissions, policies, task sets and hashes stand behind a row."""
    sets = {"runIds": "runId", "sourceProfiles": "profileId", "submissionIds": "submissionId", "taskSetSha256s": "taskSetSha256", "policies": "policy", "runnerVersions": "runnerVersion", "concurrencies": "concurrency", "configurationHashes": "configurationHash", "taskFamilies": "taskFamily"}
    rows = facts.groupBy(*key).agg(*[sorted_set(c).alias(n) for n, c in sets.items()])
    one = {"taskSetSha256": "taskSetSha256s", "policy": "policies", "runnerVersion": "runnerVersions", "concurrency": "concurrencies"}
    return rows.withColumns({n: only_one(F.col(c)) for n, c in one.items()} | {"configurationHash": only_one(F.col("configurationHashes"), F.lit("aggregate"))})


def exact_configurations(evidence: Evidence, filters: Mapping[str, Sequence] | None = None, *, with_provenance: bool = False, with_samples: bool = False) -> DataFrame:
    """The exact-configuration leaderboard; filters apply to trials, never to the benchmark's denominator."""
    facts = trial_facts(evidence, filters)
    rows = exact_from_cells(cells(facts), benchmark_counts(evidence.runs))
    for more in [provenance(facts)] * with_provenance + [task_samples(facts).groupBy(*COMPARISON).agg(F.array_sort(F.collect_list(F.struct("taskId", "samples"))).alias("configurationTaskCells"))] * with_samples:
        other = more.toDF(*[f"_{c}" if c in COMPARISON else c for c in more.columns])
        on = F.lit(True)
        for c in COMPARISON:
            on = on & rows[c].eqNullSafe(other[f"_{c}"])
        rows = rows.join(other, on).drop(*[f"_{c}" for c in COMPARISON])
    return rows


def rollup(exact: DataFrame) -> DataFrame:
    """Exact rows rolled up over reasoning modes, benchmark versions and benchmarks.

    Rates and quality are means of means of means over eligible rows; coverage is their flat mean; totals are over all rows.
    """
    rates = ["qualityScore", "firstExactRate", "finalExactRate", "recoveryGain"]
    by_version = exact.groupBy(*ROLLUP, "benchmarkId", "benchmarkVersion").agg(
        F.count_if("rankingEligible").alias("_eligible"), *[F.avg(F.when(F.col("rankingEligible"), F.col(c))).alias(c) for c in rates], F.sum(F.when(F.col("rankingEligible"), F.coalesce("coverage", F.lit(0.0)))).alias("_coverage"), F.count("*").alias("_rows"),
        *[F.sum(c).alias(c) for c in ("observations", "providerFailureTrials", "recoveryRounds", "taskCount", "coveredTasks", "duration_total", "duration_n", "cost_total", "cost_n", "tokens_total", "tokens_n")], F.max("benchmarkTaskCount").alias("benchmarkTaskCount"),
        F.sum("durationCoveredRun").alias("_run"), F.count("durationCoveredRun").alias("_runs"), F.collect_set(F.coalesce("thinking", F.lit("unknown"))).alias("_modes"), F.collect_set("contract").alias("_contracts"),
    )
    sums = ["observations", "providerFailureTrials", "recoveryRounds", "taskCount", "coveredTasks", "duration_total", "duration_n", "cost_total", "cost_n", "tokens_total", "tokens_n", "_eligible", "_coverage", "_rows", "_run", "_runs"]
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("_modes", "_contracts")]
    by_benchmark = by_version.groupBy(*ROLLUP, "benchmarkId").agg(*[F.avg(c).alias(c) for c in rates], *[F.sum(c).alias(c) for c in sums], F.max("benchmarkTaskCount").alias("benchmarkTaskCount"), F.count("*").alias("_versions"), *lists)
    top = by_benchmark.groupBy(*ROLLUP).agg(*[F.avg(c).alias(c) for c in rates], *[F.sum(c).alias(c) for c in sums], F.max("benchmarkTaskCount").alias("benchmarkTaskCount"), F.sum("_versions").alias("benchmarkVersionCount"), F.count_if(F.col("_eligible") > 0).alias("benchmarkFamilyCount"), F.array_sort(F.collect_set(F.when(F.col("_eligible") > 0, F.col("benchmarkId")))).alias("benchmarkIds"), *lists)
    coverage, modes = F.coalesce(F.try_divide("_coverage", "_eligible"), F.lit(0.0)), F.array_sort(F.array_distinct("_modes"))
    plural = lambda n, one, many: F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))
    return top.select(
        *ROLLUP, *rates, coverage.alias("coverage"), (F.col("qualityScore") * coverage).alias("score"), "observations", (F.col("_eligible") > 0).alias("rankingEligible"), F.when(F.col("_eligible") == 0, "provider-failure-rate").alias("rankingEligibilityReason"), (F.col("_rows") - F.col("_eligible")).alias("quarantinedConfigurationCount"),
        "providerFailureTrials", F.try_divide("providerFailureTrials", "observations").alias("providerFailureRate"), "recoveryRounds", "taskCount", "benchmarkTaskCount", ((F.col("_eligible") > 0) & (coverage == 1)).alias("complete"), "benchmarkFamilyCount", "benchmarkVersionCount", "benchmarkIds",
        F.size(modes).cast("long").alias("reasoningModeCount"), F.when(F.size(modes) > 1, "task-modes").otherwise("tasks").alias("evidenceUnit"), F.concat(F.lit("All · "), plural(F.col("benchmarkFamilyCount"), "family", "families")).alias("benchmarkId"), plural(F.col("benchmarkVersionCount"), "version", "versions").alias("benchmarkVersion"),
        F.when(F.size(modes) == 1, modes[0]).otherwise(F.concat(F.lit("All · "), F.size(modes).cast("string"), F.lit(" modes"))).alias("thinking"), F.array_join(F.array_sort(F.array_distinct("_contracts")), ", ").alias("contract"),
        *[c for m in METRICS for c in (f"{m}_total", f"{m}_n")], metric_average(F.col("duration_total"), F.col("duration_n")).alias("durationAverageCase"), F.try_divide("_run", "_runs").alias("durationCoveredRun"), F.when(F.col("duration_n") > 0, F.col("duration_total")).alias("durationTotalObserved"), "coveredTasks",
    )


def leaderboard(evidence: Evidence, filters: Mapping[str, Sequence] | None = None) -> DataFrame:
    return rollup(exact_configurations(evidence, filters))


def sort_keys(by: str, rolled: bool) -> list[Column]:
    """What a listing is sorted by. The rollup sorts reasoning as text, exact rows by the mode's rank."""
    simple = {"score": "score", "evidence": "coverage", "observations": "observations", "first": "firstExactRate", "final": "finalExactRate", "quality": "qualityScore", "recovery": "recoveryGain", "duration": "durationAverageCase"}
    averages = {"cost": "cost", "tokens": "tokens"}
    texts = {"model": ["modelFamily"], "provider": ["provider"], "agent": ["agentFamily"], "harness": ["harnessFamily"], "benchmark": ["benchmarkId"], "agentVersion": ["agentFamily", "agentVersion"], "harnessVersion": ["harnessFamily", "harnessVersion"], "benchmarkVersion": ["benchmarkId", "benchmarkVersion"]}
    if by in simple:
        return [F.col(simple[by])]
    if by in averages:
        return [metric_average(F.col(f"{by}_total"), F.col(f"{by}_n"))]
    if by == "reasoning":
        return [F.col("thinking") if rolled else reasoning_rank(F.col("thinking"))]
    return [F.when(F.col(c).isNotNull(), natural_key(F.col(c))) for c in texts[by]]


def ordered(rows: DataFrame, by: str = "score", direction: str = "desc", *, rolled: bool = True) -> DataFrame:
    """The listing. Nulls come last in either direction; ties are broken by the whole key."""
    keys = sort_keys(by, rolled)
    way = (lambda c: c.asc_nulls_last()) if direction == "asc" else (lambda c: c.desc_nulls_last())
    order = [c.asc_nulls_last() for c in keys[:-1]] + [way(keys[-1])]
    lead = [F.col("complete").desc(), F.col("coverage").desc_nulls_last()] if rolled else [F.col("complete").desc()] * (by == "score")
    return rows.orderBy(*lead, *order, F.col("observations").desc(), natural_key(F.col("modelFamily")).asc_nulls_last(), *[F.to_json(F.struct(*(ROLLUP if rolled else COMPARISON))).asc()])
