"""Evidence: the tables of repeated trials as DataFrames, and their derivation from the star schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyledger import schema

METRICS = {"duration": "seconds", "cost": "costUsd", "tokens": "totalTokens"}


def finite(c: Column) -> Column:
    """null, NaN and infinities become null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def round_sums() -> list[Column]:
    """Aggregates over a trial's rounds: their number, timeouts, provider failure, total and count of each metric."""
    sums = [x for m, c in METRICS.items() for x in (F.sum(finite(F.col(c))).alias(f"{m}_sum"), F.count(finite(F.col(c))).alias(f"{m}_seen"))]
    return [F.count("*").alias("seenRounds"), F.count_if(F.coalesce("timedOut", F.lit(False))).alias("timeouts"), F.max(F.col("providerFailure").isNotNull()).alias("providerFailed"), *sums]


@dataclass(frozen=True)
class Evidence:
    """measured: the trials with round_sums() beside them, where a source makes both in one pass; what else trials have is
    null. It holds for these trials and rounds only, so no constructor takes it and replace() drops it."""

    runs: DataFrame
    profiles: DataFrame
    trials: DataFrame
    rounds: DataFrame
    tool_calls: DataFrame
    configurations: DataFrame | None = None
    measured: DataFrame | None = field(default=None, init=False)

    def union(self, other: Evidence) -> Evidence:
        """Rows of both; every row carries its runId."""
        both = {n: getattr(self, n).unionByName(getattr(other, n), allowMissingColumns=True) for n in ("runs", "profiles", "trials", "rounds", "tool_calls")}
        one, two = self.configurations, other.configurations
        return Evidence(**both, configurations=one.unionByName(two, allowMissingColumns=True) if one is not None and two is not None else one or two)

    def only(self, run_ids: list[str]) -> Evidence:
        """The evidence of some runs, with its measures, as a trial and its rounds are of one run."""
        chosen = F.col("runId").isin(run_ids)
        out = replace(self, **{n: getattr(self, n).where(chosen) for n in ("runs", "profiles", "trials", "rounds", "tool_calls")})
        object.__setattr__(out, "measured", self.measured and self.measured.where(chosen))
        return out

    def with_rounds(self, rounds: DataFrame) -> Evidence:
        """The same evidence, its rounds read from a copy of them (a stored one, say)."""
        out = replace(self, rounds=rounds)
        object.__setattr__(out, "measured", self.measured)
        return out

    def copied(self, copy: Callable[[DataFrame], DataFrame]) -> Evidence:
        """The same evidence, its tables read from copies of them (stored ones, say); trials and measures share theirs."""
        measured = None
        if self.measured is not None:
            lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.trials.schema if f.name not in self.measured.columns]
            measured = copy(self.measured.select("*", *lacking))
        trials = copy(self.trials) if measured is None else measured.select(*self.trials.columns)
        out = replace(self, trials=trials, **{n: copy(getattr(self, n)) for n in ("runs", "profiles", "rounds", "tool_calls")})
        object.__setattr__(out, "measured", measured)
        return out


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the columns of ddl: missing ones null, others dropped, types cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in parsed(ddl)])


@cache
def parsed(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def task_id() -> Column:
    return F.concat("o_orderpriority", F.lit("/"), F.year("o_orderdate").cast("string"))


def from_star(spark: SparkSession, sf_dir: str) -> Evidence:
    """Runs are regions, profiles nation x segment, trials orders, rounds line items, tool calls events."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders, lines = read("orders"), read("lineitem")
    regions = read("region")
    nations = read("nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = read("customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    tasks = orders.select(task_id().alias("t")).distinct().agg(F.array_sort(F.collect_list("t")).alias("taskIds"))
    runs = regions.crossJoin(F.broadcast(tasks)).select(
        F.col("r_name").alias("runId"), F.concat(F.lit("submission-"), F.col("r_regionkey").cast("string")).alias("submissionId"), F.lit("orders-contract").alias("contract"), F.lit("tasks").alias("taskSetSha256"), F.lit("verifier").alias("verifierSha256"),
        F.struct(F.lit(2).alias("oracleRecoveries"), F.lit(0).alias("retryFailures"), (F.col("r_regionkey") + 1).cast("int").alias("concurrency"), F.lit(120000).cast("long").alias("timeoutMs")).alias("policy"),
        F.struct(F.struct(F.lit("star-orders").alias("id"), F.lit("1").alias("version"), F.lit("orders-contract").alias("contract"), F.lit("edit").alias("kind"), F.lit("hash").alias("hash")).alias("benchmark"), F.struct(F.lit("tasks").alias("hash"), F.col("taskIds")).alias("taskSet"), F.array(F.struct(F.lit("h").alias("id"), F.lit("h").alias("name"), F.lit("1").alias("version"), F.lit("s").alias("sourceHash"))).alias("harnesses"), F.struct(F.lit("runner").alias("id"), F.lit("runner").alias("name"), F.lit("1").alias("version")).alias("runner")).alias("definitions"),
        F.struct(F.lit("hub").alias("platform"), F.concat(F.lit("account-"), F.col("r_regionkey").cast("string")).alias("accountId"), F.lit("https://hub.example/a").alias("profileUrl")).alias("submittedBy"),
    )
    profile_id = F.concat("n_name", F.lit("/"), "c_mktsegment")
    thinking = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    profiles = customers.select("n_name", "c_mktsegment", "r_name", "n_nationkey").distinct().select(
        F.col("r_name").alias("runId"), profile_id.alias("profileId"), F.col("n_name").alias("modelId"), F.col("n_name").alias("model"), F.col("n_name").alias("modelFamily"), F.lit("1").alias("modelVersion"), F.col("c_mktsegment").alias("harnessId"), F.col("c_mktsegment").alias("harnessFamily"),
        F.lit("1").alias("harnessVersion"), F.col("r_name").alias("provider"), thinking.alias("thinking"), F.lit("agent").alias("agentFamily"), F.lit("1").alias("agentVersion"), F.lit("cli").alias("harnessKind"), F.lit("1").alias("adapterVersion"), F.array().cast("array<string>").alias("configurationLabels"),
    )
    measures = [
        F.col("l_quantity").alias("seconds"), F.when(F.col("l_tax") < 0.08, F.col("l_extendedprice")).alias("costUsd"), F.col("l_quantity").cast("long").alias("totalTokens"), (F.col("l_returnflag") == "R").alias("timedOut"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09), F.lit("rate-limit")).alias("providerFailure"),
    ]
    # rounds are aggregated by order before orders meet customers, once for trials and their measures
    per_order = lines.select("l_orderkey", *measures).groupBy("l_orderkey").agg(*round_sums())
    placed = orders.join(customers.select("c_custkey", "n_name", "c_mktsegment", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
    measured = placed.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("r_name").alias("runId"), F.col("o_orderkey").cast("string").alias("trialId"), task_id().alias("taskId"), profile_id.alias("profileId"), (F.col("o_orderstatus") == "F").alias("firstExactPassed"), F.col("o_orderstatus").isin("F", "P").alias("finalExactPassed"),
        F.coalesce("seenRounds", F.lit(0)).cast("int").alias("rounds"), F.when(F.col("seenRounds").isNull(), F.lit("missing-file")).alias("infrastructureFailure"), *[c for c in per_order.columns if c != "l_orderkey"],
    )
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    numbered = lines.withColumn("round", F.row_number().over(order) - 1)
    owner = placed.select(F.col("o_orderkey").alias("_key"), F.col("r_name").alias("runId"))
    rounds = numbered.join(owner, F.col("l_orderkey") == F.col("_key")).select(
        "runId", F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("round").cast("string")).alias("roundId"), F.col("l_orderkey").cast("string").alias("trialId"), "round", *measures, F.lit(0).alias("exitCode"),
    )
    calls = read("events").join(owner, F.col("event_id") == F.col("_key")).select(
        "runId", F.concat(F.col("event_id").cast("string"), F.lit("/0")).alias("roundId"), F.get_json_object("props", "$.k").cast("int").alias("ordinal"), F.col("event_type").alias("tool"), F.lit("other").alias("category"),
    )
    out = Evidence(conform(runs, schema.RUNS), conform(profiles, schema.PROFILES), conform(measured, schema.TRIALS), conform(rounds, schema.ROUNDS), conform(calls, schema.TOOL_CALLS))
    object.__setattr__(out, "measured", measured)  # frozen, and init takes no measures
    return out
