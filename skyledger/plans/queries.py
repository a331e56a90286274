"""Registered queries over the star schema, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.evidence import LINE_ORDER, from_star, task_id
from skyledger.functions import classify, identity
from skyledger.functions.text import only_ascii_layout, only_eof, only_line_breaks
from skyledger.operators import cells as C
from skyledger.operators import events as EV
from skyledger.operators import families as FA
from skyledger.operators import leaderboard as L
from skyledger.operators import quality as Q
from skyledger.operators import stats as ST
from skyledger.operators import summary as S
from skyledger.operators import tasks as T
from skyledger.sources.writers import stored
from skyledger.streaming import state as STATE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, places: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


#: SQL: submissions of queue (i, owner, client, run, h, id) one by one, with all that are in so far.
SERVED = """served(i, kept, id, outcome, counted) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(client VARCHAR, h VARCHAR, run VARCHAR, id VARCHAR)[]), '', '', ''
  UNION ALL
  SELECT i, CASE WHEN outcome = 'created' THEN list_append(kept, {'client': concat(owner, chr(9), client), 'h': h, 'run': run, 'id': id}) ELSE kept END, id, outcome, counted
  FROM (
    SELECT *, CASE WHEN mine IS NOT NULL THEN CASE WHEN mine.h = h THEN 'duplicate' ELSE 'conflict' END WHEN same IS NOT NULL THEN 'duplicate' WHEN other IS NOT NULL THEN 'conflict' ELSE 'created' END AS outcome,
      CASE WHEN mine IS NOT NULL AND mine.h = h THEN mine.id WHEN mine IS NULL AND same IS NOT NULL THEN same.id ELSE id END AS counted
    FROM (
      SELECT q.*, s.kept, list_filter(s.kept, lambda x: x.client = concat(q.owner, chr(9), q.client))[1] AS mine, list_filter(s.kept, lambda x: x.h = q.h)[1] AS same, list_filter(s.kept, lambda x: x.run = q.run)[1] AS other
      FROM served s JOIN queue q ON q.i = s.i + 1)))"""
TRIALS = """
nat AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey, c_mktsegment, n_nationkey, n_name, r_name FROM customer JOIN nat ON c_nationkey = n_nationkey),
stats AS (
  SELECT l_orderkey, count(*) AS n_rounds, count(*) FILTER (l_returnflag = 'R') AS timeouts, bool_or(l_returnflag = 'R' AND l_discount >= 0.09e0) AS pf,
    sum(l_quantity) AS dur, sum(l_extendedprice) FILTER (l_tax < 0.08e0) AS cost, count(*) FILTER (l_tax < 0.08e0) AS cost_seen, sum(CAST(l_quantity AS BIGINT)) AS tok
  FROM lineitem GROUP BY l_orderkey),
trials AS (
  SELECT r_name AS run_id, o_orderkey, concat(o_orderpriority, '/', CAST(year(o_orderdate) AS VARCHAR)) AS task_id, concat(n_name, '/', c_mktsegment) AS profile_id, n_name, c_mktsegment, n_nationkey,
    CASE n_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS thinking, o_orderstatus = 'F' AS f, o_orderstatus IN ('F', 'P') AS g, coalesce(n_rounds, 0) AS rounds, n_rounds IS NULL AS infra,
    coalesce(timeouts, 0) AS timeouts, coalesce(pf, false) AS pf, dur, CASE WHEN cost_seen = n_rounds THEN cost END AS cost, CAST(tok AS DOUBLE) AS tok
  FROM orders JOIN cust ON o_custkey = c_custkey LEFT JOIN stats ON o_orderkey = l_orderkey)"""
EXACT = """
benchmark AS (SELECT count(DISTINCT concat(o_orderpriority, '/', CAST(year(o_orderdate) AS VARCHAR))) AS n FROM orders),
cells AS (
  SELECT run_id, n_name, c_mktsegment, thinking, task_id, count(*) AS n, count(*) FILTER (f) AS fp, count(*) FILTER (g) AS gp, sum(greatest(0, rounds - 1)) AS rec, count(*) FILTER (infra) AS inf, sum(timeouts) AS tmo, count(*) FILTER (pf) AS pff,
    sum(dur) AS dur, count(dur) AS dur_n, sum(cost) AS cost, count(cost) AS cost_n, sum(tok) AS tok, count(tok) AS tok_n
  FROM trials GROUP BY ALL),
base AS (
  SELECT run_id, n_name, c_mktsegment, thinking, sum(n) AS observations, avg(fp / n) AS fr, avg(gp / n) AS gr, count(*) AS tasks, sum(rec) AS rec, sum(inf) AS inf, sum(tmo) AS tmo, sum(pff) AS pff, sum(dur) AS dur, sum(dur_n) AS dur_n, sum(cost) AS cost, sum(cost_n) AS cost_n,
    sum(tok) AS tok, sum(tok_n) AS tok_n, sum(CASE WHEN dur_n > 0 THEN dur / dur_n END) AS run_s, count(*) FILTER (dur_n > 0) AS covered
  FROM cells GROUP BY run_id, n_name, c_mktsegment, thinking),
exact AS (
  SELECT b.*, k.n AS bench, 0.75e0 * fr + 0.25e0 * gr AS quality, tasks / k.n AS coverage, (0.75e0 * fr + 0.25e0 * gr) * (tasks / k.n) AS score, tasks = k.n AS complete, NOT (observations >= 50 AND pff / observations >= 0.2e0) AS eligible,
    CASE WHEN covered = tasks THEN run_s END AS covered_run
  FROM base b, benchmark k)"""


def exact(spark: SparkSession, sf_dir: str, filters=None) -> DataFrame:
    return L.exact_configurations(from_star(spark, sf_dir), filters)


def exact_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "provider", "modelFamily", "harnessFamily", "thinking", "observations", r("firstExactRate").alias("firstExactRate"), r("finalExactRate").alias("finalExactRate"), r("recoveryGain").alias("recoveryGain"), r("qualityScore").alias("qualityScore"), r("coverage").alias("coverage"), r("score").alias("score"), "taskCount", "benchmarkTaskCount", "complete", "rankingEligible",
        "recoveryRounds", "infrastructureFailures", "timeouts", "providerFailureTrials", r("duration_total", 4).alias("durationTotal"), "duration_n", r("cost_total", 2).alias("costTotal"), "cost_n", r("tokens_total", 4).alias("tokensTotal"), r("durationCoveredRun", 6).alias("coveredRun"),
    )


EXACT_SELECT = """SELECT run_id AS "provider", n_name AS "modelFamily", c_mktsegment AS "harnessFamily", thinking AS "thinking", CAST(observations AS BIGINT) AS "observations", round(fr, 9) AS "firstExactRate", round(gr, 9) AS "finalExactRate", round(gr - fr, 9) AS "recoveryGain", round(quality, 9) AS "qualityScore", round(coverage, 9) AS "coverage", round(score, 9) AS "score",
  tasks AS "taskCount", bench AS "benchmarkTaskCount", complete AS "complete", eligible AS "rankingEligible", CAST(rec AS BIGINT) AS "recoveryRounds", CAST(inf AS BIGINT) AS "infrastructureFailures", CAST(tmo AS BIGINT) AS "timeouts", CAST(pff AS BIGINT) AS "providerFailureTrials", round(dur, 4) AS "durationTotal", CAST(dur_n AS BIGINT) AS "duration_n",
  round(cost, 2) AS "costTotal", CAST(cost_n AS BIGINT) AS "cost_n", round(tok, 4) AS "tokensTotal", round(covered_run, 6) AS "coveredRun" FROM exact"""


@query(f"WITH {TRIALS}, {EXACT} {EXACT_SELECT}")
def leaderboard_exact(spark, sf_dir):
    return exact_columns(exact(spark, sf_dir))


@query(f"WITH {TRIALS.replace('trials AS (', 'every AS (')}, trials AS (SELECT * FROM every WHERE thinking IN ('low', 'high') AND c_mktsegment = 'BUILDING'), {EXACT} {EXACT_SELECT}")
def leaderboard_filtered(spark, sf_dir):
    return exact_columns(exact(spark, sf_dir, {"reasoning": ["low", "high"], "harness": ["BUILDING"], "model": []}))


ROLL = """SELECT n_name AS "modelFamily", c_mktsegment AS "harnessFamily", run_id AS "provider", round(avg(quality) FILTER (eligible), 9) AS "qualityScore", round(avg(fr) FILTER (eligible), 9) AS "firstExactRate", round(coalesce(avg(coverage) FILTER (eligible), 0), 9) AS "coverage",
  round(avg(quality) FILTER (eligible) * coalesce(avg(coverage) FILTER (eligible), 0), 9) AS "score", CAST(sum(observations) AS BIGINT) AS "observations", bool_or(eligible) AS "rankingEligible", count(*) FILTER (NOT eligible) AS "quarantinedConfigurationCount",
  coalesce(avg(coverage) FILTER (eligible), 0) = 1 AS "complete", CAST(sum(tasks) AS BIGINT) AS "taskCount", max(bench) AS "benchmarkTaskCount", CASE WHEN bool_or(eligible) THEN 'All · 1 family' ELSE 'All · 0 families' END AS "benchmarkId", '1 version' AS "benchmarkVersion", min(thinking) AS "thinking",
  round(sum(dur) / sum(dur_n), 6) AS "durationAverageCase", round(avg(covered_run), 6) AS "durationCoveredRun" FROM exact GROUP BY n_name, c_mktsegment, run_id"""


@query(f"WITH {TRIALS}, {EXACT} {ROLL}")
def leaderboard_rollup(spark, sf_dir):
    rows = L.leaderboard(from_star(spark, sf_dir))
    return rows.select("modelFamily", "harnessFamily", "provider", r("qualityScore").alias("qualityScore"), r("firstExactRate").alias("firstExactRate"), r("coverage").alias("coverage"), r("score").alias("score"), "observations", "rankingEligible", "quarantinedConfigurationCount", "complete", "taskCount", "benchmarkTaskCount", "benchmarkId", "benchmarkVersion", "thinking", r("durationAverageCase", 6).alias("durationAverageCase"), r("durationCoveredRun", 6).alias("durationCoveredRun"))


@query(f"""WITH {TRIALS}, {EXACT} SELECT n_name AS "modelFamily", c_mktsegment AS "harnessFamily", round(score, 9) AS "score", row_number() OVER (ORDER BY complete DESC, score DESC, observations DESC, n_name, c_mktsegment) AS "rank" FROM exact QUALIFY "rank" <= 20""")
def leaderboard_top(spark, sf_dir):
    rows = exact(spark, sf_dir).select("modelFamily", "harnessFamily", "complete", "score", "observations")
    order = Window.orderBy(F.desc("complete"), F.desc("score"), F.desc("observations"), "modelFamily", "harnessFamily")
    top = rows.orderBy(F.desc("complete"), F.desc("score"), F.desc("observations"), "modelFamily", "harnessFamily").limit(20)  # the report's length
    return top.select("modelFamily", "harnessFamily", r("score").alias("score"), F.row_number().over(order).cast("long").alias("rank"))


@query("""WITH d AS (SELECT l_orderkey, max(l_linenumber) AS declared, count(*) AS seen, sum(l_quantity) AS total, sum(l_extendedprice) FILTER (l_tax < 0.08e0) AS cost, count(*) FILTER (l_tax < 0.08e0) AS cost_seen FROM lineitem GROUP BY l_orderkey)
SELECT CAST(l_orderkey AS VARCHAR) AS "trialId", CASE WHEN seen = declared THEN total END AS "duration", round(CASE WHEN seen = declared AND cost_seen = declared THEN cost END, 2) AS "cost" FROM d""")
def coverage_guard(spark, sf_dir):
    """A03 where declared rounds and seen rounds differ."""
    e = from_star(spark, sf_dir)
    declared = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("trialId")).agg(F.max("l_linenumber").alias("declared"))
    trials = e.trials.join(declared, "trialId").withColumn("rounds", F.col("declared")).drop("declared")
    facts = C.trial_facts(type(e)(e.runs, e.profiles, trials, e.rounds, e.tool_calls))
    return facts.select("trialId", "duration", r("cost", 2).alias("cost"))


@query(f"""WITH {TRIALS} SELECT n_name AS "modelFamily", c_mktsegment AS "harnessFamily", task_id AS "taskId", count(*) AS "n", count(*) FILTER (f) AS "firstPasses", count(*) FILTER (g) AS "finalPasses", round(sum(dur), 4) AS "duration_total", count(dur) AS "duration_n", CAST(sum(greatest(0, rounds - 1)) AS BIGINT) AS "recoveryRounds" FROM trials GROUP BY ALL""")
def task_cells(spark, sf_dir):
    return C.cells(C.trial_facts(from_star(spark, sf_dir)), ["modelFamily", "harnessFamily"]).select("modelFamily", "harnessFamily", "taskId", "n", "firstPasses", "finalPasses", r("duration_total", 4).alias("duration_total"), "duration_n", "recoveryRounds")


@query(f"""WITH {TRIALS} SELECT n_name AS "modelFamily", task_id AS "taskId", string_agg(concat(CAST(o_orderkey AS VARCHAR), ':', CASE WHEN f THEN '1' ELSE '0' END, CASE WHEN g THEN '1' ELSE '0' END), ' ' ORDER BY CAST(o_orderkey AS VARCHAR)) AS "samples" FROM trials GROUP BY ALL""")
def task_samples_all(spark, sf_dir):
    """Every trial of every model gives a sample."""
    return sample_lines(C.trial_facts(from_star(spark, sf_dir)))


def sample_lines(facts: DataFrame) -> DataFrame:
    rows = C.task_samples(facts, ["modelFamily"])
    bit = lambda c: F.when(c, "1").otherwise("0")
    return rows.select("modelFamily", "taskId", F.array_join(F.transform("samples", lambda s: F.concat(s["trialId"], F.lit(":"), bit(s["firstExactPassed"]), bit(s["finalExactPassed"]))), " ").alias("samples"))


@query(f"""WITH {TRIALS} SELECT t.run_id AS "runId", t.profile_id AS "profileId", count(*) AS "rounds", round(sum(l_extendedprice) FILTER (l_tax < 0.08e0), 2) AS "costUsd", count(*) FILTER (l_tax < 0.08e0) AS "costUsdObserved", round(sum(l_quantity), 4) AS "seconds", count(*) AS "secondsObserved", CAST(NULL AS BIGINT) AS "inputTokens", CAST(0 AS BIGINT) AS "inputTokensObserved" FROM lineitem JOIN trials t ON t.o_orderkey = l_orderkey GROUP BY t.run_id, t.profile_id""")
def metric_coverage(spark, sf_dir):
    e = from_star(spark, sf_dir)
    return S.efficiency(e.trials, e.rounds).select("runId", "profileId", "rounds", r("costUsd", 2).alias("costUsd"), "costUsdObserved", r("seconds", 4).alias("seconds"), "secondsObserved", "inputTokens", "inputTokensObserved")


for _name, _key, _sql in (("trial_summary_task", "taskId", "task_id"), ("trial_summary_profile", "profileId", "profile_id")):
    def _summary(spark, sf_dir, key=_key):
        return S.pass_summary(from_star(spark, sf_dir).trials, [key]).select(key, "trials", "firstPasses", "finalPasses", r("firstRate").alias("firstRate"), r("finalRate").alias("finalRate"))

    _summary.__name__ = _name
    query(f"""WITH {TRIALS} SELECT {_sql} AS "{_key}", count(*) AS "trials", count(*) FILTER (f) AS "firstPasses", count(*) FILTER (g) AS "finalPasses", round(count(*) FILTER (f) / count(*), 9) AS "firstRate", round(count(*) FILTER (g) / count(*), 9) AS "finalRate" FROM trials GROUP BY {_sql}""")(_summary)


@query(f"""WITH {TRIALS}, t AS (SELECT task_id, avg(CAST(f AS INT)) AS a, avg(CAST(g AS INT)) AS b FROM trials GROUP BY task_id) SELECT round(avg(a), 9) AS "macroFirstRate", round(avg(b), 9) AS "macroFinalRate", count(*) AS "tasks" FROM t""")
def macro_rate(spark, sf_dir):
    return S.macro_rate(from_star(spark, sf_dir).trials).select(r("macroFirstRate").alias("macroFirstRate"), r("macroFinalRate").alias("macroFinalRate"), "tasks")


FAMILY_AGG = """round(quantile_cont(score, 0.5) FILTER (complete), 9) AS "score", round(quantile_cont(quality, 0.5) FILTER (complete), 9) AS "qualityScore", count(*) AS "configurationCount", count(*) FILTER (complete) AS "completeConfigurationCount", CAST(coalesce(sum(observations) FILTER (complete), 0) AS BIGINT) AS "observations" """


@query(f"""WITH {TRIALS}, {EXACT}, e AS (SELECT * FROM exact WHERE eligible), f AS (
SELECT 'route' AS facet, concat(run_id, '/', n_name) AS key, * FROM e UNION ALL SELECT 'family', n_name, * FROM e UNION ALL SELECT 'agent', 'agent', * FROM e UNION ALL SELECT 'harness', c_mktsegment, * FROM e UNION ALL SELECT 'thinking', thinking, * FROM e)
SELECT facet AS "facet", key AS "key", {FAMILY_AGG} FROM f GROUP BY facet, key""")
def family_scores(spark, sf_dir):
    return FA.family_group_scores(exact(spark, sf_dir)).select("facet", "key", r("score").alias("score"), r("qualityScore").alias("qualityScore"), "configurationCount", "completeConfigurationCount", "observations")


@query(f"""WITH {TRIALS}, {EXACT} SELECT c_mktsegment AS "harnessFamily", count(*) AS "n", round(min(score), 9) AS "low", round(quantile_cont(score, 0.25), 9) AS "p25", round(quantile_cont(score, 0.5), 9) AS "median", round(quantile_cont(score, 0.75), 9) AS "p75", round(max(score), 9) AS "high", round(avg(score), 9) AS "mean" FROM exact GROUP BY c_mktsegment""")
def score_distribution(spark, sf_dir):
    d = exact(spark, sf_dir).groupBy("harnessFamily").agg(FA.distribution(F.col("score")).alias("d"))
    return d.select("harnessFamily", F.col("d.count").alias("n"), *[r(F.col(f"d.{c}")).alias(n) for c, n in (("min", "low"), ("p25", "p25"), ("median", "median"), ("p75", "p75"), ("max", "high"), ("mean", "mean"))])


@query(f"""WITH {TRIALS}, {EXACT} SELECT run_id AS "provider", n_name AS "modelFamily", {FAMILY_AGG}, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS "harnesses" FROM exact WHERE eligible GROUP BY run_id, n_name""")
def model_routes(spark, sf_dir):
    return FA.model_leaderboard(exact(spark, sf_dir)).select("provider", "modelFamily", r("score").alias("score"), r("qualityScore").alias("qualityScore"), "configurationCount", "completeConfigurationCount", "observations", F.array_join("harnesses", ",").alias("harnesses"))


@query("""WITH v AS (SELECT DISTINCT p_type, concat(CAST(p_size % 5 AS VARCHAR), '.', CAST(p_size AS VARCHAR)) AS v, p_size % 5 AS a, p_size AS b FROM part) SELECT p_type AS "p_type", arg_max(v, a * 1000 + b) AS "version" FROM v GROUP BY p_type""")
def latest_version_group(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_type", F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), F.col("p_size").cast("string")).alias("version")).distinct()
    return FA.latest_version(parts, "p_type", "version")


@query("""WITH t AS (SELECT n_name, c_mktsegment, concat(o_orderpriority, '/', CAST(quarter(o_orderdate) AS VARCHAR)) AS task FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), k AS (SELECT count(DISTINCT task) AS n FROM t),
p AS (SELECT n_name, c_mktsegment, count(DISTINCT task) AS n FROM t GROUP BY ALL) SELECT n_name AS "runId", count(*) AS "profiles" FROM p, k GROUP BY n_name HAVING bool_and(p.n = k.n)""")
def complete_runs(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    trials = orders.select(F.col("n_name").alias("runId"), F.col("c_mktsegment").alias("profileId"), F.concat("o_orderpriority", F.lit("/"), F.quarter("o_orderdate").cast("string")).alias("taskId"))
    declared = trials.agg(F.count_distinct("taskId").alias("declaredTasks")).select(F.lit("all").alias("runId"), "declaredTasks")
    return FA.complete_runs(trials, declared)


@query(f"""WITH {TRIALS}, {EXACT} SELECT n_name AS "modelFamily", c_mktsegment AS "harnessFamily", CAST(observations AS BIGINT) AS "observations", CAST(pff AS BIGINT) AS "providerFailureTrials", round(pff / observations, 9) AS "providerFailureRate" FROM exact WHERE NOT eligible""")
def quarantine(spark, sf_dir):
    return exact(spark, sf_dir).where("not rankingEligible").select("modelFamily", "harnessFamily", "observations", "providerFailureTrials", r("providerFailureRate").alias("providerFailureRate"))


CALLS = "calls AS (SELECT t.*, e.event_type AS tool FROM events e JOIN trials t ON t.o_orderkey = e.event_id AND t.rounds > 0)"


@query(f"""WITH {TRIALS}, {CALLS}, g AS (SELECT n_name, c_mktsegment, count(*) AS trials FROM trials GROUP BY ALL), c AS (SELECT n_name, c_mktsegment, tool, count(*) AS calls FROM calls GROUP BY ALL)
SELECT g.n_name AS "modelFamily", g.c_mktsegment AS "harnessFamily", g.trials AS "trials", c.tool AS "tool", coalesce(c.calls, 0) AS "calls", round(coalesce(c.calls / sum(c.calls) OVER (PARTITION BY g.n_name, g.c_mktsegment), 0), 9) AS "share", round(coalesce(c.calls, 0) / g.trials, 9) AS "callsPerTrial" FROM g LEFT JOIN c ON c.n_name = g.n_name AND c.c_mktsegment = g.c_mktsegment""")
def tool_usage(spark, sf_dir):
    return S.tool_usage(from_star(spark, sf_dir)).select("modelFamily", "harnessFamily", "trials", "tool", "calls", r("share").alias("share"), r("callsPerTrial").alias("callsPerTrial"))


@query(f"""WITH {TRIALS}, {CALLS}, n AS (SELECT o_orderkey, count(*) AS n FROM calls WHERE tool = 'purchase' GROUP BY o_orderkey) SELECT CAST(t.o_orderkey AS VARCHAR) AS "trialId", coalesce(n.n, 0) AS "n" FROM trials t LEFT JOIN n ON n.o_orderkey = t.o_orderkey""")
def tool_trial_counts(spark, sf_dir):
    return S.tool_trial_counts(from_star(spark, sf_dir), "purchase").select("trialId", "n")


@query("""WITH p AS (SELECT user_id, CAST(ts AS DATE) AS d, string_agg(event_type, ' → ' ORDER BY ts, event_id, event_type) AS pattern FROM events GROUP BY ALL), n AS (SELECT pattern, count(*) AS n FROM p GROUP BY pattern), t AS (SELECT sum(n) AS total FROM n)
SELECT pattern AS "pattern", n AS "n", round(n / total, 9) AS "share" FROM n, t ORDER BY n DESC, pattern LIMIT 10""")
def tool_patterns(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), F.struct("ts", "event_id", "event_type").alias("ordinal"), F.col("event_type").alias("tool"))
    return S.tool_patterns(calls, ["user_id", "d"], []).select("pattern", "n", r("share").alias("share"))


@query("""SELECT user_id AS "user_id", CAST(ts AS DATE) AS "d", bool_or(event_type = 'purchase') AS "native", bool_or(event_type = 'click') AS "shell", CASE WHEN bool_or(event_type = 'purchase') AND bool_or(event_type = 'click') THEN 'mixed' WHEN bool_or(event_type = 'purchase') THEN 'native' WHEN bool_or(event_type = 'click') THEN 'shell' ELSE 'none' END AS "mode" FROM events GROUP BY ALL""")
def mutation_modes(spark, sf_dir):
    return S.mutation_modes(read(spark, sf_dir, "events").withColumn("d", F.to_date("ts")), F.col("event_type") == "purchase", F.col("event_type") == "click", ["user_id", "d"])


@query(f"""WITH {TRIALS} SELECT 'profiles' AS "kept", (SELECT count(DISTINCT (run_id, profile_id)) FROM (SELECT r_name AS run_id, concat(n_name, '/', c_mktsegment) AS profile_id, c_mktsegment FROM cust) WHERE c_mktsegment <> 'MACHINERY') AS "n" UNION ALL SELECT 'trials', count(*) FROM trials WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT 'rounds', count(*) FROM lineitem JOIN trials ON o_orderkey = l_orderkey WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT 'calls', count(*) FROM events JOIN trials ON o_orderkey = event_id WHERE rounds > 0 AND c_mktsegment <> 'MACHINERY'""")
def exclusions_applied(spark, sf_dir):
    e = from_star(spark, sf_dir)
    e = type(e)(e.runs, e.profiles.withColumn("configurationHash", F.sha2("harnessFamily", 256)), e.trials, e.rounds, e.tool_calls)
    policy = spark.createDataFrame([(1, "MACHINERY")], "position int, name string").select("position", F.sha2("name", 256).alias("configurationHash"))
    kept, _ = S.exclude(e, policy)
    parts = [getattr(kept, n).agg(F.count("*").alias("n")).select(F.lit(label).alias("kept"), "n") for n, label in (("profiles", "profiles"), ("trials", "trials"), ("rounds", "rounds"), ("tool_calls", "calls"))]
    return FA.union_all(parts)


@query("""SELECT n_name AS "modelFamily", CASE WHEN n_name = 'NATION_3' THEN 'europe-main' WHEN n_name = 'NATION_2' AND provider IS NULL THEN 'asia-main' ELSE provider END AS "provider" FROM (SELECT n_name, n_regionkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE r_name END AS provider FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def provider_alias(spark, sf_dir):
    """P09, with an alias of the null provider."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("n_name").alias("modelFamily"), F.when(F.col("n_regionkey") != 2, F.col("r_name")).alias("provider"))
    aliases = spark.createDataFrame([("NATION_3", "EUROPE", "europe-main"), ("NATION_2", None, "asia-main")], "id string, `from` string, `to` string")
    return identity.canonical_provider(rows, aliases)


@query("""SELECT c_custkey AS "c_custkey", sha256(concat('{"c_mktsegment":"', c_mktsegment, '","c_name":"', c_name, '","c_nationkey":', CAST(c_nationkey AS VARCHAR), ',"none":null}')) AS "hash" FROM customer""")
def config_hash(spark, sf_dir):
    """X01, X03."""
    return read(spark, sf_dir, "customer").select("c_custkey", F.sha2(identity.canonical_json(F.struct("c_mktsegment", "c_name", "c_nationkey", F.lit(None).cast("string").alias("none"))), 256).alias("hash"))


@query("""WITH j AS (SELECT r_name, r_regionkey, n_name, c_mktsegment FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey)
SELECT 'contributor' AS "kind", concat('account-', CAST(r_regionkey AS VARCHAR)) AS "name", count(DISTINCT r_name) AS "runs", count(DISTINCT concat(n_name, c_mktsegment)) AS "configurations" FROM j GROUP BY r_regionkey
UNION ALL SELECT 'harness', c_mktsegment, count(DISTINCT r_name), count(DISTINCT concat(n_name, c_mktsegment)) FROM j GROUP BY c_mktsegment""")
def community(spark, sf_dir):
    e = from_star(spark, sf_dir)
    people, harnesses = S.community(e.runs, e.profiles)
    return people.select(F.lit("contributor").alias("kind"), F.col("accountId").alias("name"), "runs", "configurations").unionByName(harnesses.select(F.lit("harness").alias("kind"), F.col("harnessFamily").alias("name"), "runs", "configurations"))


@query(f"""WITH {TRIALS} SELECT facet AS "facet", array_to_string(list_sort(list(DISTINCT value)), ',') AS "values" FROM (SELECT 'model' AS facet, n_name AS value FROM trials UNION ALL SELECT 'harness', c_mktsegment FROM trials UNION ALL SELECT 'provider', run_id FROM trials UNION ALL SELECT 'reasoning', thinking FROM trials
UNION ALL SELECT 'agent', 'agent' UNION ALL SELECT 'runner', 'runner' UNION ALL SELECT 'benchmark', 'star-orders' UNION ALL SELECT 'benchmarkVersion', concat('star-orders', chr(9), '1') UNION ALL SELECT 'agentVersion', concat('agent', chr(9), '1') UNION ALL SELECT 'harnessVersion', concat(c_mktsegment, chr(9), '1') FROM trials UNION ALL SELECT 'taskFamily', 'Other') GROUP BY facet""")
def facets(spark, sf_dir):
    return FA.facets(from_star(spark, sf_dir)).select("facet", F.array_join("values", ",").alias("values"))


@query("""WITH p AS (SELECT p_partkey, concat(CASE p_size % 6 WHEN 0 THEN 'language-' WHEN 1 THEN 'replace-block-' WHEN 2 THEN 'copy-within-' WHEN 3 THEN 'select-subset-' WHEN 4 THEN 'unique-' ELSE 'x' END, p_name) AS t, p_size % 6 AS k FROM part)
SELECT CASE k WHEN 0 THEN 'Language edits' WHEN 1 THEN 'Block edits' WHEN 2 THEN 'Cross-file edits' WHEN 3 THEN 'Subset edits' WHEN 4 THEN 'Unique match' ELSE 'Other' END AS "broad", CASE k WHEN 0 THEN 'Language variants' WHEN 1 THEN 'Replace block' WHEN 2 THEN 'Copy within file' WHEN 3 THEN 'Select subset' WHEN 4 THEN 'Unique replacement' END AS "narrow", count(*) AS "n" FROM p GROUP BY ALL""")
def task_family(spark, sf_dir):
    prefix = F.element_at(F.array(*map(F.lit, ["language-", "replace-block-", "copy-within-", "select-subset-", "unique-", "x"])), F.col("p_size") % 6 + 1)
    t = read(spark, sf_dir, "part").select(F.concat(prefix, "p_name").alias("t"))
    return t.groupBy(classify.task_family(F.col("t")).alias("broad"), classify.narrow_family(F.col("t"), strict=False).alias("narrow")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT DISTINCT c_mktsegment AS m, concat(n_name, '/', o_orderpriority) AS t, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY c_mktsegment, n_name, o_orderpriority, year(o_orderdate) ) AS f0, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT m, concat(t, '/', CAST(y AS VARCHAR)) AS t, max(f0) = 1 AS f FROM o GROUP BY ALL)
SELECT a.m AS "left", b.m AS "right", count(*) FILTER (a.f AND b.f) AS "shared", count(*) FILTER (a.f AND NOT b.f) AS "onlyLeft", count(*) FILTER (b.f AND NOT a.f) AS "onlyRight", count(*) FILTER (NOT a.f AND NOT b.f) AS "bothPass", round(CASE WHEN count(*) FILTER (a.f OR b.f) = 0 THEN 1 ELSE count(*) FILTER (a.f AND b.f) / count(*) FILTER (a.f OR b.f) END, 9) AS "jaccard" FROM k a JOIN k b ON a.t = b.t GROUP BY a.m, b.m""")
def failure_overlap(spark, sf_dir):
    rows = placed(spark, sf_dir).select(F.col("c_mktsegment").alias("member"), F.concat("n_name", F.lit("/"), "o_orderpriority", F.lit("/"), F.year("o_orderdate").cast("string")).alias("task"), (F.col("o_orderstatus") == "O").alias("bad"))
    return ST.failure_overlap(rows, [], "member", "task", F.col("bad")).select("left", "right", "shared", "onlyLeft", "onlyRight", "bothPass", r("jaccard").alias("jaccard"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


PLACED = "placed AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


@query(f"""WITH {PLACED}, v AS (SELECT c_mktsegment AS m, n_name AS i, count(*) FILTER (o_orderstatus = 'F') AS x FROM placed GROUP BY ALL), k AS (SELECT m, i, rank() OVER (PARTITION BY m ORDER BY x) + (count(*) OVER (PARTITION BY m, x) - 1) / 2 AS r FROM v)
SELECT a.m AS "left", b.m AS "right", round(CASE WHEN stddev_pop(a.r) * stddev_pop(b.r) = 0 THEN NULL ELSE covar_pop(a.r, b.r) / (stddev_pop(a.r) * stddev_pop(b.r)) END, 6) AS "rho", count(*) AS "items" FROM k a JOIN k b ON a.i = b.i GROUP BY a.m, b.m""")
def spearman_pairs(spark, sf_dir):
    v = placed(spark, sf_dir).groupBy(F.col("c_mktsegment").alias("m"), F.col("n_name").alias("i")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("x"))
    return ST.spearman_pairs(v, [], "m", "i", "x").select("left", "right", r("rho", 6).alias("rho"), "items")


@query(f"""WITH {PLACED}, v AS (SELECT c_mktsegment AS a, o_orderpriority AS b, avg(o_totalprice) AS x FROM placed GROUP BY ALL), m AS (SELECT x, avg(x) OVER () AS m, avg(x) OVER (PARTITION BY a) AS ma, avg(x) OVER (PARTITION BY b) AS mb FROM v), s AS (SELECT sum((x - m) * (x - m)) AS t, sum((ma - m) * (ma - m)) AS p, sum((mb - m) * (mb - m)) AS q FROM m)
SELECT round(100 * p / t, 6) AS "firstShare", round(100 * q / t, 6) AS "secondShare", round(100 * (t - p - q) / t, 6) AS "remainder" FROM s""")
def variance_shares(spark, sf_dir):
    v = placed(spark, sf_dir).groupBy("c_mktsegment", "o_orderpriority").agg(F.avg("o_totalprice").alias("x"))
    return ST.variance_shares(v, [], "c_mktsegment", "o_orderpriority", "x").select(*[r(c, 6).alias(c) for c in ("firstShare", "secondShare", "remainder")])


@query("""WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY o_orderpriority)
SELECT g AS "o_orderpriority", round(any_value(a), 4) AS "q1", round(any_value(b), 4) AS "median", round(any_value(c), 4) AS "q3", round(any_value(m), 4) AS "mean", any_value(n) AS "n", round(min(o_totalprice) FILTER (o_totalprice >= a - 1.5e0 * (c - a)), 4) AS "whiskerLow", round(max(o_totalprice) FILTER (o_totalprice <= c + 1.5e0 * (c - a)), 4) AS "whiskerHigh", count(*) FILTER (o_totalprice < a - 1.5e0 * (c - a) OR o_totalprice > c + 1.5e0 * (c - a)) AS "outside" FROM orders JOIN q ON g = o_orderpriority GROUP BY g""")
def box_stats(spark, sf_dir):
    rows = ST.box_stats(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return rows.select("o_orderpriority", *[r(c, 4).alias(c) for c in ("q1", "median", "q3", "mean")], "n", *[r(c, 4).alias(c) for c in ("whiskerLow", "whiskerHigh")], F.size("outliers").cast("long").alias("outside"))


@query(f"""WITH {PLACED}, p AS (SELECT n_name, o_orderpriority, c_mktsegment, bool_or(o_orderstatus = 'P') AS ok FROM placed GROUP BY ALL)
SELECT count(*) FILTER (a.ok AND b.ok) AS "both", count(*) FILTER (a.ok AND NOT b.ok) AS "onlyLeft", count(*) FILTER (b.ok AND NOT a.ok) AS "onlyRight", count(*) FILTER (NOT a.ok AND NOT b.ok) AS "neither" FROM p a JOIN p b ON a.n_name = b.n_name AND a.o_orderpriority = b.o_orderpriority WHERE a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'MACHINERY'""")
def contingency(spark, sf_dir):
    p = placed(spark, sf_dir).groupBy("n_name", "o_orderpriority", "c_mktsegment").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("ok"))
    return S.contingency(p, ["n_name", "o_orderpriority"], "c_mktsegment", "BUILDING", "MACHINERY", "ok")


@query(f"""WITH {PLACED}, p AS (SELECT concat(n_name, '/', o_orderpriority, '/', CAST(year(o_orderdate) AS VARCHAR)) AS t, c_mktsegment AS m, bool_or(o_orderstatus = 'P') AS ok FROM placed GROUP BY ALL)
SELECT a.t AS "task", a.m AS "loser", array_to_string(list_sort(list(DISTINCT b.m)), ',') AS "winners" FROM p a JOIN p b ON a.t = b.t AND a.m <> b.m WHERE NOT a.ok AND b.ok GROUP BY a.t, a.m""")
def peer_losses(spark, sf_dir):
    p = placed(spark, sf_dir).groupBy(F.concat("n_name", F.lit("/"), "o_orderpriority", F.lit("/"), F.year("o_orderdate").cast("string")).alias("t"), F.col("c_mktsegment").alias("m")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("ok"))
    return S.peer_losses(p, "t", "m", "ok", F.lit(True)).select("task", "loser", F.array_join("winners", ",").alias("winners"))


@query("""SELECT conv_id AS "conv_id", count(*) AS "attempts", arg_min(role = 'assistant', turn) AS "firstPassed", arg_max(role = 'assistant', turn) AS "lastPassed", bool_or(role = 'assistant') AS "everPassed", min(turn) FILTER (role = 'assistant') AS "passedAt", CASE WHEN count(text) = count(*) THEN CAST(sum(length(text)) AS BIGINT) END AS "totalSeconds" FROM conversations GROUP BY conv_id""")
def retry_chains(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return S.retry_chains(rows, ["conv_id"], "turn", F.col("role") == "assistant", F.length("text").cast("long"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS pos FROM lineitem)
SELECT 'O02 contiguous' AS "rule", CAST(l_orderkey AS VARCHAR) AS "key", concat('position ', CAST(pos AS VARCHAR), ' has ', CAST(l_linenumber AS VARCHAR)) AS "message" FROM w WHERE pos <> l_linenumber""")
def contiguity_violations(spark, sf_dir):
    return Q.gaps(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", LINE_ORDER[1:])


@query("""SELECT 'V07 reference' AS "rule", CAST(o_orderkey AS VARCHAR) AS "key", 'no parent row' AS "message" FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def fk_violations(spark, sf_dir):
    return Q.orphans(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), {"o_orderkey": "l_orderkey"})


@query("""SELECT 'V09 unique' AS "rule", concat(CAST(l_orderkey AS VARCHAR), '/', CAST(l_linenumber AS VARCHAR)) AS "key", concat(CAST(count(*) AS VARCHAR), ' rows') AS "message" FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def pk_duplicates(spark, sf_dir):
    return Q.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT rule AS "rule", key AS "key", 'check failed' AS "message" FROM (SELECT 'V06 cost' AS rule, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'V04 segment', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE'))""")
def row_checks(spark, sf_dir):
    return Q.row_checks(read(spark, sf_dir, "customer"), F.col("c_custkey"), {"V06 cost": F.col("c_acctbal") >= 0, "V04 segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")})


SENSITIVE_SQL = " OR ".join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for p in classify.SENSITIVE)


@query(f"""SELECT 'V13 sensitive' AS "rule", CAST(doc_id AS VARCHAR) AS "key", 'possible credential or machine-local path' AS "message" FROM documents WHERE {SENSITIVE_SQL}""")
def sensitive_text(spark, sf_dir):
    return Q.sensitive_rows(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


COMMANDS = ["grep -rn x src | head -5", "sed -i s/a/b/ /workspace/a.ts", "cat a > /tmp/b", "cat a >> b.txt", "python3 fix.py; npm test", "xxd a; sha256sum a; diff a b; ls", "rm -rf build", "echo hello"]
FEATURES = {0: ["search", "read"], 1: ["read", "likely-workspace-write"], 2: ["read"], 3: ["read", "likely-workspace-write"], 4: ["script", "test-or-build"], 5: ["byte-check", "checksum", "compare", "list"], 6: ["file-operation", "likely-workspace-write"]}


@query("WITH f(k, feature) AS (VALUES " + ", ".join(f"({k}, '{x}')" for k, xs in FEATURES.items() for x in xs) + ") SELECT feature AS \"feature\", count(*) AS \"n\" FROM part JOIN f ON k = p_size % 8 GROUP BY feature")
def shell_features(spark, sf_dir):
    """Commands by part size; the SQL lists what each command is known to do."""
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), F.col("p_size") % 8 + 1)
    rows = read(spark, sf_dir, "part").select(F.explode(classify.command_features(command)).alias("feature"))
    return rows.groupBy("feature").agg(F.count("*").alias("n"))


@query(r"""WITH d AS (SELECT doc_id, text AS a, CASE doc_id % 4 WHEN 0 THEN concat(text, chr(10)) WHEN 1 THEN replace(text, chr(10), '') WHEN 2 THEN replace(text, ' ', '  ') ELSE concat(text, 'x') END AS b FROM documents)
SELECT doc_id AS "doc_id", regexp_replace(a, '(\r\n|\n)+$', '') = regexp_replace(b, '(\r\n|\n)+$', '') AS "onlyEof", replace(a, chr(10), '') = replace(b, chr(10), '') AS "onlyLineBreaks", translate(a, concat(chr(10), chr(9), ' '), '') = translate(b, concat(chr(10), chr(9), ' '), '') AS "onlyAsciiLayout",
CASE WHEN a = b THEN 'pass' WHEN doc_id % 4 = 0 THEN 'eof' WHEN doc_id % 4 = 1 THEN 'line-breaks' WHEN doc_id % 4 = 2 THEN 'ascii-layout' ELSE 'other-text' END AS "kind" FROM d""")
def text_diff_kind(spark, sf_dir):
    a, k = F.col("text"), F.col("doc_id") % 4
    b = F.when(k == 0, F.concat(a, F.lit("\n"))).when(k == 1, F.replace(a, F.lit("\n"), F.lit(""))).when(k == 2, F.replace(a, F.lit(" "), F.lit("  "))).otherwise(F.concat(a, F.lit("x")))
    d = read(spark, sf_dir, "documents").select("doc_id", a.alias("a"), b.alias("b"))
    flags = {"onlyEof": only_eof(F.col("a"), F.col("b")), "onlyLineBreaks": only_line_breaks(F.col("a"), F.col("b")), "onlyAsciiLayout": only_ascii_layout(F.col("a"), F.col("b"))}
    d = d.withColumns(flags)
    return d.select("doc_id", *flags, classify.difference_kind(F.col("a") == F.col("b"), F.lit(False), F.array(F.struct(*flags))).alias("kind"))


@query("""SELECT user_id AS "user_id", count(*) AS "eventCount", count(*) FILTER (event_type = 'purchase') AS "toolCalls", count(*) FILTER (event_type = 'view') AS "modelRounds", count(*) FILTER (event_type = 'error') AS "errors" FROM events GROUP BY user_id""")
def event_metrics(spark, sf_dir):
    """Events become JSON lines of one dialect and are read back as VARIANT."""
    kind = identity.literal_map({"purchase": "tool_use", "view": "step_finish", "error": "error"}, F.col("event_type"), F.lit("other"))
    lines = read(spark, sf_dir, "events").select("user_id", F.to_json(F.struct(kind.alias("type"), "props")).alias("value"))
    return EV.event_metrics(EV.parse_events(lines), "parts", ["user_id"]).select("user_id", "eventCount", "toolCalls", "modelRounds", "errors")


@query("""SELECT coalesce(d.doc_id % 10, b.item_id % 10) AS "k", count(*) FILTER (d.doc_id IS NOT NULL AND b.item_id IS NOT NULL AND d.text <> b.text) AS "differing", count(*) FILTER (b.item_id IS NULL) AS "unexpected", count(*) FILTER (d.doc_id IS NULL) AS "missing" FROM documents d FULL JOIN (SELECT item_id * 2 AS item_id, text FROM benchmark) b ON d.doc_id = b.item_id GROUP BY ALL""")
def set_compare(spark, sf_dir):
    """U05."""
    side = lambda df, c: df.select((F.col(c) % 10).alias("k"), F.col(c).cast("string").alias("path"), F.col("text").alias("content"))
    items = read(spark, sf_dir, "benchmark").withColumn("item_id", F.col("item_id") * 2)
    rows = Q.compare_files(side(read(spark, sf_dir, "documents"), "doc_id"), side(items, "item_id"), ["k"])
    return rows.select("k", *[F.size(c).cast("long").alias(c) for c in ("differing", "unexpected", "missing")])


@query(SQL["leaderboard_exact"])
def incremental_equals_rebuild(spark, sf_dir):
    """State of two runs, then the others appended, then one appended again; the result is that of a rebuild."""
    e = from_star(spark, sf_dir).copied(stored)  # three states are made of it
    some, rest = ["ASIA", "EUROPE"], ["AFRICA", "AMERICA", "MIDDLE EAST"]
    state = STATE.append_state(STATE.create_state(e.only(some)), STATE.create_state(e.only(rest)))
    again = STATE.append_state(state, STATE.create_state(e.only(["ASIA"])))
    return exact_columns(L.exact_from_cells(STATE.merge_cells(again), C.benchmark_counts(e.runs)))


@query("WITH s(category, scale, suffix) AS (" + " UNION ALL ".join(f"SELECT '{c}', unnest({n}), ''" for c, n in T.SCALES.items()) + " UNION ALL " + " UNION ALL ".join(f"SELECT 'language-{o}', {n}, concat('-', unnest({T.LANGUAGES}))" for o, n in (("replace", 10), ("select", 10), ("insert", 1))) + f" UNION ALL SELECT 'literal', 1, concat('-', unnest({T.LITERALS}))), v AS (SELECT category, scale, suffix, unnest(['plain', 'unicode']) AS variant FROM s UNION ALL SELECT 'unicode-fix', 1, concat('-', unnest({T.LOOKALIKES})), 'unicode') SELECT concat(category, '-', CAST(scale AS VARCHAR), suffix, '-', variant) AS \"taskId\", category AS \"category\", CAST(scale AS INT) AS \"scale\", variant AS \"variant\" FROM v")
def task_matrix(spark, sf_dir):
    return T.task_matrix(spark).select("taskId", "category", "scale", "variant")


@query("""WITH t AS (SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS pos, p_partkey FROM part), h AS (SELECT r_regionkey AS h, r_name, (SELECT count(*) FROM region) AS n FROM region) SELECT CAST(pos * n + CASE WHEN pos % 2 = 1 THEN n - 1 - h ELSE h END AS BIGINT) AS "ordinal", CAST(p_partkey AS VARCHAR) AS "taskId", r_name AS "harness" FROM t, h""")
def run_schedule(spark, sf_dir):
    """J21, O16."""
    low = read(spark, sf_dir, "part").agg(F.min("p_partkey").alias("low"))
    tasks = read(spark, sf_dir, "part").crossJoin(F.broadcast(low)).select((F.col("p_partkey") - F.col("low")).alias("position"), F.col("p_partkey").cast("string").alias("taskId"))
    harnesses = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("position"), F.col("r_name").alias("harness"))
    return T.schedule(tasks, harnesses)


@query(f"""WITH {TRIALS} SELECT profile_id AS "profileId", count(*) AS "trials", count(*) FILTER (rounds > 0) - count(*) FILTER (rounds > 0 AND NOT f0) AS "firstPassed", count(*) FILTER (l0) AS "finalPassed", CAST(sum(greatest(0, rounds - 1)) AS BIGINT) AS "recoveries", CAST(sum(timeouts) AS BIGINT) AS "timeouts", count(*) FILTER (infra) AS "infrastructureFailures", round(avg(dur), 6) AS "meanSeconds"
FROM (SELECT t.*, coalesce(f0, false) AS f0, coalesce(l0, false) AS l0 FROM trials t LEFT JOIN (SELECT l_orderkey AS k, arg_min(l_linestatus = 'F', rn) AS f0, arg_max(l_linestatus = 'F', rn) AS l0 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS rn FROM lineitem) GROUP BY l_orderkey) ON k = o_orderkey) GROUP BY profile_id""")
def profile_scoreboard(spark, sf_dir):
    """Outcomes of rounds from the line status."""
    e = from_star(spark, sf_dir)
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    status = read(spark, sf_dir, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), (F.row_number().over(order) - 1).cast("string")).alias("roundId"), (F.col("l_linestatus") == "F").alias("ok"))
    rounds = e.rounds.join(status, "roundId").withColumn("exactPassed", F.col("ok"))
    return S.scoreboard(S.trial_measures(e.trials, rounds)).select("profileId", "trials", "firstPassed", "finalPassed", "recoveries", "timeouts", "infrastructureFailures", r("meanSeconds", 6).alias("meanSeconds"))


@query(f"""WITH {TRIALS} SELECT 'model' AS "dimension", n_name AS "value", count(*) AS "trials", count(*) FILTER (f) AS "firstPassed" FROM trials GROUP BY n_name UNION ALL SELECT 'harness', c_mktsegment, count(*), count(*) FILTER (f) FROM trials GROUP BY c_mktsegment""")
def margins(spark, sf_dir):
    facts = C.trial_facts(from_star(spark, sf_dir)).select(F.col("modelFamily").alias("model"), F.col("harnessFamily").alias("harness"), "first", "final", F.greatest(F.lit(0), F.col("rounds") - 1).alias("recoveries"), "timeouts")
    return S.margins(facts, "model", "harness").select("dimension", "value", "trials", "firstPassed")


@query(f"""WITH {TRIALS} SELECT CASE grouping(n_name, c_mktsegment) WHEN 3 THEN 'overall' WHEN 1 THEN 'model' WHEN 2 THEN 'harness' ELSE 'model+harness' END AS "scope", n_name AS "model", c_mktsegment AS "harness", count(*) AS "trials", CAST(sum(rounds) AS BIGINT) AS "rounds" FROM trials GROUP BY GROUPING SETS ((), (n_name), (c_mktsegment), (n_name, c_mktsegment))""")
def trajectory_scopes(spark, sf_dir):
    """A45."""
    facts = C.trial_facts(from_star(spark, sf_dir)).select(F.col("modelFamily").alias("model"), F.col("harnessFamily").alias("harness"), "rounds")
    return S.scope_counts(facts, "model", "harness", {"trials": F.count("*"), "rounds": F.sum("rounds")})


@query(f"""WITH {TRIALS}, f AS (SELECT c_mktsegment AS g, n_name AS i, avg(CAST(g AS INT)) AS m, sum(CAST(g AS INT)) AS s, count(*) AS n FROM trials GROUP BY c_mktsegment, n_name) SELECT g AS "harness", round(avg(m), 9) AS "balanced", round(sum(s) / sum(n), 9) AS "pooled", round(100 * (avg(m) - sum(s) / sum(n)), 6) AS "delta" FROM f GROUP BY g""")
def balanced_means(spark, sf_dir):
    """A41, N07."""
    facts = C.trial_facts(from_star(spark, sf_dir)).select(F.col("harnessFamily").alias("harness"), "modelFamily", F.col("final").cast("int").alias("v"))
    return ST.mean_of_means(facts, ["harness"], ["modelFamily"], "v").select("harness", r("balanced").alias("balanced"), r("pooled").alias("pooled"), r("delta", 6).alias("delta"))


@query(f"""WITH {PLACED}, o AS (SELECT concat(o_orderpriority, '/', CAST(year(o_orderdate) AS VARCHAR)) AS t, c_mktsegment AS p, bool_and(o_orderstatus <> 'P') AS ok, bool_or(o_totalprice > 400000) AS late FROM placed GROUP BY ALL), g AS (SELECT t, p FROM (SELECT DISTINCT t FROM o), (SELECT DISTINCT p FROM o)),
k AS (SELECT g.t, g.p, CASE WHEN late THEN 'timeout' WHEN ok = false THEN 'failed' WHEN ok IS NULL THEN 'missing-or-unknown' END AS why FROM g LEFT JOIN o ON o.t = g.t AND o.p = g.p) SELECT t AS "taskId", coalesce(string_agg(concat(p, ': ', why), ',' ORDER BY concat(p, ': ', why)) FILTER (why IS NOT NULL), '') AS "reasons", bool_or(why IS NOT NULL) AS "included" FROM k GROUP BY t""")
def focused_tasks(spark, sf_dir):
    """F12."""
    rows = placed(spark, sf_dir).select(task_id().alias("taskId"), F.col("c_mktsegment").alias("profileId"), (F.col("o_orderstatus") != "P").alias("passed"), (F.col("o_totalprice") > 400000).alias("timedOut"))
    return S.focused_tasks(rows, rows, rows).select("taskId", F.array_join("reasons", ",").alias("reasons"), "included")


@query("""SELECT e.user_id AS "user_id", date_trunc('hour', ts) AS "hour", count(*) AS "n" FROM events e GROUP BY ALL""")
def hourly_counts(spark, sf_dir):
    rows = STATE.windowed_counts(read(spark, sf_dir, "events").select("ts", "user_id"), "ts", ["user_id"])
    return rows.select("user_id", F.col("window.start").alias("hour"), "n")


@query(f"""WITH RECURSIVE s AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS owner, concat('client-', CAST(c_custkey % 40 AS VARCHAR)) AS client, concat('run-', CAST(c_custkey % 50 AS VARCHAR)) AS run,
    sha256(concat(c_mktsegment, CAST(c_custkey % 30 AS VARCHAR))) AS h, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id FROM customer),
queue AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM s), {SERVED} SELECT outcome AS "outcome", count(*) AS "n" FROM served WHERE i > 0 GROUP BY outcome""")
def ingestion_outcomes(spark, sf_dir):
    """T01 on one batch and an empty index."""
    c = read(spark, sf_dir, "customer")
    n = lambda m: (F.col("c_custkey") % m).cast("string")
    batch = c.select(F.col("c_nationkey").cast("string").alias("ownerId"), F.concat(F.lit("client-"), n(40)).alias("clientRunId"), F.concat(F.lit("run-"), n(50)).alias("runId"), F.sha2(F.concat("c_mktsegment", n(30)), 256).alias("contentHash"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("submissionId"))
    return STATE.ingest(spark.createDataFrame([], STATE.INDEX), batch).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH {TRIALS}, c AS (SELECT t.run_id, t.profile_id, e.event_type AS k, count(*) AS n FROM events e JOIN trials t ON t.o_orderkey = e.event_id AND t.rounds > 0 GROUP BY ALL), h AS (SELECT run_id, profile_id, string_agg(concat(k, '=', CAST(n AS VARCHAR)), ',' ORDER BY k) AS cats FROM c GROUP BY ALL),
m AS (SELECT run_id, profile_id, count(*) AS trials, CAST(sum(greatest(0, rounds - 1)) AS BIGINT) AS recoveries, CAST(sum(timeouts) AS BIGINT) AS timeouts FROM trials GROUP BY ALL)
SELECT m.run_id AS "runId", m.profile_id AS "profileId", m.trials AS "trials", m.recoveries AS "recoveries", m.timeouts AS "timeouts", h.cats AS "categories" FROM m LEFT JOIN h ON h.run_id = m.run_id AND h.profile_id = m.profile_id""")
def normalized_report(spark, sf_dir):
    e = from_star(spark, sf_dir)
    e = type(e)(e.runs, e.profiles, e.trials, e.rounds, e.tool_calls.withColumn("category", F.col("tool")))
    rows = S.normalized_report(e)
    text = F.array_join(F.transform(F.map_entries("categories"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return rows.select("runId", "profileId", "trials", "recoveries", "timeouts", text.alias("categories"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, ts, event_id, event_type FROM events), w AS (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, d ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT concat(CAST(user_id AS VARCHAR), '/', CAST(d AS VARCHAR)) AS "k", bool_or(coalesce(before, 0) = 1 AND event_type = 'view') AS "reopened" FROM w GROUP BY ALL""")
def reopened_sequences(spark, sf_dir):
    """A view after an error."""
    status = identity.literal_map({"error": "closed", "view": "open"}, F.col("event_type"), F.lit("other"))
    rows = read(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.to_date("ts").cast("string")).alias("k"), F.struct("ts", "event_id").alias("seq"), status.alias("status"))
    return S.reopened(rows, "k", "seq", "status")


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT 'V20 aligned' AS "rule", CAST(coalesce(a.k, b.k) AS VARCHAR) AS "key", CASE WHEN a.k IS NULL THEN 'only right' WHEN b.k IS NULL THEN 'only left' ELSE 'differs' END AS "message" FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""")
def aligned_sets(spark, sf_dir):
    """J19, J22, V19, V20."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    right = o.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return Q.misaligned(o.where("k % 3 <> 0"), right, ["k"], ["v"])


@query("""WITH t AS (SELECT event_type AS label, user_id FROM events WHERE event_type <> 'view' UNION ALL SELECT 'any', user_id FROM events) SELECT label AS "label", count(*) AS "calls", count(DISTINCT user_id) AS "chains" FROM t GROUP BY label""")
def label_counts(spark, sf_dir):
    """Overlapping labels of events, with distinct chains."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.array_compact(F.array(F.lit("any"), F.when(F.col("event_type") != "view", F.col("event_type")))).alias("labels"))
    return S.label_counts(rows, "labels", "chain", [])


@query(f"""WITH {TRIALS}, {EXACT} SELECT c_mktsegment AS "harnessFamily", '1' AS "harnessVersion", round(quantile_cont(score, 0.5) FILTER (complete), 9) AS "score", count(*) AS "configurationCount" FROM exact GROUP BY c_mktsegment""")
def latest_harness(spark, sf_dir):
    """A25."""
    return FA.latest_harness_groups(exact(spark, sf_dir)).select("harnessFamily", "harnessVersion", r("score").alias("score"), "configurationCount")


@query("""SELECT l_returnflag AS "flag", count(*) AS "rounds", CAST(sum(CASE WHEN l_tax < 0.08e0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS "tokens" FROM lineitem GROUP BY l_returnflag""")
def usage_with_zeros(spark, sf_dir):
    """Missing values count as 0 here."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_tax") < 0.08, F.col("l_quantity").cast("long")).alias("tokens"))
    return rows.groupBy("flag").agg(F.count("*").alias("rounds"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))
