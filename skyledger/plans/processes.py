"""Registered queries of processes: ingestion, commits, fingerprints, retries and maintained views, over the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.evidence import LINE_ORDER, from_star
from skyledger.operators.fingerprint import tree_digests
from skyledger.plans.queries import SERVED, TRIALS, query, r, read
from skyledger.sources.commits import CommitConflict, CommitLog
from skyledger.sources.writers import stored, workspace
from skyledger.streaming import arrivals as AR
from skyledger.streaming import ingestion as I
from skyledger.streaming import retries
from skyledger.streaming import state as STATE
from skyledger.streaming import views as V

MAX_LINE = 330

#: Lines of submissions, a customer each: without a closing brace where the balance is negative, without a client in one
#: segment, padded, with the key of the nation's account; regions other than the first have accounts.
LINES = """
raw AS (
  SELECT concat('{"clientRunId":"', CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE concat(c_mktsegment, '-', CAST(c_custkey % 40 AS VARCHAR)) END, '","runId":"run-', CAST(c_custkey % 500 AS VARCHAR),
      '","contentHash":"', sha256(concat(c_mktsegment, CAST(c_custkey % 300 AS VARCHAR))), '","submissionId":"', lpad(CAST(c_custkey AS VARCHAR), 12, '0'), '","keyHash":"', sha256(n_name),
      '","name":"', c_name, repeat('+', c_custkey % 47), '"', CASE WHEN c_acctbal < 0 THEN '' ELSE '}' END) AS line
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
accounts AS (SELECT sha256(n_name) AS k, concat('account-', CAST(n_nationkey AS VARCHAR)) AS owner FROM nation WHERE n_regionkey <> 0),
parsed AS (
  SELECT line, strlen(line) AS bytes, sha256(line) AS sha, json_valid(line) AS ok, CASE WHEN json_valid(line) THEN line ELSE '{}' END AS j FROM raw),
judged AS (
  SELECT line, bytes, sha, json_extract_string(j, '$.clientRunId') AS client, json_extract_string(j, '$.runId') AS run, json_extract_string(j, '$.contentHash') AS h, json_extract_string(j, '$.submissionId') AS id, owner,
    CASE WHEN bytes > 330 THEN 413 WHEN NOT ok THEN 400 WHEN owner IS NULL THEN 401 WHEN json_extract_string(j, '$.clientRunId') = '' THEN 400 END AS status,
    CASE WHEN bytes > 330 THEN 'payload-too-large' WHEN NOT ok THEN 'invalid-json' WHEN owner IS NULL THEN 'unauthorized' WHEN json_extract_string(j, '$.clientRunId') = '' THEN 'invalid-submission' END AS code
  FROM parsed LEFT JOIN accounts ON k = json_extract_string(j, '$.keyHash')),
queue AS (SELECT *, row_number() OVER (ORDER BY id, owner, client, run) AS i FROM judged WHERE status IS NULL),
""" + SERVED


def submission_lines(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    client = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.concat("c_mktsegment", F.lit("-"), text(key % 40)))
    return c.select(F.concat(
        F.lit('{"clientRunId":"'), client, F.lit('","runId":"run-'), text(key % 500), F.lit('","contentHash":"'), F.sha2(F.concat("c_mktsegment", text(key % 300)), 256),
        F.lit('","submissionId":"'), F.lpad(text(key), 12, "0"), F.lit('","keyHash":"'), F.sha2("n_name", 256), F.lit('","name":"'), "c_name",
        F.repeat(F.lit("+"), (key % 47).cast("int")), F.lit('"'), F.when(F.col("c_acctbal") < 0, "").otherwise("}"),
    ).alias("value"))


def ingested(spark, sf_dir) -> CommitLog:
    nations = read(spark, sf_dir, "nation").where("n_regionkey <> 0")
    accounts = nations.select(F.sha2("n_name", 256).alias("keyHash"), F.concat(F.lit("account-"), F.col("n_nationkey").cast("string")).alias("ownerId"))
    log = CommitLog(spark, workspace(spark))
    I.commit_batch(log, submission_lines(spark, sf_dir), "customers", accounts, max_bytes=MAX_LINE)
    return log


@query(f"""WITH RECURSIVE {LINES} SELECT q.owner AS "ownerId", q.client AS "clientRunId", q.run AS "runId", q.h AS "contentHash", s.counted AS "submissionId", CASE s.outcome WHEN 'created' THEN 201 ELSE 200 END AS "status", s.outcome AS "code"
FROM served s JOIN queue q ON q.i = s.i WHERE s.outcome <> 'conflict'""")
def accepted_submissions(spark, sf_dir):
    """What a batch of lines adds to the accepted table of a commit log."""
    return ingested(spark, sf_dir).read("accepted", I.ACCEPTED)


@query(f"""WITH RECURSIVE {LINES} SELECT sha AS "sha256", bytes AS "bytes", status AS "status", code AS "code",
CASE code WHEN 'payload-too-large' THEN 'more than 330 bytes' WHEN 'invalid-json' THEN 'not a JSON object' WHEN 'unauthorized' THEN 'no account has this key' ELSE 'missing: clientRunId' END AS "message" FROM judged WHERE status IS NOT NULL
UNION ALL SELECT q.sha, q.bytes, 400, 'invalid-submission', 'already used for different content' FROM served s JOIN queue q ON q.i = s.i WHERE s.outcome = 'conflict'""")
def refused_submissions(spark, sf_dir):
    """What it adds to the refused table, with status and reason."""
    return ingested(spark, sf_dir).read("refused", I.REFUSED).drop("line")


@query("""WITH c AS (SELECT n_regionkey AS g, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey),
v AS (SELECT k AS "version", c.* FROM c JOIN range(5) t(k) ON c.g <= k UNION ALL SELECT 5, c.* FROM c WHERE g > 1 OR (g = 0 AND c_acctbal > 0))
SELECT "version", "version" - 1 AS "parent", count(*) AS "rows", count(DISTINCT g) AS "groups", round(sum(c_acctbal), 2) AS "total" FROM v GROUP BY "version" """)
def committed_versions(spark, sf_dir):
    """A version for each region's customers; then one region is corrected and another goes, in one step that a
    writer with an older parent is refused and has to make again. Every version is read back as it was."""
    customers = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    rows = customers.select(F.col("n_regionkey").alias("g"), "c_acctbal")
    log = CommitLog(spark, workspace(spark))
    older = log.head()
    for g in range(5):
        older = log.head()
        log.commit(older, f"region {g}", {"customers": {str(g): log.write(rows.where(F.col("g") == g), "customers")}})
    corrected = {"customers": {"0": log.write(rows.where("g = 0 and c_acctbal > 0"), "customers"), "1": None}}
    try:
        log.commit(older, "correction", corrected)
    except CommitConflict:
        log.update("correction", lambda head: corrected)
    read_back = []
    for number in log.numbers():
        version = log.at(number)
        got = log.read("customers", "g int, c_acctbal double", version)
        read_back.append(got.agg(F.count("*").alias("rows"), F.count_distinct("g").alias("groups"), r(F.sum("c_acctbal"), 2).alias("total")).select(F.lit(number).alias("version"), F.lit(version.parent).alias("parent"), "rows", "groups", "total"))
    return reduce(DataFrame.unionAll, read_back)


def merkle(name: str, nodes: str, links: str, below: str) -> str:
    """SQL: digests of nodes (id, own) over those that links (parent, child) name in below (id, digest, height)."""
    return f"""{name}_b AS (SELECT parent AS id, substr(digest, 1, 3) AS b, sha256(string_agg(digest, chr(10) ORDER BY digest)) AS s, max(height) AS h, count(*) AS n FROM (SELECT DISTINCT parent, child FROM {links}) l JOIN {below} ON {below}.id = child GROUP BY parent, b),
{name} AS (SELECT x.id, sha256(concat(x.own, coalesce(string_agg(concat(chr(10), b, ':', s), '' ORDER BY b) FILTER (b IS NOT NULL), ''))) AS digest, coalesce(max(h) + 1, 0) AS height, coalesce(CAST(sum(n) AS BIGINT), 0) AS children FROM ({nodes}) x LEFT JOIN {name}_b ON {name}_b.id = x.id GROUP BY x.id, x.own)"""


def payload(id_sql: str, value: str, table: str) -> str:
    return f"SELECT {id_sql} AS id, sha256(concat('=', CAST({value} AS VARCHAR))) AS own FROM {table}"


@query(f"""WITH parts AS (SELECT id, sha256(own) AS digest, 0 AS height, 0 AS children FROM ({payload("concat('part-', CAST(p_partkey AS VARCHAR))", 'p_brand', 'part')})),
made AS (SELECT concat('order-', CAST(l_orderkey AS VARCHAR)) AS parent, concat('part-', CAST(l_partkey AS VARCHAR)) AS child FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
{merkle('ordered', payload("concat('order-', CAST(o_orderkey AS VARCHAR))", 'o_orderpriority', 'orders'), 'made', 'parts')},
placed AS (SELECT concat('customer-', CAST(o_custkey AS VARCHAR)) AS parent, concat('order-', CAST(o_orderkey AS VARCHAR)) AS child FROM orders JOIN customer ON c_custkey = o_custkey),
{merkle('buying', payload("concat('customer-', CAST(c_custkey AS VARCHAR))", 'c_mktsegment', 'customer'), 'placed', 'ordered')},
living AS (SELECT concat('nation-', CAST(c_nationkey AS VARCHAR)) AS parent, concat('customer-', CAST(c_custkey AS VARCHAR)) AS child FROM customer),
{merkle('national', payload("concat('nation-', CAST(n_nationkey AS VARCHAR))", 'n_name', 'nation'), 'living', 'buying')},
lying AS (SELECT concat('region-', CAST(n_regionkey AS VARCHAR)) AS parent, concat('nation-', CAST(n_nationkey AS VARCHAR)) AS child FROM nation),
{merkle('regional', payload("concat('region-', CAST(r_regionkey AS VARCHAR))", 'r_name', 'region'), 'lying', 'national')}
SELECT id, digest, CAST(height AS BIGINT) AS height, CAST(children AS BIGINT) AS children FROM (FROM parts UNION ALL FROM ordered UNION ALL FROM buying UNION ALL FROM national UNION ALL FROM regional)""")
def tree_fingerprints(spark, sf_dir):
    """Regions depend on nations, these on customers, these on orders, and orders share parts."""
    t = {n: read(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders", "lineitem", "part")}
    named = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
    kinds = [("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_mktsegment"), ("order", "orders", "o_orderkey", "o_orderpriority"), ("part", "part", "p_partkey", "p_brand")]
    nodes = reduce(DataFrame.unionAll, [t[table].select(named(kind, key).alias("id"), F.col(value).alias("payload")) for kind, table, key, value in kinds])
    bought = t["lineitem"].join(t["orders"].select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").join(t["part"].select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    placed = t["orders"].join(t["customer"].select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    links = [
        t["nation"].select(named("region", "n_regionkey").alias("parent"), named("nation", "n_nationkey").alias("child")),
        t["customer"].select(named("nation", "c_nationkey").alias("parent"), named("customer", "c_custkey").alias("child")),
        placed.select(named("customer", "o_custkey").alias("parent"), named("order", "o_orderkey").alias("child")),
        bought.select(named("order", "l_orderkey").alias("parent"), named("part", "l_partkey").alias("child")),
    ]
    return tree_digests(nodes, reduce(DataFrame.unionAll, links))


ATTEMPTS = """tries AS (SELECT concat(CAST(user_id AS VARCHAR), '/', CAST(day(ts) AS VARCHAR)) AS chain, event_type = 'purchase' AS passed, row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS attempt FROM events),
used AS (SELECT *, coalesce(bool_or(passed) OVER (PARTITION BY chain ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM tries WHERE attempt <= 3)"""


@query(f"""WITH {ATTEMPTS} SELECT chain, count(*) AS attempts, arg_min(passed, attempt) AS "firstPassed", arg_max(passed, attempt) AS "lastPassed", bool_or(passed) AS "everPassed", min(attempt) FILTER (passed) AS "passedAt",
count(*) - 1 AS "recoveriesUsed", CASE WHEN bool_or(passed) THEN 'passed' ELSE 'exhausted' END AS outcome FROM used WHERE NOT over GROUP BY chain HAVING bool_or(passed) OR count(*) = 3""")
def retry_decisions(spark, sf_dir):
    """A user's day of events as a chain of attempts with two retries, streamed in micro-batches."""
    day = F.dayofmonth("ts")
    order = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("passed"))
    # a source would not run what comes after a chain's end
    ended = F.coalesce(F.max("passed").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    tries = e.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), day.cast("string")).alias("chain"), F.row_number().over(order).alias("attempt"), "passed", F.col("ts").cast("timestamp").alias("at"), ended.alias("_over"))
    asked = tries.where(~F.col("_over") & (F.col("attempt") <= 3)).drop("_over")
    base = workspace(spark)
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))  # in two batches
    asked.repartitionByRange(files, "at").write.parquet(f"{base}/attempts")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    retries.use_rocks(spark)
    try:
        stream = spark.readStream.schema("chain string, attempt int, passed boolean, at timestamp").option("maxFilesPerTrigger", (files + 1) // 2).parquet(f"{base}/attempts")
        chains = retries.retry_stream(stream, budget=2, idle="3650 days", late="3650 days", together=4096)
        chains.writeStream.format("parquet").option("path", f"{base}/chains").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(retries.CHAIN).parquet(f"{base}/chains")


@query("""WITH l AS (SELECT l_orderkey, l_returnflag <> 'R' AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS n FROM lineitem)
SELECT concat('region-', CAST(n_regionkey AS VARCHAR)) AS "runId", CAST(o_orderkey AS VARCHAR) AS "trialId", count(*) AS "rounds", arg_min(p, n) AS "firstPassed", arg_max(p, n) AS "finalPassed", 'complete' AS "outcome"
FROM l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P' GROUP BY n_regionkey, o_orderkey""")
def arrived_trials(spark, sf_dir):
    """Rounds (line items) arrive in files below a folder per region, the later ones of each trial first. Pending
    orders declare a round more than comes, so they never count."""
    t = {n: read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation")}
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    lines = t["lineitem"].select("l_orderkey", (F.col("l_returnflag") != "R").alias("passed"), (F.row_number().over(order) - 1).alias("round"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))
    owners = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("run"), F.col("o_orderkey").cast("string").alias("trialId"), "round",
        (F.col("n") + (F.col("o_orderstatus") == "P").cast("int")).cast("int").alias("rounds"), "passed",
    )
    base, rows = workspace(spark), stored(rows)
    for wave in (0, 1):  # odd rounds come first; the stream goes on where it ended
        rows.where(F.col("round") % 2 == 1 - wave).write.mode("append").partitionBy("run").json(f"{base}/store")
        trials = AR.complete_trials(AR.arriving_rounds(spark, f"{base}/store"), together=4096)
        trials.writeStream.format("parquet").option("path", f"{base}/trials").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(AR.TRIAL).parquet(f"{base}/trials")


KEPT = "kept AS (SELECT * FROM trials WHERE run_id <> 'AFRICA' AND (run_id <> 'ASIA' OR o_orderkey % 3 > 0))"


@query(f"""WITH {TRIALS}, {KEPT}, n AS (SELECT count(DISTINCT concat(o_orderpriority, '/', CAST(year(o_orderdate) AS VARCHAR))) AS n FROM orders),
tasks AS (SELECT n_name, c_mktsegment, task_id, count(*) AS n, count(*) FILTER (f) AS f, count(*) FILTER (g) AS g FROM kept GROUP BY ALL)
SELECT n_name AS "modelFamily", c_mktsegment AS "harnessFamily", CAST(sum(tasks.n) AS BIGINT) AS "observations", CAST(sum(f) AS BIGINT) AS "firstExactPasses", CAST(sum(g) AS BIGINT) AS "finalExactPasses",
round((0.75 * avg(f / tasks.n) + 0.25 * avg(g / tasks.n)) * count(*) / max(n.n), 9) AS "score" FROM tasks, n GROUP BY n_name, c_mktsegment""")
def maintained_views(spark, sf_dir):
    """The exact view after runs were added, one was corrected and one removed, group by group."""
    e = from_star(spark, sf_dir)
    e = e.with_rounds(stored(e.rounds))  # usage, calls and digests all stand on them
    state, counts = STATE.create_state(e), stored(V.run_counts(e.runs))
    kept = V.MaintainedViews(CommitLog(spark, workspace(spark)), state.schema, views={"exact": V.exact_view})
    kept.apply("all runs", state, counts)
    corrected = kept.state(slots=["ASIA"]).where(F.col("trialId").cast("long") % 3 > 0)
    kept.apply("correction", corrected, counts.where(F.col("runId") == "ASIA"))
    kept.apply("removal", remove=["AFRICA"])
    return kept.view("exact").select("modelFamily", "harnessFamily", "observations", "firstExactPasses", "finalExactPasses", r("score").alias("score"))


@query(f"""WITH {TRIALS}, rows AS (SELECT n_name, c_mktsegment, count(*) AS trials, count(*) FILTER (f) AS f, count(*) FILTER (g) AS g, count(DISTINCT run_id) AS runs FROM trials GROUP BY ALL)
SELECT concat('{{"schemaVersion":1,"totals":[', string_agg(concat('{{"modelFamily":"', n_name, '","harnessFamily":"', c_mktsegment, '","trials":', trials, ',"firstPasses":', f, ',"finalPasses":', g, ',"runs":', runs, '}}'), ',' ORDER BY n_name, c_mktsegment), ']}}') AS "document" FROM rows""")
def views_json(spark, sf_dir):
    """Views.json of the totals."""
    state = STATE.create_state(from_star(spark, sf_dir))
    return V.views_document({"totals": V.totals_view(state, state)}, {"totals": ["modelFamily", "harnessFamily"]})


@query("""WITH used AS (SELECT DISTINCT n_regionkey AS g, n_name, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey),
people AS (SELECT concat('account-', CAST(r_regionkey AS VARCHAR)) AS account, (SELECT count(DISTINCT n_name) FROM used WHERE g = r_regionkey) AS models, (SELECT count(DISTINCT c_mktsegment) FROM used WHERE g = r_regionkey) AS harnesses FROM region),
kinds AS (SELECT c_mktsegment AS harness, count(DISTINCT g) AS n FROM used GROUP BY ALL)
SELECT concat('{"schemaVersion":1,"contributors":', (SELECT concat('[', string_agg(concat('{"account":"', account, '","runs":1,"models":', models, ',"harnesses":', harnesses, '}'), ',' ORDER BY account), ']') FROM people),
',"harnesses":', (SELECT concat('[', string_agg(concat('{"harness":"', harness, '","contributors":', n, ',"runs":', n, '}'), ',' ORDER BY harness), ']') FROM kinds), '}') AS "document" """)
def community_json(spark, sf_dir):
    """Community.json."""
    e = from_star(spark, sf_dir)
    return V.community_document(e.runs, e.profiles)
