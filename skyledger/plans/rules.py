"""Registered queries of constraints whose input is made of the tables' own values, and whose SQL states the rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.evidence import from_star
from skyledger.operators import quality as Q
from skyledger.plans.queries import TRIALS, query, read


@query("""WITH j AS (SELECT CASE WHEN c_acctbal < 0 THEN concat('{"id":', c_custkey, ',') ELSE concat('{"id":', c_custkey, ',"', lower(c_mktsegment), '":', c_nationkey, CASE WHEN c_nationkey > 12 THEN concat(',"note":"', c_name, '"') ELSE '' END, '}') END AS line FROM customer),
k AS (SELECT line, CASE WHEN json_valid(line) THEN json_keys(line) END AS keys FROM j)
SELECT 'V01 exact keys' AS "rule", substr(line, 1, 80) AS "key", coalesce(array_to_string(keys, ','), 'not a JSON object') AS "message" FROM k
WHERE keys IS NULL OR NOT list_contains(keys, 'id') OR NOT list_contains(keys, 'building') OR len(list_filter(keys, lambda x: x NOT IN ('id', 'building', 'note'))) > 0""")
def lines_with_other_keys(spark, sf_dir):
    """Lines whose second key is the customer's segment, against id, building and, at will, note."""
    c = read(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    note = F.when(F.col("c_nationkey") > 12, F.concat(F.lit(',"note":"'), "c_name", F.lit('"'))).otherwise("")
    whole = F.concat(F.lit('{"id":'), key, F.lit(',"'), F.lower("c_mktsegment"), F.lit('":'), nation, note, F.lit("}"))
    return Q.exact_keys(c.select(F.when(F.col("c_acctbal") < 0, F.concat(F.lit('{"id":'), key, F.lit(","))).otherwise(whole).alias("value")), ["id", "building"], ["note"])


@query("""WITH l AS (SELECT concat('{"count":', l_linenumber - 2, ',"name":', CASE l_returnflag WHEN 'R' THEN 'null' WHEN 'A' THEN CAST(l_linenumber AS VARCHAR) ELSE concat('"', l_linestatus, '"') END,
  ',"cost":', CASE WHEN l_tax < 0.03 THEN 'null' WHEN l_tax < 0.05 THEN '"free"' ELSE CAST(l_linenumber AS VARCHAR) END, CASE WHEN l_discount > 0.05 THEN ',"done":true' WHEN l_discount > 0.02 THEN ',"done":1' ELSE '' END, '}') AS line FROM lineitem),
t AS (SELECT json_type(line, '$.count') AS a, CAST(json_extract_string(line, '$.count') AS BIGINT) AS n, json_type(line, '$.name') AS b, json_type(line, '$.cost') AS c, json_type(line, '$.done') AS d FROM l),
m AS (SELECT concat_ws('; ', CASE WHEN a NOT IN ('BIGINT', 'UBIGINT') OR n < 0 THEN 'count must be count' END, CASE WHEN b <> 'VARCHAR' THEN 'name must be string' END, CASE WHEN c NOT IN ('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN 'cost must be number?' END, CASE WHEN d IS NULL OR d <> 'BOOLEAN' THEN 'done must be boolean' END) AS message FROM t)
SELECT 'V02 types' AS "rule", message AS "message", count(*) AS "n" FROM m WHERE message <> '' GROUP BY message""")
def fields_of_other_types(spark, sf_dir):
    """Counts below zero, names and costs of other types, and a missing flag."""
    number = F.col("l_linenumber").cast("string")
    name = F.when(F.col("l_returnflag") == "R", "null").when(F.col("l_returnflag") == "A", number).otherwise(F.concat(F.lit('"'), "l_linestatus", F.lit('"')))
    cost = F.when(F.col("l_tax") < 0.03, "null").when(F.col("l_tax") < 0.05, '"free"').otherwise(number)
    done = F.when(F.col("l_discount") > 0.05, ',"done":true').when(F.col("l_discount") > 0.02, ',"done":1').otherwise("")
    line = F.concat(F.lit('{"count":'), (F.col("l_linenumber") - 2).cast("string"), F.lit(',"name":'), name, F.lit(',"cost":'), cost, done, F.lit("}"))
    found = Q.scalar_types(read(spark, sf_dir, "lineitem").select(line.alias("value")), {"count": "count", "name": "string", "cost": "number?", "done": "boolean"})
    return found.groupBy("rule", "message").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), CASE WHEN p_size > 25 THEN [lower(p_type)] ELSE [p_brand] END) AS l FROM part)
SELECT 'V03 labels' AS "rule", CAST(p_partkey AS VARCHAR) AS "key" FROM p WHERE len(list_distinct(l)) <> len(l) OR list_sort(l) <> l OR len(list_filter(l, lambda x: NOT regexp_full_match(x, '[a-zA-Z0-9][a-zA-Z0-9._/-]*'))) > 0""")
def unordered_labels(spark, sf_dir):
    """The words of a part's name with its type or brand (which has a mark that labels may not have)."""
    last = F.when(F.col("p_size") > 25, F.lower("p_type")).otherwise(F.col("p_brand"))
    parts = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.split("p_name", " "), F.array(last)).alias("labels"))
    return Q.list_constraints(parts, F.col("p_partkey"), "labels", Q.LABEL).select("rule", "key")


@query("""SELECT 'V04 kind' AS "rule", coalesce(k, 'null') AS "message", count(*) AS "n" FROM (SELECT nullif(event_type, 'view') AS k FROM events) WHERE k IS NULL OR k NOT IN ('click', 'purchase') GROUP BY k
UNION ALL SELECT 'V04 state', k, count(*) FROM (SELECT nullif(event_type, 'view') AS k FROM events) WHERE k NOT IN ('signup', 'error') GROUP BY k""")
def events_of_other_kinds(spark, sf_dir):
    """Event types as members of two sets, views as nulls: only one of the sets takes them."""
    e = read(spark, sf_dir, "events").select("event_id", *[F.nullif("event_type", F.lit("view")).alias(c) for c in ("kind", "state")])
    both = Q.enum_members(e, F.col("event_id"), "kind", ["click", "purchase"]).unionAll(Q.enum_members(e, F.col("event_id"), "state", ["signup", "error"], True))
    return both.groupBy("rule", "message").agg(F.count("*").alias("n"))


#: A line item as a round: its tokens, calls and flags.
ROUNDS = """r AS (
  SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS a, l_linenumber AS b, CASE WHEN l_tax >= 0.02 THEN l_linenumber * 2 END AS c, CASE WHEN l_tax >= 0.04 THEN l_suppkey END AS d,
    CASE WHEN l_discount < 0.08 THEN CAST(l_quantity AS BIGINT) + l_linenumber * 3 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE l_suppkey END END AS total,
    l_linenumber AS calls, l_partkey % 5 AS failed, l_suppkey % 4 AS invalid, l_returnflag = 'N' AS ok, CASE WHEN l_linestatus = 'O' THEN 'pass' ELSE 'eof' END AS difference, l_returnflag <> 'R' AS fine FROM lineitem),
seen AS (SELECT *, CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER) + CAST(c IS NOT NULL AS INTEGER) + CAST(d IS NOT NULL AS INTEGER) AS s FROM r)"""


@query(f"""WITH {ROUNDS} SELECT rule AS "rule", CAST(l_orderkey AS VARCHAR) AS "key" FROM (
  SELECT 'V05 all or none' AS rule, l_orderkey FROM seen WHERE s NOT IN (0, 4) UNION ALL SELECT 'V05 total', l_orderkey FROM seen WHERE (s = 4) <> (total IS NOT NULL) UNION ALL SELECT 'V05 sum', l_orderkey FROM seen WHERE total <> a + b + c + d
  UNION ALL SELECT 'V06 failed', l_orderkey FROM seen WHERE failed > calls UNION ALL SELECT 'V06 invalid', l_orderkey FROM seen WHERE invalid > failed
  UNION ALL SELECT 'V06 exact', l_orderkey FROM seen WHERE ok <> (difference = 'pass') UNION ALL SELECT 'V06 normalized', l_orderkey FROM seen WHERE fine <> (ok OR difference = 'eof'))""")
def inconsistent_rounds(spark, sf_dir):
    """Line items as rounds, with tokens, calls and flags from their own columns."""
    l, quantity = read(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long")
    total = quantity + F.col("l_linenumber") * 3 + F.when(F.col("l_returnflag") == "R", 1).otherwise(F.col("l_suppkey"))
    rows = l.select(
        "l_orderkey", quantity.alias("inputTokens"), F.col("l_linenumber").alias("outputTokens"), F.when(F.col("l_tax") >= 0.02, F.col("l_linenumber") * 2).alias("cacheReadTokens"), F.when(F.col("l_tax") >= 0.04, F.col("l_suppkey")).alias("cacheWriteTokens"),
        F.when(F.col("l_discount") < 0.08, total).alias("totalTokens"), F.col("l_linenumber").alias("toolCallCount"), (F.col("l_partkey") % 5).alias("failedToolCalls"), (F.col("l_suppkey") % 4).alias("invalidToolCalls"),
        F.col("l_extendedprice").alias("costUsd"), (F.col("l_returnflag") == "N").alias("exactPassed"), F.when(F.col("l_linestatus") == "O", "pass").otherwise("eof").alias("difference"), (F.col("l_returnflag") != "R").alias("normalizedPassed"),
    )
    return Q.row_checks(rows, F.col("l_orderkey"), Q.token_checks()).select("rule", "key")


@query(f"""WITH {TRIALS}, per AS (SELECT run_id, profile_id, count(*) AS n, bool_and(g) AS ok FROM trials WHERE task_id = '1-URGENT/1996' GROUP BY ALL), p AS (SELECT DISTINCT r_name, concat(n_name, '/', c_mktsegment) AS profile FROM cust),
j AS (SELECT concat(r_name, '/', profile) AS k, coalesce(n, 0) AS n, coalesce(ok, false) AS ok FROM p LEFT JOIN per ON run_id = r_name AND profile_id = profile)
SELECT 'V24 one trial' AS "rule", k AS "key" FROM j WHERE n <> 1 UNION ALL SELECT 'V24 passed', k FROM j WHERE NOT ok""")
def smoke_gate_of_profiles(spark, sf_dir):
    """The trials of one task as every profile's smoke trials."""
    e = from_star(spark, sf_dir)
    return Q.smoke_gate(e.trials.where(F.col("taskId") == "1-URGENT/1996"), e.profiles).select("rule", "key")
