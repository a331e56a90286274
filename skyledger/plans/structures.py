"""Registered queries of files and sets: ordered digests, bitmaps, archives and layouts, over the star schema."""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
from pyspark.sql import functions as F

from skyledger.evidence import from_star
from skyledger.operators import drafts as D
from skyledger.operators import stats as ST
from skyledger.operators import summary as S
from skyledger.operators.layout import layout_violations
from skyledger.plans.queries import SQL, placed, query, r, read
from skyledger.sources import archives as A
from skyledger.sources.writers import markdown, ordered_digest, stored

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "quantity", "l_returnflag"]


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f FROM lineitem),
t AS (SELECT count(*) AS n, string_agg(concat('{"l_orderkey":', l_orderkey, ',"l_linenumber":', l_linenumber, ',"l_partkey":', l_partkey, ',"quantity":', q, ',"l_returnflag":"', f, '"}', chr(10)), '' ORDER BY l_orderkey, l_linenumber, l_partkey, q, f) AS whole FROM l)
SELECT n AS "rows", CAST(strlen(whole) AS BIGINT) AS "bytes", sha256(whole) AS "sha256" FROM t""")
def line_item_file(spark, sf_dir):
    """Rows, bytes and digest of all line items as one ordered file."""
    lines = read(spark, sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("long")).select(*LINE)
    return ordered_digest(lines, LINE)


@query(f"""WITH pairs AS ({SQL['failure_overlap']}),
own AS (SELECT m, count(*) AS n FROM (SELECT DISTINCT c_mktsegment AS m, concat(n_name, '/', o_orderpriority, '/', CAST(year(o_orderdate) AS VARCHAR)) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O') GROUP BY m)
SELECT p.*, p."shared" + p."onlyLeft" + p."onlyRight" AS "either", coalesce(a.n, 0) = p."shared" AND coalesce(b.n, 0) = p."shared" AS "equal" FROM pairs p LEFT JOIN own a ON a.m = p."left" LEFT JOIN own b ON b.m = p."right" """)
def failure_bitmaps(spark, sf_dir):
    """failure_overlap by bitmaps of tasks, and which members failed the same."""
    rows = placed(spark, sf_dir).select(F.col("c_mktsegment").alias("member"), F.concat("n_name", F.lit("/"), "o_orderpriority", F.lit("/"), F.year("o_orderdate").cast("string")).alias("task"), (F.col("o_orderstatus") == "O").alias("bad"))
    return ST.bitmap_overlap(rows, [], "member", "task", F.col("bad")).withColumn("jaccard", r("jaccard"))


@query("""WITH failed AS (SELECT n_regionkey AS g, o_custkey AS m, o_orderpriority AS t, bool_or(o_orderstatus = 'F') AS f FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
sets AS (SELECT g, m, coalesce(string_agg(t, ',' ORDER BY t) FILTER (f), '') AS s FROM failed GROUP BY g, m)
SELECT g AS "region", count(*) AS "members", min(m) AS "first" FROM sets GROUP BY g, s""")
def equal_failure_sets(spark, sf_dir):
    """Customers that failed in the same priorities, by the digests of their sets; no pair of customers meets."""
    rows = placed(spark, sf_dir).select(F.col("n_regionkey").alias("region"), F.col("o_custkey").alias("m"), F.col("o_orderpriority").alias("t"), (F.col("o_orderstatus") == "F").alias("bad"))
    digests = ST.set_digests(ST.failed_sets(rows, ["region"], "m", "t", F.col("bad")), ["region"])
    return digests.groupBy("region", "digest").agg(F.count("*").alias("members"), F.min("member").alias("first")).drop("digest")


#: Limits of the query's archives: rows of a .jsonl entry, bytes of an entry. An archive holds so many customer keys.
ROWS, BYTES, KEYS = 56, 2500, 60
CUSTOMERS = "manifest.json", "customers/rows.jsonl"


@query(f"""WITH c AS (SELECT c_custkey // {KEYS} AS k, c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN '' ELSE concat('{{"c_custkey":', c_custkey, ',"c_mktsegment":"', c_mktsegment, '"}}') END AS line FROM customer),
n AS (
  SELECT k, count(*) FILTER (line <> '') AS rows, count(*) FILTER (c_acctbal > 9900) AS rich, sum(strlen(line) + 1) AS bytes, CAST(sum(c_custkey) FILTER (line <> '') AS BIGINT) AS keys FROM c GROUP BY k),
judged AS (
  SELECT *, CASE WHEN bytes > {BYTES} THEN 'entry too large: customers/rows.jsonl' WHEN rows > {ROWS} THEN 'row limit exceeded: customers/rows.jsonl' WHEN rich > 0 THEN 'unexpected entry: customers/rich.txt' END AS message FROM n)
SELECT k AS "block", CASE WHEN bytes > {BYTES} OR rows > {ROWS} THEN 'invalid-archive' WHEN rich > 0 THEN 'invalid-layout' END AS "code", message AS "message",
  CASE WHEN message IS NULL THEN rows ELSE 0 END AS "rows", CASE WHEN message IS NULL THEN keys END AS "keys" FROM judged""")
def archived_customers(spark, sf_dir):
    """An archive per block of customers, read back. Customers in debt have an empty line, which is no row. Too many
    rows, too large entries and an entry that names the rich are refused."""
    rows = read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / KEYS).alias("block"), "c_custkey", "c_mktsegment", "c_acctbal")

    def packed(group: pa.Table) -> pa.Table:
        found = group.sort_by("c_custkey").to_pylist()
        body = "".join("\n" if x["c_acctbal"] < 0 else f'{{"c_custkey":{x["c_custkey"]},"c_mktsegment":"{x["c_mktsegment"]}"}}\n' for x in found)
        files = [(CUSTOMERS[0], "{}"), (CUSTOMERS[1], body)] + [("customers/rich.txt", "some")] * any(x["c_acctbal"] > 9900 for x in found)
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
            for name, text in files:
                info = tarfile.TarInfo(name)
                info.size = len(text)
                tar.addfile(info, io.BytesIO(text.encode()))
        return pa.table({"path": [str(group["block"][0].as_py())], "content": pa.array([buffer.getvalue()], pa.binary())})

    archives = stored(rows.groupBy("block").applyInArrow(packed, "path string, content binary"))
    got = stored(A.unpack(archives, CUSTOMERS, A.Limits(entry=BYTES, rows=ROWS)))
    back = A.json_entries(got, CUSTOMERS[1], "c_custkey long, c_mktsegment string").groupBy("path").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))
    outcome = got.select("path", "code", "message").distinct()
    return outcome.join(back, "path", "left").select(F.col("path").cast("long").alias("block"), "code", "message", F.coalesce("n", F.lit(0)).alias("rows"), "keys")


ALLOWED = ("manifest.json", "trials/*/result.json", "trials/*/rounds/*/calls.json", "trials/*/5-LOW")


@query("""WITH f AS (SELECT concat('run-', CAST(c_nationkey AS VARCHAR)) AS root,
    concat('trials/', CAST(o_orderkey AS VARCHAR), '/', CASE o_orderstatus WHEN 'F' THEN 'result.json' WHEN 'P' THEN concat('rounds/', CAST(year(o_orderdate) AS VARCHAR), '/', CASE WHEN o_totalprice > 250000 THEN 'calls.json' ELSE 'notes.md' END) ELSE o_orderpriority END) AS path
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT concat('run-', CAST(n_nationkey AS VARCHAR)), CASE WHEN n_regionkey > 1 THEN 'manifest.json' ELSE 'Manifest.json' END FROM nation)
SELECT 'unexpected' AS "rule", root AS "root", path AS "path" FROM (SELECT DISTINCT root, path FROM f) WHERE NOT regexp_full_match(path, 'manifest[.]json|trials/[^/]+/(result[.]json|rounds/[^/]+/calls[.]json|5-LOW)')
UNION ALL SELECT 'missing', root, 'manifest.json' FROM f GROUP BY root HAVING count(*) FILTER (path = 'manifest.json') = 0""")
def layout_of_runs(spark, sf_dir):
    """Listings of runs, made of orders, against a layout with wildcards and a required file."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = lambda c: c.cast("string")
    called = F.when(F.col("o_totalprice") > 250000, "calls.json").otherwise("notes.md")
    name = F.when(F.col("o_orderstatus") == "F", "result.json").when(F.col("o_orderstatus") == "P", F.concat(F.lit("rounds/"), text(F.year("o_orderdate")), F.lit("/"), called)).otherwise(F.col("o_orderpriority"))
    trials = o.select(F.concat(F.lit("run-"), text(F.col("c_nationkey"))).alias("root"), F.concat(F.lit("trials/"), text(F.col("o_orderkey")), F.lit("/"), name).alias("path"))
    manifests = read(spark, sf_dir, "nation").select(F.concat(F.lit("run-"), text(F.col("n_nationkey"))).alias("root"), F.when(F.col("n_regionkey") > 1, "manifest.json").otherwise("Manifest.json").alias("path"))
    return layout_violations(trials.unionAll(manifests), ALLOWED, ("manifest.json",))


#: SQL: a draft of each part: its category by size, blocks by size, variant by brand, value by name.
DRAFTS = """
p AS (
  SELECT p_partkey AS k, (ARRAY['replace-all', 'unique', 'delete-block', 'insert-block', 'move-block', 'copy-block', 'move-between', 'unicode-fix'])[p_size % 8 + 1] AS c, p_size + 2 AS n,
    CASE WHEN p_brand < 'Brand#2' THEN 'unicode' ELSE 'plain' END AS v, p_name AS x FROM part),
q AS (SELECT *, translate(x, ' -ac', chr(160) || chr(8209) || chr(1072) || chr(1089)) AS y, CAST(k * 7919 % n AS INTEGER) + 1 AS a, CAST(k * 104729 % (n - 1) AS INTEGER) + 1 AS b FROM p),
o AS (
  SELECT *, CASE WHEN c = 'unicode-fix' THEN y WHEN v = 'unicode' THEN y || '-old' ELSE x || '-old' END AS old, CASE WHEN c = 'unicode-fix' THEN x WHEN v = 'unicode' THEN y || '-new' ELSE x || '-new' END AS new FROM q),
i AS (
  SELECT *, list_transform(range(1, n + 1), lambda i: concat('[item ', i, ']', chr(10), 'name = ', CASE WHEN c IN ('unique', 'unicode-fix') AND i <> a THEN new ELSE old END, chr(10), 'size = ', i % 7, chr(10), chr(10))) AS before,
    concat('[item ', n + 1, ']', chr(10), 'name = ', CASE c WHEN 'insert-block' THEN new ELSE old END, chr(10), 'size = ', (n + 1) % 7, chr(10), chr(10)) AS extra FROM o),
m AS (SELECT *, list_concat(before[1:a - 1], before[a + 1:]) AS less FROM i),
e AS (
  SELECT *, CASE WHEN c IN ('replace-all', 'unique', 'unicode-fix') THEN list_transform(before, lambda t: replace(t, old, new)) WHEN c IN ('delete-block', 'move-between') THEN less WHEN c = 'insert-block' THEN list_concat(before[1:b - 1], [extra], before[b:])
    WHEN c = 'move-block' THEN list_concat(less[1:b - 1], [before[a]], less[b:]) ELSE list_append(before, before[a]) END AS after FROM m),
t AS (
  SELECT k, concat(c, '-', n, '-', v) AS task, array_to_string(before, '') AS was, array_to_string(after, '') AS now, CASE c WHEN 'move-between' THEN extra END AS other, CASE c WHEN 'move-between' THEN extra || before[a] END AS moved FROM e)"""


def part_drafts(spark, sf_dir):
    p, size = read(spark, sf_dir, "part"), F.col("p_size")
    category = F.element_at(F.array(*map(F.lit, D.CATEGORIES)), size % 8 + 1)
    variant = F.when(F.col("p_brand") < "Brand#2", "unicode").otherwise("plain")
    return p.select(F.col("p_partkey").alias("key"), category.alias("category"), (size + 2).alias("scale"), variant.alias("variant"), F.col("p_name").alias("value"))


@query(f"""WITH {DRAFTS}, j AS (SELECT k, task, was, now, other, moved, concat('{{"id":"', task, '","input":{{"main.txt":', to_json(was), CASE WHEN other IS NULL THEN '' ELSE concat(',"other.txt":', to_json(other)) END, ',"untouched.txt":"Nothing here is to be edited.\\n"}},"expected":{{"main.txt":', to_json(now),
CASE WHEN moved IS NULL THEN '' ELSE concat(',"other.txt":', to_json(moved)) END, ',"untouched.txt":"Nothing here is to be edited.\\n"}}}}') AS draft FROM t)
SELECT k AS "key", task AS "taskId", CAST(length(was) AS BIGINT) AS "inputChars", sha256(now) AS "expectedSha256", sha256(draft) AS "fixtureSha256" FROM j""")
def task_drafts(spark, sf_dir):
    """A draft of an edit task for each part, with the hash of its fixture."""
    d = D.drafts(part_drafts(spark, sf_dir))
    return d.select("key", "taskId", F.length(F.element_at("input", D.MAIN)).cast("long").alias("inputChars"), F.sha2(F.element_at("expected", D.MAIN), 256).alias("expectedSha256"), "fixtureSha256")


@query(f"""WITH {DRAFTS} SELECT 'unchanged' AS "rule", k AS "key" FROM t WHERE was = now AND moved IS NOT DISTINCT FROM other""")
def draft_violations(spark, sf_dir):
    """Drafts that their inverse doesn't undo (none), or that change nothing."""
    return D.draft_violations(part_drafts(spark, sf_dir))


@query(f"""WITH u AS ({SQL['tool_usage']}) SELECT "modelFamily", "harnessFamily", "trials", CAST(sum("calls") AS BIGINT) AS "calls", coalesce(string_agg("tool", ',' ORDER BY "calls" DESC, "tool"), '') AS "tools" FROM u GROUP BY ALL""")
def tools_in_order(spark, sf_dir):
    """Each group's tools, most used first, ties by name."""
    rows = S.tool_lists(S.tool_usage(from_star(spark, sf_dir)))
    return rows.select("modelFamily", "harnessFamily", "trials", "calls", F.array_join(F.transform("tools", lambda t: t["tool"]), ",").alias("tools"))


@query("""WITH t AS (SELECT r_name AS n, count(c_custkey) AS c, count(c_custkey) FILTER (c_acctbal < 0) AS d FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name)
SELECT concat('| region | customers | inDebt |', chr(10), '| --- | --- | --- |', chr(10), string_agg(concat('| ', n, ' | ', c, ' | ', d, ' |', chr(10)), '' ORDER BY n)) AS "document" FROM t""")
def regions_as_markdown(spark, sf_dir):
    """A table of five regions."""
    customers = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = read(spark, sf_dir, "region").join(customers, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy(F.col("r_name").alias("region"))
    counted = rows.agg(F.count("c_custkey").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("inDebt"))
    return spark.createDataFrame([(markdown(counted.orderBy("region")),)], "document string")
