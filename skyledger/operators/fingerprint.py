"""Fingerprints of dependency graphs. A node's digest covers its own payload and the digests of all it depends on.

The graph is digested from its leaves upwards, a join per level. A node that many others share is digested once, and
every edge is joined once and then left out: a level reads only the edges and digests that no level below it has used. The children of a node are summed up in up to 4,096 buckets by the beginning of their
digests, so that no list holds all children of a node that a large part of the graph hangs from.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.sources.writers import stored

BUCKET = 3  # hex digits


def tree_digests(nodes: DataFrame, edges: DataFrame, *, id_col: str = "id", payload: Sequence[str] = ("payload",), parent: str = "parent", child: str = "child") -> DataFrame:
    """(id, digest, height, children) of every node; height is 0 for leaves, else one more than the highest child's.

    nodes: id and the payload columns (null and text are told apart); edges: parent depends on child. Edges that repeat
    count once; rows with a null id, parent or child are not looked at; other columns are ignored. Ids that repeat,
    edges to unknown nodes and cycles (also a node that depends on itself) are errors that name up to five ids.
    An empty table gives no rows.

    digest = sha256 of lines: sha256(payload), then for each bucket, in order, its hex digits, a colon and the sha256 of
    the sorted child digests in it, joined by line feeds. payload is the columns, each as its text after "=", or "-".
    """
    text = F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in payload])
    own = nodes.select(F.col(id_col).cast("string").alias("id"), F.sha2(text, 256).alias("own")).where("id is not null")
    own = stored(own)
    twice = [r.id for r in own.groupBy("id").count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"ids that repeat: {twice}")
    links = stored(edges.select(F.col(parent).cast("string").alias("parent"), F.col(child).cast("string").alias("child")).where("parent is not null and child is not null").distinct())
    ends = links.select(F.col("parent").alias("id")).unionAll(links.select(F.col("child").alias("id")))
    unknown = [r.id for r in ends.join(own, "id", "left_anti").distinct().limit(5).collect()]
    if unknown:
        raise ValueError(f"edges to unknown nodes: {unknown}")

    counts = links.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    waiting = stored(own.join(counts, "id"))
    waiting = waiting.withColumn("left", F.col("children"))
    fresh = stored(own.join(counts, "id", "left_anti").select("id", F.sha2("own", 256).alias("digest"), F.lit(0).cast("long").alias("height"), F.lit(0).cast("long").alias("children")))
    done, arrived, height = [fresh], None, 0
    while not fresh.isEmpty():
        height += 1
        reached = stored(links.join(fresh.select(F.col("id").alias("child"), "digest"), "child", "left"))
        links, met = reached.where("digest is null").select("parent", "child"), reached.where("digest is not null").select("parent", "digest")
        arrived = met if arrived is None else arrived.unionAll(met)
        came = met.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("came"))
        waiting = stored(waiting.join(came, "id", "left").withColumn("left", F.col("left") - F.coalesce("came", F.lit(0))).drop("came"))
        ready = waiting.where(F.col("left") == 0)
        known = arrived.join(ready.select(F.col("id").alias("parent")), "parent", "left_semi")
        bucket = F.substring("digest", 1, BUCKET).alias("bucket")
        inner = known.groupBy("parent", bucket).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), "\n"), 256).alias("sum"))
        lines = inner.groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.concat("bucket", F.lit(":"), "sum"))).alias("lines"))
        whole = F.sha2(F.concat_ws("\n", "own", F.array_join("lines", "\n")), 256)
        fresh = stored(ready.join(lines, "id").select("id", whole.alias("digest"), F.lit(height).cast("long").alias("height"), "children"))
        done.append(fresh)
        waiting = waiting.where(F.col("left") > 0)
        arrived = stored(arrived.join(waiting.select(F.col("id").alias("parent")), "parent", "left_semi"))
    stuck = [r.id for r in waiting.select("id").limit(5).collect()]
    if stuck:
        raise ValueError(f"on a cycle, or above one: {stuck}")
    return reduce(DataFrame.unionAll, done)


#: Fixed value: an exact version, as installed packages must have.
EXACT_VERSION = r"^\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$"


def installed_violations(installed: DataFrame, plan: DataFrame, origin: str) -> DataFrame:
    """(rule, location): packages that may not be part of a fingerprint, and planned ones that are not installed.

    installed: location, version, resolved, integrity, link. plan: name, version, integrity. A package may not be a
    link, must come from the host origin over http or https if it says where it is from, and have an exact version. A
    planned package must be installed below node_modules with the version and integrity of the plan.
    """
    host = F.try_parse_url(F.col("resolved"), F.lit("HOST"))
    rules = {
        "link": F.coalesce(F.col("link"), F.lit(False)),
        "origin": F.col("resolved").isNotNull() & ~F.coalesce((host == origin) & F.col("resolved").rlike("^https?://"), F.lit(False)),
        "version": ~F.coalesce(F.col("version").rlike(EXACT_VERSION), F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    odd = installed.where(F.col("location") != "").select(F.explode(broken).alias("rule"), "location")
    wanted = plan.select(F.concat(F.lit("node_modules/"), "name").alias("location"), F.col("version").alias("_v"), F.col("integrity").alias("_i"))
    same = F.col("_v").eqNullSafe(F.col("version")) & F.col("_i").eqNullSafe(F.col("integrity"))
    have = installed.select("location", "version", "integrity", F.lit(True).alias("_there"))
    missing = wanted.join(have, "location", "left").where(F.col("_there").isNull() | ~same).select(F.lit("plan").alias("rule"), "location")
    return odd.unionAll(missing)
