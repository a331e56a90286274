"""Which files a folder may and must hold. Patterns are a trie over path segments that listings are walked through.

A listing of any size is walked by one join with the trie per level; only paths still in the trie go on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANY = "*"
#: The layout of a normalized bundle: fixed values.
BUNDLE = ("manifest.json", "profiles.jsonl", "configurations.jsonl", "trials.jsonl", "rounds.jsonl", "tool-calls.jsonl", "submission.json", "report/report.md", "report/results.csv")
BUNDLE_REQUIRED = BUNDLE[:6]


def trie_of(spark: SparkSession, patterns: Sequence[str]) -> tuple[DataFrame, int]:
    """(node, segment, next, ends) of patterns whose segments are names or ``*``; node 0 is the root. And its depth."""
    edges: dict[tuple[int, str], int] = {}
    ends, deepest = set(), 0
    for pattern in patterns:
        node, segments = 0, pattern.split("/")
        for segment in segments:
            node = edges.setdefault((node, segment), len(edges) + 1)
        ends.add(node)
        deepest = max(deepest, len(segments))
    rows = [(node, segment, after, after in ends) for (node, segment), after in edges.items()]
    return spark.createDataFrame(rows, "node int, segment string, next int, ends boolean"), deepest


def layout_violations(files: DataFrame, allowed: Sequence[str] = BUNDLE, required: Sequence[str] = BUNDLE_REQUIRED, *, root: str = "root", path: str = "path") -> DataFrame:
    """(rule, root, path) of files (root, path below it) that no pattern allows (unexpected), and of required files that
    a root lacks (missing; a root is known by any file, also by a null path, which is an empty folder).

    ``*`` stands for one segment, whatever it is; every other segment for itself. A path with an empty, ``.`` or ``..``
    segment is unexpected. Files that repeat count once. A file where a folder is expected is unexpected, as is one
    below a file.
    """
    spark = files.sparkSession
    trie, deepest = trie_of(spark, allowed)
    listed = files.select(F.col(root).alias("root"), F.col(path).alias("path")).distinct()
    paths = listed.where("path is not null")
    segments = F.split("path", "/")
    odd = F.exists(segments, lambda s: s.isin("", ".", ".."))
    at = paths.where(~odd & (F.size(segments) <= deepest)).select("root", "path", segments.alias("s"), F.lit(0).alias("at"))
    fine = None
    for depth in range(deepest):
        here = F.element_at("s", depth + 1)
        open_paths = at.where(F.size("s") > depth)
        edges = trie.withColumnRenamed("segment", "_segment")
        # the patterns are the caller's and few; a name and the wildcard may both lead on
        met = open_paths.join(F.broadcast(edges), (F.col("at") == F.col("node")) & ((F.col("_segment") == here) | (F.col("_segment") == ANY)))
        done = met.where((F.size("s") == depth + 1) & F.col("ends")).select("root", "path")
        fine = done if fine is None else fine.unionAll(done)
        at = met.where(F.size("s") > depth + 1).select("root", "path", "s", F.col("next").alias("at"))
    known = fine.distinct() if fine is not None else paths.limit(0)
    unexpected = paths.join(known.withColumn("_ok", F.lit(True)), ["root", "path"], "left").where("_ok is null").select(F.lit("unexpected").alias("rule"), "root", "path")
    must = spark.createDataFrame([(p,) for p in required], "path string")
    wanted = listed.select("root").distinct().where("root is not null").crossJoin(F.broadcast(must))  # a row per required file, of the caller's
    missing = wanted.join(paths, ["root", "path"], "left_anti").select(F.lit("missing").alias("rule"), "root", "path")
    return unexpected.unionAll(missing)
