"""Statistics: ranks, rank correlation, overlaps of failures, box statistics, variance shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.evidence import finite
from skyledger.sources.writers import stored


def average_rank(value: str, group: Sequence[str]) -> Column:
    """Rank within the group; ties share the mean of their ranks."""
    order, ties = Window.partitionBy(*group).orderBy(value), Window.partitionBy(*group, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r; null for a constant side. Never divides by zero."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman_pairs(rows: DataFrame, group: Sequence[str], member: str, item: str, value: str) -> DataFrame:
    """Rank correlation of every ordered pair of members of a group, over the items both have."""
    ranked = rows.withColumn("r", average_rank(value, [*group, member])).select(*group, item, member, "r")
    one, two = (ranked.withColumnsRenamed({member: m, "r": r}) for m, r in (("left", "a"), ("right", "b")))
    return one.join(two, [*group, item]).groupBy(*group, "left", "right").agg(correlation(F.col("a"), F.col("b")).alias("rho"), F.count("*").alias("items"))


def failure_overlap(rows: DataFrame, group: Sequence[str], member: str, task: str, failed: Column) -> DataFrame:
    """Per ordered pair of members: failures of both, of one only, of either, passes of both, and Jaccard (1 for none at all).

    Rows are counted over tasks, so that no set of tasks is ever collected; a task failed in any row is failed.
    """
    per = rows.groupBy(*group, member, task).agg(F.max(failed).alias("f"))
    one, two = (per.withColumnsRenamed({member: m, "f": f}) for m, f in (("left", "a"), ("right", "b")))
    pairs = one.join(two, [*group, task]).groupBy(*group, "left", "right").agg(F.count_if(F.expr("a and b")).alias("shared"), F.count_if(F.expr("a and not b")).alias("onlyLeft"), F.count_if(F.expr("b and not a")).alias("onlyRight"), F.count_if(F.expr("not a and not b")).alias("bothPass"))
    either = F.col("shared") + F.col("onlyLeft") + F.col("onlyRight")
    return pairs.withColumn("either", either).withColumn("jaccard", F.coalesce(F.try_divide("shared", either), F.lit(1.0)))


def failed_sets(rows: DataFrame, group: Sequence[str], member: str, task: str, failed: Column) -> DataFrame:
    """Each member's failed and seen tasks as bitmaps, in buckets of 32,768 tasks: group, member, bucket,
    failedSet, seenSet.

    A task's bit is its rank among the group's tasks, so bitmaps of one group compare. A task failed in any row is
    failed; one seen by a member has a bit in seenSet.
    """
    per = rows.groupBy(*group, member, task).agg(F.max(failed).alias("f"))
    bit = per.select(*group, task).distinct().withColumn("_bit", F.dense_rank().over(Window.partitionBy(*group).orderBy(task)).cast("long")) if group else _ranked(per, task)
    placed = per.join(bit, [*group, task]).select(*group, F.col(member).alias("member"), F.bitmap_bucket_number("_bit").alias("bucket"), F.bitmap_bit_position("_bit").alias("p"), "f")
    return placed.groupBy(*group, "member", "bucket").agg(F.bitmap_construct_agg(F.when(F.col("f"), F.col("p"))).alias("failedSet"), F.bitmap_construct_agg("p").alias("seenSet"))


def _ranked(per: DataFrame, task: str) -> DataFrame:
    """Places of all tasks, counted by ranges: no task holds them all."""
    tasks = stored(per.select(task).distinct().repartitionByRange(task).sortWithinPartitions(task).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["count"] for r in tasks.groupBy("_p").count().collect()}  # a row per partition
    before, starts = 0, {}
    for p in sorted(sizes):
        starts[p], before = before, before + sizes[p]
    first = tasks.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "_p int, _start long")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(task))
    return tasks.withColumn("_n", within).join(F.broadcast(first), "_p").select(task, (F.col("_start") + F.col("_n")).alias("_bit"))


def bitmap_overlap(rows: DataFrame, group: Sequence[str], member: str, task: str, failed: Column) -> DataFrame:
    """failure_overlap() from bitmaps, with equal: whether both failed the same tasks.

    Pairs meet once per bucket of tasks, not once per task. Tasks that only one of a pair has seen don't count, except
    in equal, which compares the whole sets.
    """
    sets = stored(failed_sets(rows, group, member, task, failed))
    one, two = (sets.withColumnsRenamed({"member": m, "failedSet": f"{m}Failed", "seenSet": f"{m}Seen"}) for m in ("left", "right"))
    pairs = one.join(two, [*group, "bucket"])
    both = pairs.select(*group, "left", "right", "bucket", "leftFailed", "rightFailed", F.explode(F.array(F.struct(F.col("leftFailed").alias("f1"), F.col("leftSeen").alias("s1")), F.struct(F.col("rightFailed").alias("f1"), F.col("rightSeen").alias("s1")))).alias("x"))
    met = both.groupBy(*group, "left", "right", "bucket").agg(F.bitmap_and_agg("x.f1").alias("shared"), F.bitmap_and_agg("x.s1").alias("seen"), F.first("leftFailed").alias("l"), F.first("rightFailed").alias("r"))
    seen_by_both = met.select(*group, "left", "right", "bucket", F.bitmap_count("shared").alias("shared"), F.bitmap_count("seen").alias("seen"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("l").alias("b")), F.struct(F.lit(0).alias("k"), F.col("seen").alias("b")), F.struct(F.lit(1).alias("k"), F.col("r").alias("b")), F.struct(F.lit(1).alias("k"), F.col("seen").alias("b")))).alias("x"))
    failed_seen = seen_by_both.groupBy(*group, "left", "right", "bucket", "x.k").agg(F.first("shared").alias("shared"), F.first("seen").alias("seen"), F.bitmap_count(F.bitmap_and_agg("x.b")).alias("n"))
    left_n, right_n = F.sum(F.when(F.col("k") == 0, F.col("n"))), F.sum(F.when(F.col("k") == 1, F.col("n")))
    shared, seen = F.sum(F.when(F.col("k") == 0, F.col("shared"))), F.sum(F.when(F.col("k") == 0, F.col("seen")))
    counted = failed_seen.groupBy(*group, "left", "right").agg(shared.alias("shared"), (left_n - shared).alias("onlyLeft"), (right_n - shared).alias("onlyRight"), (seen - left_n - right_n + shared).alias("bothPass"))
    digests = set_digests(sets, group)
    a, b = (digests.withColumnsRenamed({"member": m, "digest": f"{m}Digest"}) for m in ("left", "right"))
    named = counted.join(a, [*group, "left"]).join(b, [*group, "right"])
    either = F.col("shared") + F.col("onlyLeft") + F.col("onlyRight")
    out = named.withColumn("either", either).withColumn("jaccard", F.coalesce(F.try_divide("shared", either), F.lit(1.0))).withColumn("equal", F.col("leftDigest") == F.col("rightDigest"))
    return out.select(*group, "left", "right", "shared", "onlyLeft", "onlyRight", "either", "bothPass", "jaccard", "equal")


def set_digests(sets: DataFrame, group: Sequence[str]) -> DataFrame:
    """A digest of each member's failed tasks; members with equal sets have equal ones."""
    some = F.when(F.bitmap_count("failedSet") > 0, F.struct("bucket", F.sha2("failedSet", 256).alias("d")))
    lists = sets.groupBy(*group, "member").agg(F.array_sort(F.collect_list(some)).alias("parts"))  # a short text per 32,768 tasks
    return lists.select(*group, "member", F.sha2(F.to_json("parts"), 256).alias("digest"))


def jaccard(a: Column, b: Column) -> Column:
    """U02 for arrays as sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def box_stats(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Quartiles, mean, whiskers at the extreme values within 1.5 IQR, and how many lie outside, with their values."""
    clean = rows.select(*group, finite(F.col(value)).alias("v")).where("v is not null")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    quartiles = clean.groupBy(*group).agg(q.alias("q"), F.avg("v").alias("mean"), F.count("*").alias("n"))
    on = F.lit(True)
    named = quartiles.toDF(*[f"_{c}" for c in group], "q", "mean", "n")
    for c in group:
        on = on & clean[c].eqNullSafe(named[f"_{c}"])
    joined = clean.join(named, on)
    low, high = F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0]), F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = (F.col("v") >= low) & (F.col("v") <= high)
    out = joined.groupBy(*group, "q", "mean", "n").agg(F.min(F.when(inside, F.col("v"))).alias("whiskerLow"), F.max(F.when(inside, F.col("v"))).alias("whiskerHigh"), F.array_sort(F.collect_list(F.when(~inside, F.col("v")))).alias("outliers"))
    return out.select(*group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean", "n", "whiskerLow", "whiskerHigh", "outliers")


def variance_shares(rows: DataFrame, group: Sequence[str], one: str, two: str, value: str) -> DataFrame:
    """Shares (percent) of the sum of squares by each of two factors, and what remains; for balanced designs."""
    of = lambda *c: Window.partitionBy(*group, *c) if (group or c) else Window.partitionBy(F.lit(0))
    means = rows.select(*group, F.col(value).cast("double").alias("v"), F.avg(value).over(of()).alias("m"), F.avg(value).over(of(one)).alias("a"), F.avg(value).over(of(two)).alias("b"))
    sq = lambda x: F.sum(F.pow(x, F.lit(2.0)))
    sums = means.groupBy(*group).agg(sq(F.col("v") - F.col("m")).alias("total"), sq(F.col("a") - F.col("m")).alias("one"), sq(F.col("b") - F.col("m")).alias("two"))
    share = lambda c: F.try_divide(100.0 * c, F.col("total"))
    return sums.select(*group, share(F.col("one")).alias("firstShare"), share(F.col("two")).alias("secondShare"), share(F.col("total") - F.col("one") - F.col("two")).alias("remainder"))


def mean_of_means(rows: DataFrame, group: Sequence[str], inner: Sequence[str], value: str) -> DataFrame:
    """Pooled mean, mean of the inner groups' means, and their difference in points."""
    per = rows.groupBy(*group, *inner).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return per.groupBy(*group).agg(F.avg("m").alias("balanced"), F.try_divide(F.sum("s"), F.sum("n")).alias("pooled")).withColumn("delta", 100 * (F.col("balanced") - F.col("pooled")))
