"""Views that follow a state. A change of runs rewrites the rows of the groups that it touches, no others.

State, runs and views are tables of one commit log (see sources.commits), so a reader sees a state with the views made
of it. The state has a folder per run, parted by group; a view has a folder per group. A group is a value of one column
(the model family, say). A change names its groups: those of the rows that come and of those that go. Only their rows
are read from the runs' folders, and only their folders of the views are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyledger.functions.identity import canonical_json
from skyledger.operators.cells import BENCHMARK, cells, run_identity
from skyledger.operators.leaderboard import exact_from_cells
from skyledger.sources.commits import Changes, CommitLog, Version
from skyledger.streaming.state import state_efficiency

#: A view: rows made of a state's rows of whole groups and of the benchmarks' task counts; it keeps the group's column.
View = Callable[[DataFrame, DataFrame], DataFrame]
COUNTS = [*BENCHMARK, "benchmarkTasks"]


def run_counts(runs: DataFrame) -> DataFrame:
    """runId and COUNTS: how many tasks each run declares of its benchmark."""
    return run_identity(runs).where("declared >= 1").select("runId", *BENCHMARK, F.col("declared").cast("long").alias("benchmarkTasks"))


def exact_view(state: DataFrame, counts: DataFrame) -> DataFrame:
    return exact_from_cells(cells(state), counts)


def efficiency_view(state: DataFrame, counts: DataFrame) -> DataFrame:
    by_profile = state.select("runId", "profileId", "modelFamily").distinct()
    return state_efficiency(state).join(by_profile, ["runId", "profileId"])


def totals_view(state: DataFrame, counts: DataFrame) -> DataFrame:
    return state.groupBy("modelFamily", "harnessFamily").agg(
        F.count("*").alias("trials"), F.count_if("first").alias("firstPasses"), F.count_if("final").alias("finalPasses"), F.count_distinct("runId").alias("runs")
    )


VIEWS: dict[str, View] = {"exact": exact_view, "efficiency": efficiency_view, "totals": totals_view}


class MaintainedViews:
    """A state and its views in a log. group is the column whose values are rewritten together.

    schema is the state's; every row has a runId, and a null group is a group of its own. counts holds BENCHMARK's
    columns and benchmarkTasks of each run (the state of what runs declare); when the largest count of a benchmark
    changes, all groups are touched, as their coverage is measured by it.
    """

    def __init__(self, log: CommitLog, schema: StructType, *, views: Mapping[str, View] = VIEWS, group: str = "modelFamily"):
        self.log, self.schema, self.views, self.group = log, schema, views, group

    def state(self, version: Version | None = None, slots: Sequence[str] | None = None) -> DataFrame:
        return self._rows("state", self.schema, version, slots)

    def view(self, name: str, version: Version | None = None) -> DataFrame:
        version = version or self.log.head()
        if version.folders(f"view-{name}"):
            schema = self.log.spark.read.parquet(version.folders(f"view-{name}")[0]).schema
            return self._rows(f"view-{name}", schema, version, None)
        empty = self.log.spark.createDataFrame([], self.schema)
        return self.views[name](empty, self._counts(Version()))

    def _rows(self, table: str, schema: StructType, version: Version | None, slots: Sequence[str] | None) -> DataFrame:
        version = version or self.log.head()
        chosen = {s: f for s, f in version.tables.get(table, {}).items() if slots is None or s in slots}
        rows = self.log.read(table, self._ddl(schema), Version(tables={table: chosen}))
        return rows.select(*schema.names)

    @staticmethod
    def _ddl(schema: StructType) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def _counts(self, version: Version) -> DataFrame:
        kinds = ", ".join([*(f"{c} string" for c in BENCHMARK), "benchmarkTasks long"])
        return self.log.read("counts", kinds, version).groupBy(*BENCHMARK).agg(F.max("benchmarkTasks").alias("benchmarkTasks"))

    def _tag(self) -> Column:
        """A name for a group that can stand in a path; that of a null is apart from all others."""
        c = F.col(self.group).cast("string")
        return F.when(c.isNull(), "none").otherwise(F.concat(F.lit("g"), F.substring(F.sha2(c, 256), 1, 20)))

    def apply(self, title: str, rows: DataFrame | None = None, counts: DataFrame | None = None, remove: Sequence[str] = ()) -> Version:
        """One version that has the runs of rows (added, or replaced where the state has them) and not those in remove.

        rows: state rows of whole runs; counts: runId and COUNTS of the same runs. A run to remove that is not there is
        an error, as is a run that is both added and removed. A writer that was overtaken makes its views again from
        the state as it has become.
        """
        log = self.log
        added: dict[str, str] = {}
        declared: dict[str, str] = {}
        if rows is not None:
            # rows may be costly to make, so they are asked for once; folders that no version names are nobody's
            added = log.write_slots(rows.withColumn("tag", self._tag()), "state", "runId", partition_by=("tag",))
            if both := sorted(set(added) & set(remove)):
                raise ValueError(f"added and removed: {both}")
            if counts is not None:
                declared = log.write_slots(counts.select("runId", *BENCHMARK, F.col("benchmarkTasks").cast("long").alias("benchmarkTasks")), "counts", "runId")

        def change(head: Version) -> Changes:
            have = head.tables.get("state", {})
            if unknown := sorted(set(remove) - set(have)):
                raise ValueError(f"no runs {unknown}")
            state = {run: None for run in remove} | added
            counted = {run: None for run in remove} | {run: declared.get(run) for run in added}
            after = Version(tables={"state": {k: v for k, v in (have | state).items() if v}, "counts": {k: v for k, v in (head.tables.get("counts", {}) | counted).items() if v}})
            same_counts = self._counts(head).exceptAll(self._counts(after)).isEmpty() and self._counts(after).exceptAll(self._counts(head)).isEmpty()
            gone = Version(tables={"state": {r: have[r] for r in state if r in have}})
            come = Version(tables={"state": {r: f for r, f in state.items() if f}})
            tags = lambda v: {r.tag for r in log.read("state", "runId string, tag string", v).select("tag").distinct().collect()}
            touched = tags(gone) | tags(come) if same_counts else tags(after) | tags(head)
            changes: dict[str, dict[str, str | None]] = {"state": state, "counts": counted}
            whole = log.read("state", self._ddl(self.schema) + ", tag string", after).where(F.col("tag").isin(sorted(touched)))
            for name, make in self.views.items():
                new = make(whole.select(*self.schema.names), self._counts(after)).withColumn("tag", self._tag())
                folder = log.write(new, f"view-{name}", partition_by=("tag",))
                there = {r.tag for r in log.read(f"view-{name}", "tag string", Version(tables={f"view-{name}": {"all": folder}})).distinct().collect()}
                changes[f"view-{name}"] = {tag: f"{folder}/tag={tag}" if tag in there else None for tag in touched}
            return changes

        return log.update(title, change)


def views_document(frames: Mapping[str, DataFrame], order: Mapping[str, Sequence[str]]) -> DataFrame:
    """Views.json, one row: schemaVersion, and each view's rows in order. A view has a row per configuration."""
    body = [F.lit(1).alias("schemaVersion")]
    parts = []
    for name, df in frames.items():
        entry = F.array_sort(F.collect_list(F.struct(F.struct(*order[name]).alias("k"), F.struct(*df.columns).alias("row"))))
        parts.append(df.agg(F.transform(entry, lambda x: x["row"]).alias(name)))
        body.append(F.col(name))
    return reduce(lambda a, b: a.crossJoin(b), parts).select(canonical_json(F.struct(*body)).alias("document"))  # one row each


def community_document(runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Community.json, one row: contributors with what they submitted, and harnesses with who ran them.

    A run without an account counts for nobody. Contributors are in order of their runs, most first, then by name.
    """
    by = F.col("submittedBy.accountId").alias("account")
    owned = runs.select("runId", by).where("account is not null")
    used = profiles.select("runId", "modelFamily", "harnessFamily").join(owned, "runId")
    people = owned.groupBy("account").agg(F.count_distinct("runId").alias("runs"))
    kinds = used.groupBy("account").agg(F.count_distinct("modelFamily").alias("models"), F.count_distinct("harnessFamily").alias("harnesses"))
    rows = people.join(kinds, "account", "left").select("account", "runs", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("models", "harnesses")])
    listed = F.array_sort(F.collect_list(F.struct((-F.col("runs")).alias("k"), "account", "runs", "models", "harnesses")))
    contributors = rows.agg(F.transform(listed, lambda x: F.struct(x["account"].alias("account"), x["runs"].alias("runs"), x["models"].alias("models"), x["harnesses"].alias("harnesses"))).alias("contributors"))
    per = used.where("harnessFamily is not null").groupBy("harnessFamily").agg(F.count_distinct("account").alias("contributors"), F.count_distinct("runId").alias("runs"))
    harnesses = per.agg(F.array_sort(F.collect_list(F.struct(F.col("harnessFamily").alias("harness"), "contributors", "runs"))).alias("harnesses"))
    return contributors.crossJoin(harnesses).select(canonical_json(F.struct(F.lit(1).alias("schemaVersion"), "contributors", "harnesses")).alias("document"))
