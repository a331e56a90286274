"""Deterministic task generation: the matrix of families, scales and variants, schedules, and text edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.classify import SCALE_UNITS
from skyledger.functions.identity import literal_map

#: Scales of each family, and its cases where it has named ones: fixed values.
SCALES = {
    "unique": [10, 100, 1000], "replace-all": [1, 10, 100, 1000], "multi-file": [1, 10, 100], "select-one": [1, 10, 100, 1000], "select-subset": [10, 100, 1000], "delete-subset": [10, 100, 1000], "insert-subset": [10, 100, 1000], "distinct-edits": [1, 10, 30], "replace-block": [10, 100, 1000],
    "delete-block": [10, 100, 1000], "move-block": [10, 100, 1000], "copy-block": [10, 100, 1000], "copy-within": [10, 100, 1000], "move-between": [10, 100, 1000], "insert-block": [10, 100, 1000], "insert-payload": [10, 100, 1000],
}
LANGUAGES = ["typescript", "tsx", "python", "go", "rust", "csharp", "java", "kotlin", "sql", "shell", "json", "yaml", "markdown", "markdown-latin", "markdown-russian", "markdown-chinese", "markdown-arabic", "markdown-mixed"]
LITERALS = ["regex", "quotes", "crlf", "tabs", "no-final-newline"]
LOOKALIKES = ["nbsp", "narrow-space", "zero-width", "word-joiner", "nonbreaking-hyphen", "minus", "decomposed", "cyrillic-a"]
VARIANTS = ["plain", "unicode"]
TASK_ID = r"\A(.+?)-(\d+)((?:-[a-z-]+)?)-(plain|unicode)\z"


def task_matrix(spark: SparkSession) -> DataFrame:
    """Every task with category, scale, scaleUnit, suffix, variant and language."""
    cases = [(c, n, "") for c, ns in SCALES.items() for n in ns] + [(f"language-{op}", n, f"-{x}") for op, n in (("replace", 10), ("select", 10), ("insert", 1)) for x in LANGUAGES] + [("literal", 1, f"-{x}") for x in LITERALS]
    rows = spark.createDataFrame(cases, "category string, scale int, suffix string").crossJoin(spark.createDataFrame([(v,) for v in VARIANTS], "variant string"))
    rows = rows.unionByName(spark.createDataFrame([("unicode-fix", 1, f"-{x}", "unicode") for x in LOOKALIKES], "category string, scale int, suffix string, variant string"))
    language = F.when(F.col("category").startswith("language-"), F.when(F.col("suffix").startswith("-markdown"), "markdown").otherwise(F.substring("suffix", 2, 100))).when(F.col("category").isin("literal", "unicode-fix"), "text").otherwise("typescript")
    return rows.select(F.concat("category", F.lit("-"), F.col("scale").cast("string"), "suffix", F.lit("-"), "variant").alias("taskId"), "category", "scale", literal_map(SCALE_UNITS, F.col("category"), F.raise_error(F.concat(F.lit("no scale unit: "), "category")).cast("string")).alias("scaleUnit"), "suffix", "variant", language.alias("language"))


def parse_task_id(task: Column) -> Column:
    """G03 read backwards."""
    part = lambda i: F.regexp_extract(task, TASK_ID, i)
    return F.struct(part(1).alias("category"), part(2).cast("int").alias("scale"), part(3).alias("suffix"), part(4).alias("variant"))


def matrix(models: DataFrame, harnesses: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Every model with every harness, and further pairs; a pair that repeats fails."""
    from skyledger.operators.quality import duplicates, require

    out = models.select("model").crossJoin(F.broadcast(harnesses.select("harness")))
    out = out.unionByName(pairs.select("model", "harness")) if pairs is not None else out
    require(duplicates(out, ["model", "harness"], "J20 pair"))
    return out


def schedule(tasks: DataFrame, harnesses: DataFrame) -> DataFrame:
    """All tasks on all harnesses; of tasks with odd positions the harnesses come in reverse.

    tasks: position, taskId; harnesses: position, harness. The ordinal is computed, so nothing is sorted in one task.
    """
    n = harnesses.agg(F.count("*").alias("n"))
    h = harnesses.select(F.col("position").alias("_h"), "harness").crossJoin(n)
    rows = tasks.crossJoin(F.broadcast(h))
    within = F.when(F.col("position") % 2 == 1, F.col("n") - 1 - F.col("_h")).otherwise(F.col("_h"))
    return rows.select((F.col("position") * F.col("n") + within).cast("long").alias("ordinal"), "taskId", "harness")


def repeated(text: Column, times: Column) -> Column:
    return F.when(times > 0, F.repeat(text, times.cast("int"))).otherwise("")


def edit(text: Column, operation: str, block: Column, other: Column | None = None) -> Column:
    """Replace-all, delete, copy (after itself), insert-before, move-to-end of a literal block."""
    if operation == "replace-all":
        return F.replace(text, block, other)
    at = F.instr(text, block)
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(block), F.length(text))
    made = {"delete": F.concat(before, after), "copy": F.concat(before, block, block, after), "insert-before": F.concat(before, other if other is not None else F.lit(""), block, after), "move-to-end": F.concat(before, after, block)}[operation]
    return F.when(at > 0, made).otherwise(text)


def fixture_hash(*columns: str) -> Column:
    """Digest of a task's fields, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def select_tasks(tasks: DataFrame, selection: DataFrame) -> DataFrame:
    """the tasks of a frozen selection (taskId, fixtureSha256); a missing or changed task fails."""
    from skyledger.operators.quality import orphans, require

    require(orphans(selection, tasks, {"taskId": "taskId", "fixtureSha256": "fixtureSha256"}, "F13 selection"))
    return tasks.join(selection.select("taskId", "fixtureSha256"), ["taskId", "fixtureSha256"], "left_semi")


def filter_names(df: DataFrame, column: str, chosen: Sequence[str]) -> DataFrame:
    """all rows, or those with a chosen name."""
    return df.where(F.col(column).isin(list(chosen))) if chosen else df
