"""Sinks: JSON lines, sharded stores, CSV, Markdown, manifests and view documents."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.evidence import Evidence
from skyledger.functions.identity import badge_color, canonical_json


def workspace(spark: SparkSession) -> str:
    """A new place below the folder that driver and executors share (spark.checkpoint.dir); on one machine a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/skyledger-files"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the workspace: later jobs start from it, also when executors are lost."""
    path = workspace(df.sparkSession)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON lines with null fields kept."""
    return df.select(canonical_json(F.struct("*")).alias("value"))


def table_digest(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Bytes and sha256 of a table's ordered JSON lines, as if they stood in one file.

    The table is one row for a moment, so this is for tables of a single bundle, whose size is limited at ingestion;
    ordered_digest() is for any other.
    """
    rows = df.select(F.struct(*order).alias("k"), canonical_json(F.struct(*df.columns)).alias("v"))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]), "\n"), F.lit("\n"))
    return rows.agg(F.count("*").alias("rows"), F.octet_length(text).alias("bytes"), F.sha2(text, 256).alias("sha256"))


def ordered_digest(df: DataFrame, order: Sequence[str], *, chunk: int = 1 << 16) -> DataFrame:
    """Rows, bytes and sha256 of a table's ordered JSON lines as one file, for tables of any size.

    The table is parted by ranges of order and sorted; tasks turn their range into chunks of about so many bytes. A last
    task takes the chunks, compressed, in order and hashes them as they stream by, as the hash needs them one after the
    other: it reads every byte but holds a batch. A batch is 10,000 chunks unless the session says less, so chunks are small. Rows that tie in order must be equal, or order must have all columns. An empty
    table is an empty file.
    """
    lines = df.select(*order, canonical_json(F.struct(*df.columns)).alias("_line"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_line")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, rows, size = TaskContext.get().partitionId(), 0, [], 0, 0

        def packed() -> pa.RecordBatch:
            body = zlib.compress(b"".join(held), 1)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([rows], pa.int64()), pa.array([body], pa.binary())], ["part", "seq", "rows", "body"])

        for batch in batches:
            for line in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(line + b"\n")
                rows += 1
                size += len(line) + 1
                if size >= chunk:
                    yield packed()
                    seq, held, rows, size = seq + 1, [], 0, 0
        if held:
            yield packed()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, rows, size = hashlib.sha256(), 0, 0
        for batch in batches:
            for n, body in zip(batch.column(0), batch.column(1), strict=True):
                data = zlib.decompress(body.as_py())
                sha.update(data)
                rows, size = rows + n.as_py(), size + len(data)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([size], pa.int64()), pa.array([sha.hexdigest()])], ["rows", "bytes", "sha256"])

    chunks = stored(ranged.mapInArrow(cut_up, "part long, seq long, rows long, body binary"))
    folded = chunks.repartition(1).sortWithinPartitions("part", "seq").select("rows", "body").mapInArrow(fold, "rows long, bytes long, sha256 string")
    none = F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())  # an empty table has no task
    return folded.agg(*[F.coalesce(F.max(c), other).alias(c) for c, other in zip(("rows", "bytes", "sha256"), none, strict=True)])


def write_json_lines(df: DataFrame, path: str, *, gzip: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Fails if path exists; compressed, and one folder per run, for stores."""
    writer = df.write.mode("errorifexists").option("ignoreNullFields", False)
    if gzip:
        writer = writer.option("compression", "gzip")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_csv(df: DataFrame, path: str, *, quoted: bool = True) -> None:
    """A header; nulls are empty; fields with separators are quoted unless told otherwise."""
    writer = df.write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "")
    (writer.option("escape", '"') if quoted else writer.option("quote", "\u0000")).csv(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; more than limit rows are refused, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "".join(f"| {' | '.join(map(cell, r))} |\n" for r in lines)


def view_document(frames: Mapping[str, DataFrame], drop: Sequence[str] = ()) -> dict[str, DataFrame]:
    """JSON rows of named views, without bulky columns."""
    return {n: json_rows(df.drop(*drop)) for n, df in frames.items()}


#: Columns that the leaderboard document leaves out.
BULKY = ("trialSamples", "configurationTaskCells")


def leaderboard_document(rows: DataFrame, order: Sequence[str], drop: Sequence[str] = BULKY) -> DataFrame:
    """Leaderboard.json, one row: schemaVersion, how many rows, and the rows in order without bulky columns.

    A leaderboard has one row per configuration and is one document.
    """
    kept = rows.drop(*drop)
    entry = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), F.struct(*kept.columns).alias("row"))))
    body = F.struct(F.lit(1).alias("schemaVersion"), F.count("*").alias("count"), F.transform(entry, lambda x: x["row"]).alias("rows"))
    return kept.agg(canonical_json(body).alias("document"))


def summary_document(evidence: Evidence) -> DataFrame:
    """Summary.json, one row: how many runs, submissions, profiles, models, harnesses, trials and rounds there are."""
    one = lambda df, **aggs: df.agg(*[c.alias(n) for n, c in aggs.items()])
    e = evidence
    runs = one(e.runs, runs=F.count("*"), submissions=F.count_distinct("submissionId"))
    profiles = one(e.profiles, profiles=F.count("*"), models=F.count_distinct("modelFamily"), harnesses=F.count_distinct("harnessFamily"))
    trials, rounds = one(e.trials, trials=F.count("*"), tasks=F.count_distinct("taskId")), one(e.rounds, rounds=F.count("*"))
    whole = runs.crossJoin(profiles).crossJoin(trials).crossJoin(rounds)  # one row each
    return whole.select(canonical_json(F.struct(F.lit(1).alias("schemaVersion"), *whole.columns)).alias("document"))


EXPLORER = ["runId", "trialId", "taskId", "profileId", "firstExactPassed", "finalExactPassed", "rounds", "infrastructureFailure"]


def explorer_rows(df: DataFrame, allowed: Sequence[str] = EXPLORER) -> DataFrame:
    """The allowed columns that there are."""
    return df.select(*[c for c in allowed if c in df.columns])


def run_details(df: DataFrame, payload: Sequence[str]) -> DataFrame:
    """A run's rows as one document with a content-addressed path."""
    docs = df.groupBy("runId").agg(canonical_json(F.array_sort(F.collect_list(F.struct(*payload)))).alias("document"))
    return docs.withColumn("path", F.concat(F.lit("runs/"), F.sha2("document", 256), F.lit(".json")))


def badges(groups: DataFrame, name: str, score: str) -> DataFrame:
    """A badge document per family with a plain name."""
    text = F.when(F.col(score).isNull(), "no complete runs").otherwise(F.concat(F.format_string("%.1f", 100.0 * F.col(score)), F.lit("%")))
    rows = groups.where(F.col(name).rlike(r"\A[a-z0-9][a-z0-9-]*\z"))
    return rows.select(F.concat(F.lit("badges/"), name, F.lit(".json")).alias("path"), canonical_json(F.struct(F.lit(1).alias("schemaVersion"), F.col(name).alias("label"), text.alias("message"), badge_color(F.col(score)).alias("color"))).alias("document"))


def replace_strings(df: DataFrame, old: str, new: str) -> DataFrame:
    """Literal replacement in every string column and list of strings."""
    def one(name: str, kind: str) -> Column:
        if kind == "string":
            return F.replace(F.col(name), F.lit(old), F.lit(new)).alias(name)
        if kind == "array<string>":
            return F.transform(name, lambda x: F.replace(x, F.lit(old), F.lit(new))).alias(name)
        return F.col(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])
