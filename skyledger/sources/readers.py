"""Readers. Schemas are always explicit; strict and lenient JSON lines differ in what they do with bad lines."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger import schema
from skyledger.evidence import Evidence, conform
from skyledger.operators.quality import exact_keys, require


def json_lines(spark: SparkSession, path: str | Sequence[str], ddl: str) -> DataFrame:
    """JSON lines (also .gz); a bad line fails the query, blank ones are skipped."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


def strict_json_lines(spark: SparkSession, path: str, ddl: str, optional: Sequence[str] = ()) -> DataFrame:
    """As json_lines, after every line was found to have exactly the schema's keys."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    require(exact_keys(lines, [c for c in schema.columns(ddl) if c not in optional], optional))
    return json_lines(spark, path, ddl)


def lenient_json_lines(spark: SparkSession, path: str, key: str = "file") -> DataFrame:
    """Events as VARIANT with their file; what doesn't parse is dropped."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias(key))
    return lines.withColumn("event", F.try_parse_json("value")).where("event is not null")


def json_document(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def optional_json_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Empty if there is no such file."""
    return json_lines(spark, path, ddl) if exists(spark, path) else spark.createDataFrame([], ddl)


def csv_rows(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A CSV of strings with a header; rows, if given, must be their number."""
    df = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    if rows is not None and (found := df.count()) != rows:
        raise ValueError(f"{path}: {found} rows, not {rows}")
    return df


def bundle(spark: SparkSession, directory: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """The five tables of a bundle, with runId if given. A row's own runId is overwritten."""
    out = {}
    for name, ddl in schema.TABLES.items():
        own = ", ".join(f for f in _fields(ddl) if not f.startswith("runId "))
        df = optional_json_lines(spark, f"{directory}/{name}.jsonl", own)
        out[name] = conform(df.withColumn("runId", F.lit(run_id)) if run_id else df, ddl if "runId" in schema.columns(ddl) else own)
    return out


def _fields(ddl: str) -> list[str]:
    depth, part, out = 0, "", []
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return out


def store(spark: SparkSession, root: str) -> Evidence:
    """All accepted bundles below root/accepted/runId=.../, each table in one scan, tagged by their folder."""
    def table(name: str, ddl: str) -> DataFrame:
        own = ", ".join(f for f in _fields(ddl) if not f.startswith("runId "))
        df = spark.read.schema(own).option("mode", "FAILFAST").json(f"{root}/accepted/*/{name}.jsonl")
        return conform(df.withColumn("runId", F.regexp_extract(F.input_file_name(), r"/accepted/(?:runId=)?([^/]+)/", 1)), ddl if "runId" in schema.columns(ddl) else own)

    t = {n: table(n, d) for n, d in schema.TABLES.items()}
    runs = optional_json_lines(spark, f"{root}/runs.jsonl", schema.RUNS)
    return Evidence(runs, t["profiles"], t["trials"], t["rounds"], t["tool-calls"], t["configurations"])


def trial_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Files below a run's folder with profile, task and round from their path, in sorted order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    part = lambda i: F.regexp_extract("path", r"/trials/([^/]+?)__r(\d+)__([^/]+)/", i)
    return files.select("path", part(1).alias("taskId"), part(2).cast("int").alias("repeat"), part(3).alias("profileId"), F.regexp_extract("path", r"/rounds?/(\d+)/", 1).alias("round"), F.decode("content", "UTF-8").alias("text"))


MIB = 1 << 20


def archive_entries(archives: DataFrame, *, packed: int = 32 * MIB, raw: int = 128 * MIB, entry: int = 4 * MIB, rows_each: int = 100_000) -> DataFrame:
    """Entries of tar.gz contents (columns path, content), under limits on packed, raw and entry bytes, and on the
    rows of a table (lines of a .jsonl entry).

    Anything but plain files with plain relative names is refused.
    """
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content, strict=True):
                total = 0
                if len(content) > packed:
                    raise ValueError(f"{path}: more than {packed} bytes")
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                    for member in tar:
                        total += member.size
                        if not member.isfile() or member.name.startswith("/") or ".." in member.name.split("/"):
                            raise ValueError(f"{path}: unexpected entry {member.name}")
                        if member.size > entry or total > raw:
                            raise ValueError(f"{path}: {member.name} exceeds a limit")
                        body = tar.extractfile(member).read()
                        if member.name.endswith(".jsonl") and body.count(b"\n") > rows_each:
                            raise ValueError(f"{path}: {member.name} has more than {rows_each} rows, over the limit")
                        rows.append((path, member.name, body))
            yield pd.DataFrame(rows, columns=["path", "name", "content"])

    return archives.select("path", "content").mapInPandas(unpack, "path string, name string, content binary")
