"""Submissions arrive as lines; each is accepted or refused, with a status and a reason, exactly once.

A micro-batch commits its accepted lines, its refused lines and its keys of the index as one version of a commit log. A
batch that is replayed finds its slot in the log and does nothing; a writer that another overtook judges its batch again
against the index as it has become.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.sources.commits import Changes, CommitLog, Version
from skyledger.sources.writers import stored
from skyledger.streaming.state import INDEX, concerning, index_keys, ingest

MAX_SUBMISSION = 32 << 20  # bytes
REQUIRED = ("ownerId", "clientRunId", "runId", "contentHash")
ACCEPTED = f"{INDEX}, status int, code string"
REFUSED = "sha256 string, bytes long, line string, status int, code string, message string"
KEYS = f"{INDEX}, bucket int"
BUCKETS = 256


def judge_lines(lines: DataFrame, accounts: DataFrame | None = None, *, value: str = "value", max_bytes: int = MAX_SUBMISSION) -> DataFrame:
    """INDEX's columns of each line (JSON), with sha256, bytes, line and, if it is refused before the index is asked,
    status, code and message.

    In this order: more than max_bytes is 413 payload-too-large and not parsed; what isn't a JSON object is 400
    invalid-json; with accounts (keyHash, ownerId), a line whose keyHash is none of them is 401 unauthorized, and the
    owner is the account's; without clientRunId, runId, contentHash or an owner (absent, null or empty) it is 400
    invalid-submission, and the message names what is missing. A null line is empty. The line itself is kept unless it
    is too large. Several accounts with one keyHash are an error of the caller's: the line would come out twice.
    """
    text = F.coalesce(F.col(value), F.lit(""))
    size = F.octet_length(text).cast("long")
    rows = lines.select(text.alias("line"), size.alias("bytes"), F.sha2(text, 256).alias("sha256"))
    small = F.when(F.col("bytes") <= max_bytes, F.col("line"))
    valid = F.coalesce(F.try_parse_json(small).isNotNull() & F.ltrim("line").startswith("{"), F.lit(False))
    rows = rows.withColumn("_valid", valid).withColumn("s", F.when(F.col("_valid"), F.from_json(small, f"{INDEX}, keyHash string")))
    columns = [F.col(f"s.{c}").alias(c) for c in INDEX.replace(" string", "").split(", ")]
    rows = rows.select("sha256", "bytes", "line", "_valid", "s.keyHash", *columns)
    authorized = F.lit(True)
    if accounts is not None:
        known = accounts.select(F.col("keyHash").alias("_key"), F.col("ownerId").alias("_owner"))
        rows = rows.join(known, F.col("keyHash") == F.col("_key"), "left").withColumn("ownerId", F.col("_owner"))
        authorized = F.col("_owner").isNotNull()
    missing = F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED]), lambda c: c.isNotNull())
    too_large, broken, incomplete = F.col("bytes") > max_bytes, ~F.col("_valid"), F.size(missing) > 0

    def either(large, invalid, unknown, lacking) -> Column:
        return F.when(too_large, large).when(broken, invalid).when(~authorized, unknown).when(incomplete, lacking)

    code = either(*[F.lit(x) for x in ("payload-too-large", "invalid-json", "unauthorized", "invalid-submission")])
    message = either(
        F.concat(F.lit(f"more than {max_bytes} bytes")), F.lit("not a JSON object"), F.lit("no account has this key"),
        F.concat(F.lit("missing: "), F.array_join(missing, ", ")),
    )
    status = either(F.lit(413), F.lit(400), F.lit(401), F.lit(400))
    names = [c.split(" ")[0] for c in INDEX.split(", ")]
    kept = F.when(~too_large, F.col("line")).alias("line")
    return rows.select("sha256", "bytes", kept, *names, status.alias("status"), code.alias("code"), message.alias("message"))


def settle(judged: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted (ACCEPTED) and refused (REFUSED) rows of judged lines, given the index (INDEX).

    201 created and 200 duplicate are accepted, with the submission id that counts; a conflict is 400. A line that comes
    several times is created once, and the others are its duplicates.
    """
    names = [c.split(" ")[0] for c in INDEX.split(", ")]
    lines = judged.where("status is null").select("line", "sha256", "bytes", *names[:4], F.coalesce("submissionId", "contentHash").alias("submissionId"))
    outcome = stored(ingest(index, lines.select(*names)))
    accepted = outcome.where("outcome <> 'conflict'").select(
        *names[:4], F.col("countedId").alias("submissionId"), F.when(F.col("outcome") == "created", 201).otherwise(200).alias("status"), F.col("outcome").alias("code")
    )
    # lines that agree in every field share their outcome if it is a conflict, so they find their text again by the fields
    clashing = outcome.where("outcome = 'conflict'").select(*names).distinct()
    clash = lines.join(clashing, names, "left_semi").select("sha256", "bytes", "line", F.lit(400).alias("status"), F.lit("invalid-submission").alias("code"), F.lit("already used for different content").alias("message"))
    refused = judged.where("status is not null").select("sha256", "bytes", "line", "status", "code", "message").unionByName(clash)
    return accepted, refused


def known_rows(log: CommitLog, version: Version, batch: DataFrame) -> DataFrame:
    """The rows of the index that a batch can meet: only buckets of the batch's keys are read."""
    buckets = [r.bucket for r in batch.select(F.explode(index_keys()).alias("key")).select(bucket_of().alias("bucket")).distinct().collect()]  # BUCKETS at most
    have = log.read("keys", KEYS, version).where(F.col("bucket").isin(buckets)).drop("bucket")
    return concerning(have, batch)


def bucket_of() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")


def commit_batch(log: CommitLog, lines: DataFrame, slot: str, accounts: DataFrame | None = None, *, max_bytes: int = MAX_SUBMISSION) -> Version:
    """Judge the lines of a batch (column value) and commit them under a slot; a slot that is there already stays as it is."""
    judged = judge_lines(lines, accounts, max_bytes=max_bytes).persist()
    names = [c.split(" ")[0] for c in INDEX.split(", ")]

    def change(head: Version) -> Changes | None:
        if slot in head.tables.get("accepted", {}):
            return None
        whole = judged.where("status is null").select(*names).withColumn("submissionId", F.coalesce("submissionId", "contentHash"))
        accepted, refused = settle(judged, known_rows(log, head, whole))
        folder = log.write(accepted, "accepted")
        created = log.spark.read.schema(ACCEPTED).parquet(folder).where("status = 201").select(*names)
        keys = created.withColumn("key", F.explode(index_keys())).select(*names, bucket_of().alias("bucket")).distinct().repartition("bucket")  # a file per bucket
        return {"accepted": {slot: folder}, "refused": {slot: log.write(refused, "refused")}, "keys": {slot: log.write(keys, "keys", partition_by=("bucket",))}}

    try:
        return log.update(slot, change)
    finally:
        judged.unpersist()


def ingest_stream(spark: SparkSession, incoming: str, root: str, checkpoint: str, accounts: DataFrame | None = None, *, max_bytes: int = MAX_SUBMISSION):
    """Ingest the lines of files that arrive in a folder into the commit log at root: tables accepted, refused and keys.

    Any number of streams with checkpoints of their own may share a log. compact() joins the folders of many batches.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def run(batch: DataFrame, number: int) -> None:
        commit_batch(CommitLog(batch.sparkSession, root), batch, f"{name}-{number:09}", accounts, max_bytes=max_bytes)

    lines = spark.readStream.option("maxFilesPerTrigger", 100).text(incoming)
    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(log: CommitLog, last: str) -> Version:
    """Join the keys of all slots up to last into one. Slots of accepted lines stay, as they tell which batches are in."""

    def change(head: Version) -> Changes | None:
        slots = [s for s in head.tables.get("keys", {}) if s <= last]
        if len(slots) < 2:
            return None
        part = Version(tables={"keys": {s: head.tables["keys"][s] for s in slots}})
        folder = log.write(log.read("keys", KEYS, part).distinct().repartition("bucket"), "keys", partition_by=("bucket",))
        return {"keys": {s: None for s in slots[:-1]} | {slots[-1]: folder}}

    return log.update(f"compact up to {last}", change)
