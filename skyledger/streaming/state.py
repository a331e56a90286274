"""Incremental evidence: mergeable state, idempotent ingestion, corrections, streams of events.

State is a table of trials with what the views need of their rounds and calls, and a digest of each run's whole
evidence. Runs add up, so leaderboards, samples, efficiency and tool counts come from state alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DateType, IntegerType, NumericType, ShortType, StringType, TimestampNTZType, TimestampType

from skyledger.evidence import Evidence
from skyledger.functions.identity import canonical_json
from skyledger.operators.cells import METRICS, cells, identities, trial_facts
from skyledger.operators.summary import USAGE
from skyledger.sources.writers import stored

TABLES = ("profiles", "trials", "rounds", "tool_calls")
#: Types that are hashed as they are; others as JSON, as hashes pass over nulls inside them.
FLAT = (BinaryType, BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType)


def run_digests(evidence: Evidence) -> DataFrame:
    """A digest per run of all its evidence: profiles, trials, rounds and calls, as multisets of rows.

    It is made of a count, sums and an exclusive or of row hashes, so tasks merge it and no run is ever one list. Columns
    are hashed by name and value, with a mask of those that are null; whole numbers of any width are the same. A hash is
    summed in parts, which no number of rows takes beyond a long and which cost less than decimals.
    """
    def hashed(name: str) -> DataFrame:
        df = getattr(evidence, name)
        fields = sorted(df.schema, key=lambda f: f.name)
        flat = {f.name: F.col(f.name).cast("long") if isinstance(f.dataType, (ByteType, ShortType, IntegerType)) else F.col(f.name) for f in fields if isinstance(f.dataType, FLAT)}
        nested = [f.name for f in fields if f.name not in flat]
        values = list(flat.values())
        nulls = [reduce(Column.bitwiseOR, [F.shiftleft(c.isNull().cast("long"), i) for i, c in enumerate(values[at : at + 64])]) for at in range(0, len(values), 64)]
        row = [F.lit("\t".join([name, *flat])), *nulls, *values, *([canonical_json(F.struct(*nested))] if nested else [])]
        return df.select("runId", F.xxhash64(*row).alias("a"), F.xxhash64(F.lit("second"), *row).alias("b"))

    rows = reduce(DataFrame.unionAll, [hashed(n) for n in TABLES])
    parts = [F.sum(F.shiftrightunsigned("a", at).bitwiseAND(F.lit((1 << 22) - 1))).alias(f"a{at}") for at in (0, 22, 44)]
    per = rows.groupBy("runId").agg(F.count("*").alias("n"), *parts, F.bit_xor("b").alias("b"))
    return per.select("runId", F.sha2(F.concat_ws("/", "n", "a0", "a22", "a44", "b"), 256).alias("digest"))


def create_state(evidence: Evidence) -> DataFrame:
    """What leaderboards, efficiency, samples and tool counts need of every trial, with the digest of its run.

    Per trial: identity, passes, metrics under the coverage rule, sums of its rounds' usage with how many reported each,
    and its calls by tool. The raw rounds and calls are not needed again. Identities with digests, a row per profile, are
    stored: every merge asks for them, they stand on all the evidence, and Spark then knows how few they are.
    """
    known = stored(identities(evidence).join(run_digests(evidence), "runId"))
    usage = evidence.rounds.groupBy("runId", "trialId").agg(F.count("*").alias("seenRounds"), *[x for c in USAGE for x in (F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"seen_{c}"))])
    per_round = evidence.tool_calls.groupBy("runId", "roundId", "tool").agg(F.count("*").alias("n"))
    per_trial = per_round.join(evidence.rounds.select("runId", "roundId", "trialId"), ["runId", "roundId"]).groupBy("runId", "trialId", "tool").agg(F.sum("n").alias("n"))
    tools = per_trial.groupBy("runId", "trialId").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"))
    return trial_facts(evidence, known=known, beside=[usage, tools])


def merge_cells(state: DataFrame) -> DataFrame:
    """Cells of all runs together: what exact_from_cells takes."""
    return cells(state)


def state_efficiency(state: DataFrame) -> DataFrame:
    """A33 from state alone: sums that stay null without observations, and how many there were."""
    sums = [x for c in USAGE for x in (F.sum(f"sum_{c}").alias(c), F.coalesce(F.sum(f"seen_{c}"), F.lit(0)).alias(f"{c}Observed"))]
    return state.where("seenRounds > 0").groupBy("runId", "profileId").agg(F.sum("seenRounds").alias("rounds"), *sums)


def state_tool_counts(state: DataFrame, tool: str) -> DataFrame:
    """A31 from state alone: how often each trial called the tool, zeros included."""
    return state.select("runId", "trialId", "profileId", F.coalesce(F.try_element_at("tools", F.lit(tool)), F.lit(0)).alias("n"))


def classify_runs(known: DataFrame, new: DataFrame) -> DataFrame:
    """Runs of new as new, duplicate or conflict, by digest."""
    k = known.select("runId", F.col("digest").alias("_old")).distinct()
    rows = new.select("runId", "digest").distinct().join(k, "runId", "left")
    return rows.select("runId", F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("digest"), "duplicate").otherwise("conflict").alias("outcome"))


def append_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """State with the runs of new that it lacks; the same evidence again changes nothing, other evidence fails."""
    outcomes = stored(classify_runs(state, new))  # a row per run; without it, each later use would make both states again
    conflicts = outcomes.where("outcome = 'conflict'").limit(5).collect()
    if conflicts:
        raise ValueError(f"conflicting evidence for runs {[r.runId for r in conflicts]}")
    return state.unionByName(new.join(outcomes.where("outcome <> 'new'"), "runId", "left_anti").select(state.columns))


def state_binding(state: DataFrame, runs: DataFrame, position: str | None = None) -> DataFrame:
    """One row that ties a state to its index: how many runs, and a digest of their digests in the index's order.

    position is the index's order of runs, by runId if not given. The index has one row per run and is one document.
    """
    order = F.col(position) if position else F.col("runId")
    rows = runs.select("runId", order.alias("_at")).join(state.select("runId", "digest").distinct(), "runId", "left")
    entry = F.struct("_at", "runId", F.coalesce("digest", F.lit("none")).alias("digest"))
    lines = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat_ws(":", x["runId"], x["digest"]))
    return rows.agg(F.count("*").alias("runs"), F.sha2(F.array_join(lines, "\n"), 256).alias("indexSha256"))


def verify_state(state: DataFrame, runs: DataFrame, binding: DataFrame | None = None, position: str | None = None) -> None:
    """Fails unless state has exactly the runs of the index, each with one digest and no trial twice, and,
    if a binding is given, in the order and with the evidence that it was made of."""
    have, want = state.select("runId").distinct(), runs.select("runId").distinct()
    odd = have.join(want, "runId", "full_outer").join(have.join(want, "runId"), "runId", "left_anti").limit(5).collect()
    if odd:
        raise ValueError(f"state and index differ in runs {[r.runId for r in odd]}")
    twice = state.groupBy("runId").agg(F.count_distinct("digest").alias("d"), F.count("*").alias("n"), F.count_distinct("trialId").alias("t")).where("d > 1 or n > t").limit(5).collect()
    if twice:
        raise ValueError(f"state has several digests or a trial twice in runs {[r.runId for r in twice]}")
    if binding is not None and not state_binding(state, runs, position).exceptAll(binding.select("runs", "indexSha256")).isEmpty():
        raise ValueError("state is not bound to this index")


def materialize(state: DataFrame) -> DataFrame:
    """The trials that state stands for, each with its own values."""
    return state.select("runId", "trialId", "taskId", "profileId", F.col("first").alias("firstExactPassed"), F.col("final").alias("finalExactPassed"), "rounds", *METRICS)


def replace_run(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Table with the runs of rows replaced by them."""
    return table.join(rows.select("runId").distinct(), "runId", "left_anti").unionByName(rows)


def remove_run(table: DataFrame, run_id: str) -> DataFrame:
    """Table without a run that it must have."""
    if table.where(F.col("runId") == run_id).isEmpty():
        raise ValueError(f"no run {run_id}")
    return table.where(F.col("runId") != run_id)


INDEX = "ownerId string, clientRunId string, runId string, contentHash string, submissionId string"


def serve(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ingest()'s rule for submissions in order, one by one; each row brings what is known of its keys."""
    kept: dict[tuple, tuple] = {}
    for batch in rows:
        out = []
        for x in batch.to_pylist():
            keys = {"client": (x["ownerId"], x["clientRunId"]), "content": (x["contentHash"],), "run": (x["runId"],)}
            keys = {k: (k, *v) for k, v in keys.items() if None not in v}
            fact = lambda k: x[f"_{k}"] or kept.get(keys.get(k))  # noqa: B023, E731
            counted = None
            if mine := fact("client"):
                same = x["contentHash"] is not None and mine["contentHash"] == x["contentHash"]
                outcome, counted = ("duplicate", mine["submissionId"]) if same else ("conflict", None)
            elif same := fact("content"):
                outcome, counted = "duplicate", same["submissionId"]
            elif fact("run"):
                outcome = "conflict"
            else:
                outcome = "created"
                for key in keys.values():
                    kept[key] = {"submissionId": x["submissionId"], "contentHash": x["contentHash"]}
            out.append((outcome, counted if counted is not None else x["submissionId"]))
        columns = [pa.array([o[i] for o in out], pa.string()) for i in (0, 1)]
        names = INDEX.replace(" string", "").split(", ")
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, "outcome", "countedId"])


def ingest(index: DataFrame, batch: DataFrame, *, few: int = 50_000) -> DataFrame:
    """Each submission of a batch with its outcome and the submission id that counts, as if they came one by
    one, by submission id (null: the content hash) and then owner, client and run.

    The same owner and client run as one that is in, with the same content: duplicate; with other content: conflict. The
    same content from anyone: duplicate of that. The same run with other content: conflict. Else: created, and in. A null
    key clashes with nothing. The index has one row per accepted submission and is joined by key, never collected.

    A round settles what no earlier open submission can change: whoever's client is in; then, if none of the same client
    that may still be created comes before, whoever's content is in; then likewise by run; and the first of all three.
    A submission meets only what comes before it in order (the index comes before all): a later one may be in already,
    as one that has an earlier key which is in can't be created and nothing waits for it. A key that many
    share is settled for all of them once its first one is in, so rounds are as many as the longest chain of submissions
    that wait for each other by different keys. Once at most few submissions are open, one task serves them in order.
    """
    names = ["ownerId", "clientRunId", "runId", "contentHash", "submissionId"]
    by = {"client": ["ownerId", "clientRunId"], "content": ["contentHash"], "run": ["runId"]}
    rows = batch.select(*names[:4], F.coalesce("submissionId", "contentHash").alias("submissionId")).withColumn("_i", F.monotonically_increasing_id())
    pending = stored(rows.withColumn("_at", F.struct("submissionId", "ownerId", "clientRunId", "runId", "_i")))
    known, settled = index.select(*names, F.lit(None).cast(pending.schema["_at"].dataType).alias("_at")), []

    def meeting(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
        """rows with what is in by a key and comes before them. A key is in by rows of the index or by one of the batch."""
        found = facts.groupBy(*by[key]).agg(F.min(F.struct("submissionId", "contentHash")).alias("_fact"), F.min("_at").alias("_since"))
        before = F.col("_since").isNull() | (F.col("_since") < F.col("_at"))
        return rows.join(found, by[key], "left").withColumn(f"_{key}", F.when(before, F.col("_fact"))).drop("_fact", "_since")

    while True:
        if pending.count() <= few:
            met = pending
            for key, columns in by.items():
                wanted = known.join(F.broadcast(pending.select(*columns).distinct()), columns, "left_semi")  # few rows
                met = meeting(met, wanted, key)
            served = met.select(*names, "_at", *[f"_{k}" for k in by]).repartition(1).sortWithinPartitions("_at").drop("_at")
            return reduce(DataFrame.unionAll, [*settled, served.mapInArrow(serve, f"{INDEX}, outcome string, countedId string")])
        met = pending
        for key in by:
            met = meeting(met, known, key)
        met = stored(met)
        able = met.where(" and ".join(f"_{k} is null" for k in by))  # only these can still come in, so others wait for these alone
        for key, columns in by.items():
            met = met.join(able.groupBy(*columns).agg(F.min("_at").alias(f"_first_{key}")), columns, "left")
        first = {k: F.col(f"_first_{k}").isNull() | (F.col(f"_first_{k}") >= F.col("_at")) for k in by}
        mine, same, run = (F.col(f"_{k}") for k in by)
        outcome = (
            F.when(mine.isNotNull(), F.when(mine["contentHash"] == F.col("contentHash"), "duplicate").otherwise("conflict"))
            .when(first["client"] & same.isNotNull(), "duplicate")
            .when(first["client"] & first["content"] & run.isNotNull(), "conflict")
            .when(first["client"] & first["content"] & first["run"], "created")
        )
        counted = F.when(mine.isNotNull(), F.when(mine["contentHash"] == F.col("contentHash"), mine["submissionId"])).otherwise(same["submissionId"])
        judged = stored(met.select(*names, "_i", "_at", outcome.alias("outcome"), counted.alias("countedId")))
        settled.append(judged.where("outcome is not null").select(*names, "outcome", F.coalesce("countedId", "submissionId").alias("countedId")))
        pending = judged.where("outcome is null").select(*names, "_i", "_at")
        if pending.isEmpty():
            return reduce(DataFrame.unionAll, settled)
        known = stored(known.unionAll(judged.where("outcome = 'created'").select(*names, "_at")).coalesce(1 << 6))


def index_keys() -> Column:
    """What a submission may clash in: its client, its content and its run, as an array of (k, v)."""
    entry = lambda kind, *c: F.struct(F.lit(kind).alias("k"), F.concat_ws("\t", *c).alias("v"))
    return F.array(entry("client", "ownerId", "clientRunId"), entry("content", "contentHash"), entry("run", "runId"))


def concerning(index: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of the index that a batch can meet: those of its clients, contents or runs. One pass over the index."""
    wanted = batch.select(F.explode(index_keys()).alias("key")).distinct()
    return index.withColumn("key", F.explode(index_keys())).join(wanted, "key", "left_semi").drop("key").distinct()


def windowed_counts(events: DataFrame, time: str, key: Sequence[str], late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event-time counts of a stream (or a table) with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *key).agg(F.count("*").alias("n"))


def patch_line(line: str, kept: dict[int, object]) -> str:
    """One line of a response. kept holds the output items so far; a final event without output gets them."""
    if not line.startswith("data:"):
        return line
    try:
        event = json.loads(line[5:])
    except ValueError:
        return line
    if not isinstance(event, dict):
        return line
    if event.get("type") == "response.output_item.done":
        kept[event.get("output_index", len(kept))] = event.get("item")
    if event.get("type") == "response.completed":
        if isinstance(event.get("response"), dict) and not event["response"].get("output"):
            event["response"]["output"] = [kept[i] for i in sorted(kept)]
            line = "data: " + json.dumps(event, ensure_ascii=False, separators=(",", ":"))
        kept.clear()
    return line


def patch_final(items: list[str]) -> list[str]:
    """T09 on one response, in order."""
    kept: dict[int, object] = {}
    return [patch_line(line, kept) for line in items]


def patch_lines(lines: DataFrame, key: str = "response", seq: str = "seq", line: str = "line") -> DataFrame:
    """T09 on tables: the lines of each response, in order, patched. A response is one unit of work."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq, kind="stable")
        return pdf.assign(**{line: patch_final(pdf[line].tolist())})

    return lines.select(key, seq, line).groupBy(key).applyInPandas(run, lines.select(key, seq, line).schema)


def patch_stream(lines: DataFrame, time: str | None = None, idle: str = "1 hour") -> DataFrame:
    """T09 on streams (response, seq, line): output items are kept in state until their response's final event.

    Every line is parsed once. State goes at the final event. With a time column (null times don't count), the state of
    a response also goes once the watermark has passed its last line by idle; without one, that of a response that
    never ends stays. Event time is used since a timeout by the clock would keep a query over what is available from
    ever ending.
    """
    quiet = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = {int(k): v for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = [patch_line(line, kept) for line in rows.line]
        if kept:
            state.update((json.dumps(kept),))
            if time:
                last = rows[time].max()
                seen = state.getCurrentWatermarkMs()
                state.setTimeoutTimestamp(max(seen + 1, seen if pd.isna(last) else int(last.timestamp() * 1000)) + quiet)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"response": [key[0]] * len(out), "seq": rows.seq.to_numpy(), "line": out})

    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    timed = lines.withWatermark(time, idle) if time else lines
    return timed.groupBy("response").applyInPandasWithState(run, "response string, seq long, line string", "held string", "append", timeout)
