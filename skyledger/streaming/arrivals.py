"""A store that is still being filled. A trial counts once all rounds that it declares have arrived.

Files of rounds arrive in a folder per run, in any order and possibly again; the run is the folder's name, whatever a
row says. What has come of a trial is kept in state until it is whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROUND = "trialId string, round int, rounds int, passed boolean"
TRIAL = "runId string, trialId string, rounds long, firstPassed boolean, finalPassed boolean, outcome string"


def arriving_rounds(spark: SparkSession, root: str, *, files: int = 100) -> DataFrame:
    """The rounds (runId and ROUND) of JSON-lines files below root/<runId>/ or root/<key>=<runId>/ as a stream, so many
    files at a time.

    Lines that don't parse, and rounds without a trial, a number or a declared count that holds it, are left out.
    """
    lines = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).text(root)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:[^/=]+=)?([^/]+)/[^/]+$", 1)
    rows = lines.select(F.url_decode(run).alias("runId"), F.from_json("value", ROUND).alias("r")).select("runId", "r.*")
    return rows.where("trialId is not null and round >= 0 and rounds > round")


def complete_trials(rounds: DataFrame, *, together: int | None = None) -> DataFrame:
    """TRIAL rows of a stream (or what came of one), each when the last of its rounds comes.

    outcome: complete, or conflict if rounds of the trial contradict each other (another result for a round that was
    there, another declared count; the first of each counts). Rounds are numbered from 0; a round that comes again with
    the same result changes nothing while the trial is open. A null passed is not passed. Open trials stay in state.

    together: a run's trials are held in so many parts by hash, a state each, as a call of Python per trial costs more
    than the trial's work; None is a state per trial.
    """

    names = [c.split(" ")[0] for c in TRIAL.split(", ")]

    def take(held: dict, n: int, declared: int, passed: bool | None) -> None:
        passed = bool(passed) if passed is not None and passed == passed else False
        held["rounds"] = held["rounds"] or declared
        held["odd"] |= held["rounds"] != declared or held["seen"].setdefault(str(n), passed) != passed

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trials = json.loads(state.get[0]) if state.exists else {}
        for batch in batches:
            for trial, n, declared, passed in zip(*(batch[c].tolist() for c in ("trialId", "round", "rounds", "passed")), strict=True):
                take(trials.setdefault(trial, {"rounds": None, "seen": {}, "odd": False}), n, declared, passed)
        out = []
        for trial, held in list(trials.items()):
            if len(held["seen"]) >= held["rounds"] and all(str(n) in held["seen"] for n in range(held["rounds"])):
                last = held["seen"][str(held["rounds"] - 1)]
                out.append((key[0], trial, held["rounds"], held["seen"]["0"], last, "conflict" if held["odd"] else "complete"))
                del trials[trial]
        if trials:
            state.update((json.dumps(trials),))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    if together is None:
        return rounds.groupBy("runId", "trialId").applyInPandasWithState(run, TRIAL, "held string", "append", GroupStateTimeout.NoTimeout)
    keyed = rounds.withColumn("_part", F.pmod(F.xxhash64("trialId"), F.lit(together)))
    return keyed.groupBy("runId", "_part").applyInPandasWithState(run, TRIAL, "held string", "append", GroupStateTimeout.NoTimeout)
