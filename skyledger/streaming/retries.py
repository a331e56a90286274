"""Bounded chains of attempts as a running process, one small state per open chain or per part of the chains.

A chain is over at its first pass, or when its budget is spent; then its row is emitted and its state goes. A chain that
hears nothing for a while is given up by a timer on event time. Until then it holds what it has seen, so its state is
empty once all chains are over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHAIN = "chain string, attempts long, firstPassed boolean, lastPassed boolean, everPassed boolean, passedAt long, recoveriesUsed long, outcome string"


class RetryMachine:
    """The chains of a state, one or many: what comes of them moves them on, and their rows are emitted when they end.

    Attempts are counted from 1. One that comes before its predecessor waits; one that comes again changes nothing.

    outcome: passed, exhausted (budget retries were used and none passed) or abandoned (silence for idle seconds of
    event time, with the attempts that had come in order until then).
    """

    def __init__(self, budget: int, idle: float):
        self.budget, self.idle = budget, int(idle * 1000)

    @staticmethod
    def _row(chain: str | None, attempts: int, first: bool | None, passed: bool, outcome: str) -> tuple:
        return chain, attempts, first, passed if attempts else None, passed, attempts if passed else None, max(0, attempts - 1), outcome

    def run(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """An open chain is [next attempt, whether the first passed, when it is given up (ms), waiting attempts]."""
        now, out = state.getCurrentWatermarkMs(), []
        chains = {c: [at, first, end, dict(waiting)] for c, at, first, end, waiting in json.loads(state.get[0])} if state.exists else {}
        if not state.hasTimedOut:
            touched = set()
            for batch in batches:
                for chain, attempt, passed, at in zip(*(batch[c].tolist() for c in ("chain", "attempt", "passed", "_ms")), strict=True):
                    held = chains.setdefault(chain, [1, None, now + self.idle, {}])
                    if attempt >= held[0]:
                        held[3].setdefault(attempt, passed)
                    held[2] = max(held[2], now + self.idle, int(at) + self.idle if at == at else 0)
                    touched.add(chain)
            for chain in touched:
                if row := self._move(chain, chains[chain]):
                    out.append(row)
                    del chains[chain]
        for chain in [c for c, held in chains.items() if held[2] < now]:
            at, first, *_ = chains.pop(chain)
            out.append(self._row(chain, at - 1, first, False, "abandoned"))
        if chains:
            state.update((json.dumps([[c, *held[:3], list(held[3].items())] for c, held in chains.items()]),))
            state.setTimeoutTimestamp(min(held[2] for held in chains.values()))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CHAIN.split(", ")]).astype({"attempts": "int64", "passedAt": "Int64", "firstPassed": "boolean", "lastPassed": "boolean"})

    def _move(self, chain: str | None, held: list) -> tuple | None:
        """Take the attempts that are in order; the chain's row if it ends."""
        waiting = held[3]
        while held[0] in waiting:
            at, passed = held[0], waiting.pop(held[0])
            held[1] = passed if at == 1 else held[1]
            if passed or at > self.budget:
                return self._row(chain, at, held[1], passed, "passed" if passed else "exhausted")
            held[0] += 1
        return None


def retry_stream(attempts: DataFrame, *, budget: int, idle: str = "1 hour", late: str = "0 seconds", together: int | None = None) -> DataFrame:
    """CHAIN rows of a stream of attempts (chain, attempt from 1, passed, at), each when its chain ends.

    at is event time and not null; late is how far out of order it may come. Open chains that don't fit in memory need a
    session that keeps state in RocksDB (use_rocks()). Attempts after a chain's end have no state to meet; they open it
    anew and are given up by the timer with no attempt in order (attempts 0), so a source should not run them.

    together: chains are held in so many parts by hash, a state each, with a timer for its earliest silence, as a call of
    Python per chain costs far more than the chain's work. A batch reads and writes the open chains of every part that
    it touches, so small batches over very many open chains want more parts; None is a state per chain.
    """
    seconds = pd.Timedelta(idle).total_seconds()
    rows = attempts.select("chain", F.col("attempt").cast("long").alias("attempt"), F.coalesce("passed", F.lit(False)).alias("passed"), "at", F.unix_millis("at").alias("_ms")).withWatermark("at", late)
    by = "chain"
    if together is not None:
        by, rows = "_part", rows.withColumn("_part", F.pmod(F.xxhash64("chain"), F.lit(together)))
    return rows.groupBy(by).applyInPandasWithState(RetryMachine(budget, seconds).run, CHAIN, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def use_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def bounded_chains(attempts: DataFrame, *, budget: int) -> DataFrame:
    """The same of a table whose attempts all are there: chains that pass or spend their budget, with what was used of them."""
    rows = attempts.select("chain", F.col("attempt").cast("long").alias("attempt"), F.coalesce("passed", F.lit(False)).alias("passed")).where(F.col("attempt") <= budget + 1)
    before = F.coalesce(F.max("passed").over(Window.partitionBy("chain").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    used = rows.withColumn("_over", before).where(~F.col("_over"))
    ever = F.max("passed")
    done = used.groupBy("chain").agg(
        F.count("*").alias("attempts"), F.min_by("passed", "attempt").alias("firstPassed"), F.max_by("passed", "attempt").alias("lastPassed"), ever.alias("everPassed"),
        F.min(F.when(F.col("passed"), F.col("attempt"))).alias("passedAt"), (F.count("*") - 1).alias("recoveriesUsed"),
        F.when(ever, "passed").when(F.count("*") > budget, "exhausted").alias("outcome"),
    )
    return done.where("outcome is not null")
