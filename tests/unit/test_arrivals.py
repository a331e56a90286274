"""Trials of a store that is being filled: whole ones once, whatever the order in which their rounds come."""

import json
import os
import random

from skyledger.streaming.arrivals import arriving_rounds, complete_trials


def test_trials_count_once_they_are_whole(spark, tmp_path):
    rng = random.Random(3)
    rows, want = [], {}
    for run in ("run-a", "run b"):
        for t in range(25):
            n = rng.randint(1, 4)
            passes = [rng.random() < 0.5 for _ in range(n)]
            mine = [(run, {"trialId": f"t{t}", "round": i, "rounds": n, "passed": p, "runId": "another"}) for i, p in enumerate(passes)]
            if t % 6 == 5:
                mine.pop(rng.randrange(n))  # never whole
            else:
                want[run, f"t{t}"] = (n, passes[0], passes[-1], "complete")
            if t == 3 and n > 1:
                mine.insert(1, (run, mine[0][1] | {"passed": not passes[0]}))
            rows += mine
    waves = [[], [], [], []]
    for i, row in enumerate(rows):
        waves[3 - i % 4 if row[1]["trialId"] != "t3" else i % 4].append(row)
    waves = [wave + [row for row in wave if row[1]["trialId"].endswith("1")] for wave in waves]  # some come twice
    for k, wave in enumerate(waves):
        for run in ("run-a", "run b"):
            (tmp_path / "store" / run).mkdir(parents=True, exist_ok=True)
            path = tmp_path / "store" / run / f"wave-{k}.jsonl"
            path.write_text("".join(json.dumps(r) + "\n" for o, r in wave if o == run) + 'garbage\n{"trialId": "x", "round": 3, "rounds": 3}\n{}\n')
            os.utime(path, (1_700_000_000 + k,) * 2)
    stream = complete_trials(arriving_rounds(spark, str(tmp_path / "store"), files=2))
    query = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = [((r.runId, r.trialId), (r.rounds, r.firstPassed, r.finalPassed, r.outcome)) for r in spark.table("arrived").collect()]
    assert len(got) == len(dict(got)) == len(want) and {k for k, _ in got} == set(want)
    assert {k: v for k, v in got if k[1] != "t3"} == {k: v for k, v in want.items() if k[1] != "t3"}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == len({(o, r["trialId"]) for o, r in rows} - set(want)) > 0  # the trials that are not whole


def test_parts_of_a_run_hold_many_trials(spark, tmp_path):
    """Far fewer states than trials, which are whole across two batches; the open ones stay."""
    store = tmp_path / "store" / "r"
    store.mkdir(parents=True)
    for wave in (1, 0):
        path = store / f"{wave}.jsonl"
        path.write_text("".join(json.dumps({"trialId": f"t{t}", "round": wave, "rounds": 2 + (t == 7), "passed": wave == t % 2}) + "\n" for t in range(200)))
        os.utime(path, (1_700_000_000 - wave,) * 2)
    trials = complete_trials(arriving_rounds(spark, str(tmp_path / "store"), files=1), together=8)
    query = trials.writeStream.format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("parts").collect())
    assert got == sorted(("r", f"t{t}", 2, t % 2 == 0, t % 2 == 1, "complete") for t in range(200) if t != 7)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
