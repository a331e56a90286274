"""Constraints over evidence: every check gives violation rows (rule, key, message); require() fails fast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger import schema
from skyledger.evidence import Evidence
from skyledger.functions.classify import sensitive
from skyledger.operators.families import union_all


def violations(rows: DataFrame, rule: str, key: Column, message: Column | str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def require(found: DataFrame) -> None:
    """Raise on the first violations."""
    bad = found.limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule} {r.key}: {r.message}" for r in bad))


def exact_keys(lines: DataFrame, columns: Sequence[str], optional: Sequence[str] = (), text: str = "value") -> DataFrame:
    """JSON lines whose top-level keys aren't exactly the columns (optional ones may be absent)."""
    keys = F.json_object_keys(F.col(text))
    must, may = F.array(*map(F.lit, columns)), F.array(*map(F.lit, [*columns, *optional]))
    bad = keys.isNull() | (F.size(F.array_except(must, keys)) > 0) | (F.size(F.array_except(keys, may)) > 0)
    return violations(lines.where(bad), "V01 exact keys", F.substring(text, 1, 80), F.coalesce(F.array_join(keys, ","), F.lit("not a JSON object")))


def scalar_types(lines: DataFrame, kinds: Mapping[str, str], text: str = "value") -> DataFrame:
    """Fields of JSON lines of another kind than declared.

    Kinds: string, string?, boolean, count (integer from 0), count?, number? (finite).
    """
    parsed = lines.select(F.col(text).alias("_text"), F.try_parse_json(text).alias("_v"))
    kept = [c for i, name in enumerate(kinds) for c in (F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant")).alias(f"_t{i}"), F.try_variant_get("_v", f"$.{name}", "double").alias(f"_n{i}"))]
    found = []
    for i, (name, kind) in enumerate(kinds.items()):
        t, number, base = F.col(f"_t{i}"), F.col(f"_n{i}"), kind.rstrip("?")
        ok = {"string": t == "STRING", "boolean": t == "BOOLEAN", "count": (t == "BIGINT") & (number >= 0), "number": t.rlike("BIGINT|DOUBLE|DECIMAL|FLOAT") & (F.abs(number) < float("inf"))}[base]
        ok = F.coalesce(ok, F.lit(False)) | (t.isNull() | (t == "VOID") if kind.endswith("?") else F.lit(False))
        found.append(F.when(~ok, F.lit(f"{name} must be {kind}")))
    # exploded, not filtered: a filter would move below the projection and parse every line again, for each field
    message = F.explode(F.filter(F.array(F.concat_ws("; ", *found)), lambda x: x != "")).alias("_b")
    return violations(parsed.select("_text", *kept).select("_text", message), "V02 types", F.substring("_text", 1, 80), F.col("_b"))


LABEL = r"\A[a-zA-Z0-9][a-zA-Z0-9._/-]*\z"


def list_constraints(rows: DataFrame, key: Column, column: str, pattern: str | None = None, longest: int = 300) -> DataFrame:
    """Lists must be sorted and unique, with entries that are not empty, not too long, and match pattern."""
    entry = lambda x: x.isNotNull() & (x != "") & (F.length(x) <= longest) & (x.rlike(pattern) if pattern else F.lit(True))
    bad = (F.size(F.array_distinct(column)) != F.size(column)) | (F.array_sort(column) != F.col(column)) | ~F.forall(column, entry)
    return violations(rows.where(bad), f"V03 {column}", key, F.to_json(F.col(column)))


def enum_members(rows: DataFrame, key: Column, column: str, allowed: Sequence[str], nullable: bool = False) -> DataFrame:
    """V04."""
    bad = ~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)) & (F.col(column).isNotNull() if nullable else F.lit(True))
    return violations(rows.where(bad), f"V04 {column}", key, F.coalesce(F.col(column), F.lit("null")))


def row_checks(rows: DataFrame, key: Column, checks: Mapping[str, Column]) -> DataFrame:
    """Rows that break any check; a check that is null is not broken. All checks in one pass."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]))
    return rows.withColumn("_r", F.explode(broken)).select(F.col("_r").alias("rule"), key.cast("string").alias("key"), F.lit("check failed").alias("message"))


def token_checks() -> dict[str, Column]:
    """Token parts all or none and summing to the total; failures within calls; outcome flags agree."""
    parts = [F.col(c) for c in ("inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens")]
    seen = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    total = F.col("totalTokens")
    return {
        "V05 all or none": seen.isin(0, 4), "V05 total": (seen == 4) == total.isNotNull(), "V05 sum": total == parts[0] + parts[1] + parts[2] + parts[3], "V06 failed": F.col("failedToolCalls") <= F.col("toolCallCount"), "V06 invalid": F.col("invalidToolCalls") <= F.col("failedToolCalls"), "V06 cost": F.col("costUsd") >= 0,
        "V06 exact": F.col("exactPassed") == (F.col("difference") == "pass"), "V06 normalized": F.col("normalizedPassed") == (F.col("exactPassed") | (F.col("difference") == "eof")),
    }


def duplicates(rows: DataFrame, key: Sequence[str], rule: str = "V09 unique") -> DataFrame:
    """Keys that repeat."""
    found = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    return violations(found, rule, F.concat_ws("/", *[F.col(k).cast("string") for k in key]), F.concat(F.col("_n").cast("string"), F.lit(" rows")))


def orphans(rows: DataFrame, parent: DataFrame, on: Mapping[str, str], rule: str = "V07 reference", key: Column | None = None) -> DataFrame:
    """Rows without parent. on maps columns of rows to columns of parent."""
    p = parent.select(*[F.col(v).alias(f"_p{i}") for i, v in enumerate(on.values())]).distinct()
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & (rows[c] == p[f"_p{i}"])
    return violations(rows.join(p, cond, "left_anti"), rule, key if key is not None else F.concat_ws("/", *[F.col(c).cast("string") for c in on]), "no parent row")


def gaps(rows: DataFrame, group: Sequence[str], ordinal: str, order: Sequence[str] = (), rule: str = "O02 contiguous") -> DataFrame:
    """Rows whose ordinal isn't their position (from 0) in the group; implies uniqueness."""
    w = Window.partitionBy(*group).orderBy(ordinal, *order)
    found = rows.withColumn("_at", F.row_number().over(w) - 1).where(F.col("_at") != F.col(ordinal))
    return violations(found, rule, F.concat_ws("/", *[F.col(c).cast("string") for c in group]), F.concat(F.lit("position "), F.col("_at").cast("string"), F.lit(" has "), F.col(ordinal).cast("string")))


def trial_agreement(trials: DataFrame, rounds: DataFrame) -> DataFrame:
    """Trials that disagree with their rounds: their number, first and last outcome, infrastructure failures."""
    per = rounds.groupBy("runId", "trialId").agg(F.count("*").alias("n"), F.min_by("exactPassed", "round").alias("f"), F.max_by("exactPassed", "round").alias("l"))
    joined = trials.join(per, ["runId", "trialId"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    no = F.lit(False)
    checks = {"V08 rounds": F.col("rounds") == F.col("n"), "V08 first": F.coalesce("firstExactPassed", no) == F.coalesce("f", no), "V08 final": F.coalesce("finalExactPassed", no) == F.coalesce("l", no), "V08 infrastructure": F.col("infrastructureFailure").isNull() == (F.col("n") > 0)}
    return row_checks(joined, F.concat_ws("/", "runId", "trialId"), checks)


def call_agreement(rounds: DataFrame, calls: DataFrame) -> DataFrame:
    """Rounds whose recorded number of calls isn't that of their call rows, or unobserved rounds with calls."""
    per = calls.groupBy("runId", "roundId").agg(F.count("*").alias("n"))
    joined = rounds.join(per, ["runId", "roundId"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    observed = F.coalesce("toolCallsObserved", F.lit(False))
    return row_checks(joined, F.concat_ws("/", "runId", "roundId"), {"V10 count": ~observed | (F.col("toolCallCount") == F.col("n")), "V10 unobserved": observed | (F.col("n") == 0)})


def profile_agreement(trials: DataFrame, profiles: DataFrame) -> DataFrame:
    """Trials that name another model or harness than their profile."""
    p = profiles.select("runId", "profileId", F.col("modelId").alias("_m"), F.col("harnessId").alias("_h"))
    return row_checks(trials.join(p, ["runId", "profileId"]), F.concat_ws("/", "runId", "trialId"), {"V07 model": F.col("modelId").eqNullSafe(F.col("_m")), "V07 harness": F.col("harnessId").eqNullSafe(F.col("_h"))})


def sensitive_rows(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """V13, F11."""
    return violations(rows.where(sensitive(text)), "V13 sensitive", key, "possible credential or machine-local path")


def changed_rows(before: DataFrame, after: DataFrame, allowed: Sequence[str] = (), rule: str = "V17 unchanged") -> DataFrame:
    """Rows that differ in other columns than the allowed ones, as multisets, both ways."""
    a, b = before.drop(*allowed), after.drop(*allowed)
    lost, new = a.exceptAll(b.select(a.columns)), b.select(a.columns).exceptAll(a)
    return violations(lost, rule, F.to_json(F.struct("*")), "gone").unionByName(violations(new, rule, F.to_json(F.struct("*")), "new"))


def misaligned(left: DataFrame, right: DataFrame, key: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Keys on one side only, or with different values of the given columns."""
    a = left.select(*key, F.struct(*same).alias("_l"), F.lit(True).alias("_a"))
    b = right.select(*key, F.struct(*same).alias("_r"), F.lit(True).alias("_b"))
    joined = a.join(b, list(key), "full_outer")
    bad = joined.where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("_l").eqNullSafe(F.col("_r")))
    what = F.when(F.col("_a").isNull(), "only right").when(F.col("_b").isNull(), "only left").otherwise("differs")
    return violations(bad, "V20 aligned", F.concat_ws("/", *[F.col(k).cast("string") for k in key]), what)


def compare_files(actual: DataFrame, expected: DataFrame, key: Sequence[str], path: str = "path", content: str = "content") -> DataFrame:
    """Differing, unexpected and missing files of each key, and whether both are exactly the same.

    Contents are compared as they are, byte for byte if binary.
    """
    a = actual.select(*key, path, F.col(content).alias("_a"), F.lit(True).alias("_ia"))
    e = expected.select(*key, path, F.col(content).alias("_e"), F.lit(True).alias("_ie"))
    joined = a.join(e, [*key, path], "full_outer")
    both = F.col("_ia").isNotNull() & F.col("_ie").isNotNull()
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(path))))
    rows = joined.groupBy(*key).agg(pick(both & ~F.col("_a").eqNullSafe(F.col("_e"))).alias("differing"), pick(F.col("_ie").isNull()).alias("unexpected"), pick(F.col("_ia").isNull()).alias("missing"))
    return rows.withColumn("exact", (F.size("differing") + F.size("unexpected") + F.size("missing")) == 0)


def manifest_counts(evidence: Evidence) -> DataFrame:
    """One row of table counts and completeness, to compare with a manifest."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    rounds = evidence.rounds.agg(F.count("*").alias("rounds"), F.count_if(F.coalesce("difference", F.lit("unknown")) == "unknown").alias("unknownDifferences"), F.count_if(~F.coalesce("toolCallsObserved", F.lit(False))).alias("unobservedToolCallRounds"))
    return n(evidence.profiles, "profiles").crossJoin(n(evidence.trials, "trials")).crossJoin(rounds).crossJoin(n(evidence.tool_calls, "toolCalls"))


def validate(evidence: Evidence) -> DataFrame:
    """V04-V10 over a whole evidence."""
    e, at = evidence, lambda *c: F.concat_ws("/", *c)
    return union_all([
        duplicates(e.profiles, ["runId", "profileId"], "V09 profiles"), duplicates(e.trials, ["runId", "trialId"], "V09 trials"), duplicates(e.rounds, ["runId", "roundId"], "V09 rounds"), duplicates(e.tool_calls, ["runId", "roundId", "ordinal"], "V09 tool calls"),
        orphans(e.trials, e.profiles, {"runId": "runId", "profileId": "profileId"}, "V07 trials"), orphans(e.rounds, e.trials, {"runId": "runId", "trialId": "trialId"}, "V07 rounds"), orphans(e.tool_calls, e.rounds, {"runId": "runId", "roundId": "roundId"}, "V07 tool calls"),
        profile_agreement(e.trials, e.profiles), trial_agreement(e.trials, e.rounds), call_agreement(e.rounds, e.tool_calls), gaps(e.rounds, ["runId", "trialId"], "round"), gaps(e.tool_calls, ["runId", "roundId"], "ordinal"),
        enum_members(e.rounds, at("runId", "roundId"), "difference", schema.DIFFERENCES), enum_members(e.rounds, at("runId", "roundId"), "providerFailure", ["rate-limit"], True), enum_members(e.tool_calls, at("runId", "roundId"), "category", schema.CATEGORIES), enum_members(e.tool_calls, at("runId", "roundId"), "outcome", schema.OUTCOMES, True),
        row_checks(e.rounds, at("runId", "roundId"), token_checks()),
    ])


def registry_checks(models: DataFrame, routes: DataFrame) -> DataFrame:
    """Model ids and routes are unique, names aren't empty."""
    return union_all([duplicates(models, ["id"], "V16 model"), duplicates(routes, ["provider", "selector"], "V16 route"), row_checks(models, F.col("id"), {"V16 id": F.col("id").rlike(LABEL)})])


HEX64 = r"\A[0-9a-f]{64}\z"


def exclusion_checks(decisions: DataFrame) -> DataFrame:
    """Decisions of an exclusion policy: unique ids, known status and scope, a reason, a revision, and a selector
    that names one configuration by hash or one package by name, version and digest, nothing wider.

    decisions: id, status, scope, reason, decisionRevision, selector (kind, configurationHash, name, version, digestSha256).
    """
    s = F.col("selector")
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    none = lambda *names: F.coalesce(*[s[n] for n in names]).isNull()
    configuration = (s["kind"] == "configuration") & s["configurationHash"].rlike(HEX64) & none("name", "version", "digestSha256")
    package = (s["kind"] == "package") & filled(s["name"]) & filled(s["version"]) & s["digestSha256"].rlike(HEX64) & none("configurationHash")
    exact = F.coalesce(configuration, F.lit(False)) | F.coalesce(package, F.lit(False))
    checks = {
        "V15 id": F.coalesce(F.col("id").rlike(LABEL), F.lit(False)), "V15 status": F.coalesce(F.col("status").isin("active", "withdrawn"), F.lit(False)), "V15 scope": F.col("scope").eqNullSafe("canonical-comparisons"), "V15 reason": filled(F.trim("reason")),
        "V15 revision": F.coalesce(F.col("decisionRevision").rlike(r"\A[0-9a-f]{40}\z"), F.lit(False)), "V15 selector": exact,
    }
    return union_all([duplicates(decisions, ["id"], "V15 unique"), row_checks(decisions, F.col("id"), checks)])


def policy_revision(decisions: DataFrame, order: str = "position") -> DataFrame:
    """One row, the digest of a policy's decisions in their order. A policy is one document."""
    fields = [c for c in decisions.columns if c != order]
    entry = F.struct(F.col(order).alias("k"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("v"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["v"]), ",")
    return decisions.agg(F.count("*").alias("decisions"), F.sha2(F.concat(F.lit("["), text, F.lit("]")), 256).alias("revision"))


def preserved_runs(current: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Runs of the current index that a rebuild would drop, or whose manifest it would change."""
    new = rebuilt.select("runId", F.col("manifestSha256").alias("_new"), F.lit(True).alias("_there")).dropDuplicates(["runId"])
    rows = current.select("runId", "manifestSha256").join(new, "runId", "left")
    changed = F.coalesce(F.col("manifestSha256") != "", F.lit(False)) & ~F.col("manifestSha256").eqNullSafe(F.col("_new"))
    what = F.when(F.col("_there").isNull(), "dropped").when(changed, "changed")
    return violations(rows.where(what.isNotNull()), "J23 preserved", F.col("runId"), what)


#: Fields without which an identity is not public, and lists that must be there even if empty: fixed values.
IDENTITY_FIELDS = ["agentFamily", "agentVersion", "modelFamily", "modelVersion", "harnessFamily", "adapterVersion"]
METADATA_LISTS = ["tools", "extensions", "rules", "runtimeFlags", "environment"]


def identity_completeness(configurations: DataFrame, key: Column) -> DataFrame:
    """Configurations that lack an identity field, or a metadata list (a missing list is not an empty one)."""
    there = {f"V23 {c}": F.coalesce(F.col(c) != "", F.lit(False)) for c in IDENTITY_FIELDS}
    lists = {f"V23 {c}": F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull()) for c in [*METADATA_LISTS, "configurationLabels"]}
    return row_checks(configurations, key, there | {n: F.coalesce(c, F.lit(False)) for n, c in lists.items()})


def recomputed_manifest(evidence: Evidence, manifest: DataFrame) -> DataFrame:
    """Fields of a manifest (runId, field, value) that the evidence itself doesn't give.

    Recomputed are the counts of profiles, trials, rounds and calls, passes of the first and last round, and the hashes of
    the verifier and of the task set.
    """
    e = evidence
    count = lambda df, name: df.groupBy("runId").agg(F.count("*").cast("string").alias("value")).select("runId", F.lit(name).alias("field"), "value")
    passes = lambda c: e.trials.groupBy("runId").agg(F.count_if(F.coalesce(c, F.lit(False))).cast("string").alias("value")).select("runId", F.lit(c).alias("field"), "value")
    named = lambda c: e.runs.select("runId", F.lit(c).alias("field"), F.col(c).alias("value"))
    known = union_all([count(e.profiles, "profiles"), count(e.trials, "trials"), count(e.rounds, "rounds"), count(e.tool_calls, "toolCalls"), passes("firstExactPassed"), passes("finalExactPassed"), named("verifierSha256"), named("taskSetSha256")])
    return misaligned(known, manifest, ["runId", "field"], ["value"])


def smoke_gate(trials: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles without exactly one trial, or whose trial failed."""
    per = trials.groupBy("runId", "profileId").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("finalExactPassed", F.lit(False))).alias("ok"))
    joined = profiles.select("runId", "profileId").join(per, ["runId", "profileId"], "left")
    return row_checks(joined, F.concat_ws("/", "runId", "profileId"), {"V24 one trial": F.coalesce("n", F.lit(0)) == 1, "V24 passed": F.coalesce("ok", F.lit(False))})


def declared_tasks(trials: DataFrame, runs: DataFrame) -> DataFrame:
    """Trials of tasks that their run didn't declare."""
    declared = runs.select("runId", F.explode("definitions.taskSet.taskIds").alias("taskId"))
    return orphans(trials, declared, {"runId": "runId", "taskId": "taskId"}, "V14 task")


def layout(files: DataFrame, allowed: Sequence[str], path: str = "path") -> DataFrame:
    """Files whose name isn't allowed."""
    name = F.element_at(F.split(path, "/"), -1)
    return violations(files.where(~name.isin(list(allowed))), "V12 layout", F.col(path), "unexpected file")


def harness_versions(runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles whose harness version isn't declared by their run; undeclared harnesses and null versions pass."""
    declared = runs.select("runId", F.explode("definitions.harnesses").alias("h")).where("h.version is not null").groupBy("runId", F.col("h.id").alias("_id")).agg(F.collect_set("h.version").alias("versions"))
    joined = profiles.join(declared, (profiles["harnessId"] == F.col("_id")) & (profiles["runId"] == declared["runId"])).select(profiles["runId"], "profileId", "harnessVersion", "versions")
    return row_checks(joined, F.concat_ws("/", "runId", "profileId"), {"A54 version": F.array_contains("versions", F.col("harnessVersion"))})


def differences(cases: DataFrame, key: Sequence[str]) -> DataFrame:
    """Reviewed rounds as pass, eof or other; passed wins over eof.

    cases: key columns, rounds array of structs (roundId, passed, eof).
    """
    each = cases.select(*key, F.explode("rounds").alias("r"))
    return each.select(*key, F.col("r.roundId").alias("roundId"), F.when(F.col("r.passed"), "pass").when(F.col("r.eof"), "eof").otherwise("other").alias("difference"))
