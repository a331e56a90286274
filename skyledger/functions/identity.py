"""Identity, ordering and hashing expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasoning modes in order: fixed values.
REASONING = ["off", "minimal", "low", "medium", "high", "xhigh", "max"]
#: Fields of a configuration that its hash covers, in order: fixed values.
HASHED = ["configurationId", "agentFamily", "agentVersion", "modelFamily", "modelVersion", "provider", "harnessFamily", "harnessVersion", "adapterVersion", "model", "thinking", "transport", "harnessKind", "tools", "extensions", "rules", "runtimeFlags", "environment", "configurationLabels"]


def canonical_model(value: Column) -> Column:
    """The last segment of a slash-separated name."""
    return F.element_at(F.split(value, "/"), -1)


def reasoning_rank(mode: Column) -> Column:
    """Position of the mode among known ones, from 0; null if unknown."""
    return F.nullif(F.array_position(F.array(*map(F.lit, REASONING)), mode), F.lit(0)) - 1


def canonical_policy(policy: Column) -> Column:
    """The rules of a run as JSON; concurrency is scheduling, not a rule."""
    kept = F.struct(*[policy[n].alias(n) for n in ("oracleRecoveries", "retryFailures", "timeoutMs")])
    return F.to_json(kept, {"ignoreNullFields": "false"})


def metric_average(total: Column, observations: Column) -> Column:
    """Total per observation, null without any."""
    return F.when(observations > 0, total / observations)


def badge_color(score: Column) -> Column:
    """P19. Colours and thresholds are fixed values."""
    return F.when(score.isNull(), "lightgrey").when(score >= 0.9, "brightgreen").when(score >= 0.75, "green").when(score >= 0.5, "yellow").when(score >= 0.25, "orange").otherwise("red")


def percent(part: Column, whole: Column, empty: Column | None = None) -> Column:
    """100 * part / whole; empty (null by default) for a zero whole."""
    return F.when(whole == 0, F.lit(None) if empty is None else empty).otherwise(F.try_divide(part * 100.0, whole))


def percent_text(part: Column, whole: Column) -> Column:
    """One decimal and a percent sign; an em dash for a zero whole."""
    value = percent(part, whole)
    return F.when(value.isNotNull(), F.concat(F.format_string("%.1f", value), F.lit("%"))).otherwise("—")


def version_key(version: Column, width: int = 20) -> Column:
    """A string whose order is that of versions. Numbers compare as numbers and before words; at the place where
    one version ends and the other goes on, the one that ends ranks higher."""
    part = lambda x: F.when(x.rlike(r"\A[0-9]+\z"), F.concat(F.lit("1"), F.lpad(F.regexp_replace(x, r"\A0+(?=[0-9])", ""), width, "0"))).otherwise(F.concat(F.lit("2"), x))
    return F.concat(F.array_join(F.transform(F.split(version, r"[.\-+]"), part), "\x01"), F.lit("\x01~"))


def natural_key(text: Column, width: int = 20) -> Column:
    """Lower case with runs of digits padded, so that 1.9 comes before 1.10; then the text itself for ties."""
    padded = F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1)), lambda x: F.when(x.rlike(r"\A[0-9]+\z"), F.lpad(x, width, "0")).otherwise(x)), "")
    return F.struct(padded, text)


def canonical_json(value: Column) -> Column:
    """JSON that keeps null fields; give structs with fields in alphabetical order for a stable hash."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def configuration_hash(df: DataFrame) -> Column:
    """sha256 of the JSON of the hashed fields that df has, in their fixed order."""
    return F.sha2(canonical_json(F.struct(*[c for c in HASHED if c in df.columns])), 256)


def file_record(path: Column, content: Column) -> Column:
    """Path, bytes and digest of a binary content."""
    return F.struct(path.alias("path"), F.octet_length(content).alias("bytes"), F.sha2(content, 256).alias("sha256"))


def line_ending_free_hash(text: Column) -> Column:
    """Digest of a text whose line ends are all LF."""
    return F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256)


def stable_hash(value: object) -> str:
    """X03 for driver-side values: sha256 of JSON with sorted keys."""
    import hashlib

    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def canonical_provider(df: DataFrame, aliases: DataFrame, *, family: str = "modelFamily", provider: str = "provider") -> DataFrame:
    """Provider replaced by its alias for the model; an alias may stand for a null provider.

    aliases: id, from, to. It is a registry: broadcast when Spark finds it small.
    """
    a = aliases.select(F.col("id").alias("_id"), F.col("from").alias("_from"), F.col("to").alias("_to"))
    joined = df.join(a, (df[family] == F.col("_id")) & df[provider].eqNullSafe(F.col("_from")), "left")
    return joined.withColumn(provider, F.coalesce("_to", provider)).drop("_id", "_from", "_to")


def canonical_route(df: DataFrame, routes: DataFrame, *, family: str = "modelFamily", version: str = "modelVersion", provider: str = "provider", model: str = "model") -> DataFrame:
    """P10: a route's selector becomes the model's canonical family, and version where that equals the selector too.

    routes: id, provider, selector. A model that names another provider before its slash stays as it is.
    """
    r = routes.select(F.col("id").alias("_id"), F.col("provider").alias("_provider"), F.col("selector").alias("_selector"))
    own = ~F.col(model).contains("/") | F.col(model).startswith(F.concat(F.col("_provider"), F.lit("/")))
    joined = df.join(r, (df[provider] == F.col("_provider")) & (canonical_model(df[family]) == F.col("_selector")) & F.coalesce(own, F.lit(True)), "left")
    renamed = joined.withColumn("_v", F.when(F.col("_id").isNotNull() & (canonical_model(F.col(version)) == F.col("_selector")), F.col("_id")).otherwise(F.col(version)))
    return renamed.withColumn(family, F.coalesce("_id", family)).withColumn(version, F.col("_v")).drop("_v", "_id", "_provider", "_selector")


def project_models(profiles: DataFrame, aliases: DataFrame, routes: DataFrame) -> DataFrame:
    """Both projections; configurationHash is computed anew only for rows that changed."""
    kept = ["modelFamily", "modelVersion", "provider"]
    before = profiles.withColumns({f"_was_{c}": F.col(c) for c in kept})
    after = canonical_provider(canonical_route(before, routes), aliases)
    changed = ~F.lit(True)
    for c in kept:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_was_{c}"))
    return after.withColumn("configurationHash", F.when(changed, configuration_hash(after)).otherwise(F.col("configurationHash"))).drop(*[f"_was_{c}" for c in kept])


def attribute_runs(runs: DataFrame, contributors: DataFrame) -> DataFrame:
    """submittedBy from the registry (runId, submittedBy), only where a run has none."""
    c = contributors.select("runId", F.col("submittedBy").alias("_by"))
    return runs.join(c, "runId", "left").withColumn("submittedBy", F.coalesce("submittedBy", "_by")).drop("_by")


def literal_map(values: Mapping[str, str], key: Column, missing: Column | None = None) -> Column:
    """Dictionary lookup; missing (null by default) for other keys. P04, P26, P37."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = F.element_at(table, key) if values else F.lit(None).cast("string")
    return found if missing is None else F.coalesce(found, missing)


def split_suffix(name: Column, suffixes: Sequence[str]) -> Column:
    """P25: the first listed suffix that ends the name, and what stands before; raises if there is none."""
    out = F.raise_error(F.concat(F.lit("unknown profile: "), name)).cast("struct<head:string,suffix:string>")
    for s in reversed(suffixes):
        out = F.when(name.endswith(f"-{s}"), F.struct(F.substring(name, F.lit(1), F.length(name) - len(s) - 1).alias("head"), F.lit(s).alias("suffix"))).otherwise(out)
    return out


def execution_id(**fields: Column) -> Column:
    """sha256 of the canonical JSON of named values, by name; lists count as sets."""
    return F.sha2(canonical_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def as_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def feedback(comparison: Column) -> Column:
    """What an oracle tells after a failed round, as JSON: counts and names, never contents."""
    return canonical_json(F.struct(*[comparison[c].alias(c) for c in ("differing", "missing", "unexpected")]))


def projection_audit(before: DataFrame, after: DataFrame, rounds: DataFrame, trials: DataFrame, columns: Sequence[str] = ("modelFamily", "modelVersion", "provider")) -> DataFrame:
    """Profiles that a projection changed, with tokens and cost of their rounds (null if never observed)."""
    key = ["runId", "profileId"]
    old = before.select(*key, *[F.col(c).alias(f"{c}Before") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"{c}Before"))
    changed = after.select(*key, *columns).join(old, key).where(differs)
    used = rounds.join(trials.select("runId", "trialId", "profileId"), ["runId", "trialId"]).groupBy(*key).agg(F.sum("totalTokens").alias("totalTokens"), F.sum("costUsd").alias("costUsd"))
    return changed.join(used, key, "left")


def zip_by_position(arrays: Mapping[str, Column], df: DataFrame) -> DataFrame:
    """Arrays of equal length side by side, with their position; a length that differs shows as nulls."""
    return df.select(F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])).alias("position", "z")).select("position", *[F.col(f"z.{n}").alias(n) for n in arrays])
