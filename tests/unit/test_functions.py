import pytest
from pyspark.sql import functions as F

from skyledger.functions import classify as C
from skyledger.functions import identity as I
from skyledger.functions import text as X
from skyledger.operators import tasks as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'boolean' if isinstance(v, bool) else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).collect()[0].x


def test_versions(spark):
    versions = ["1.0.0-beta", "1.0.0", "1.0.1", "1.0", "1.2.9", "1.10.0"]
    df = spark.createDataFrame([(v,) for v in versions], "v string")
    assert [r.v for r in df.orderBy(I.version_key(F.col("v"))).collect()] == ["1.0.0-beta", "1.0.0", "1.0.1", "1.0", "1.2.9", "1.10.0"]


@pytest.mark.parametrize("a,b,kind", [("a\n", "a\n\n", "eof"), ("a\nb", "a\n\nb", "line-breaks"), (" a", "a", "ascii-layout"), ("a b", "a b", "other-text")])
def test_differences(spark, a, b, kind):
    flags = F.struct(X.only_eof(F.col("a"), F.col("b")).alias("onlyEof"), X.only_line_breaks(F.col("a"), F.col("b")).alias("onlyLineBreaks"), X.only_ascii_layout(F.col("a"), F.col("b")).alias("onlyAsciiLayout"))
    assert one(spark, C.difference_kind(F.lit(False), F.lit(False), F.array(flags)), a=a, b=b) == kind


def test_difference_precedence_and_windows(spark):
    none = F.array().cast("array<struct<onlyEof:boolean,onlyLineBreaks:boolean,onlyAsciiLayout:boolean>>")
    assert one(spark, C.difference_kind(F.lit(False), F.lit(False), none), a="") == "execution-only"
    assert one(spark, C.difference_kind(F.lit(False), F.lit(True), none), a="") == "file-set"
    got = one(spark, X.compare_text(F.col("a"), F.col("b")), a="x" * 100 + "😀1" + "y" * 100, b="x" * 100 + "😀2" + "y" * 100)
    assert got.firstDifference == 102 and got.actualLength == 203 and len(got.actual) == 70 - 1 + 1 + 70 and "1" in got.actual


def test_eof_definitions(spark):
    passes = C.eof_pass(F.lit(False), F.lit("eof"), F.col("t"), F.lit(0))
    assert one(spark, passes, t=True) is False and one(spark, passes, t=False) is True


def test_hashes_policy_and_json(spark):
    df = spark.createDataFrame([("a", None)], "agentFamily string, provider string")
    import hashlib

    assert df.select(I.configuration_hash(df).alias("h")).collect()[0].h == hashlib.sha256(b'{"agentFamily":"a","provider":null}').hexdigest()
    policy = F.struct(F.lit(5).alias("oracleRecoveries"), F.lit(0).alias("retryFailures"), F.lit(9).alias("concurrency"), F.lit(1).alias("timeoutMs"))
    assert one(spark, I.canonical_policy(policy), a="") == '{"oracleRecoveries":5,"retryFailures":0,"timeoutMs":1}'


def test_route_projection(spark):
    cols = "model string, modelFamily string, modelVersion string, provider string, agentFamily string, configurationHash string"
    rows = [("a/short", "short", "short", "route", "x", "old"), ("other/short", "short", "short", "route", "x", "old"), ("m", "m", "1", None, "x", "old"), ("z", "z", "1", "q", "x", "old")]
    df = spark.createDataFrame(rows, cols)
    aliases = spark.createDataFrame([("m", None, "home")], "id string, `from` string, `to` string")
    routes = spark.createDataFrame([("long-name", "route", "short")], "id string, provider string, selector string")
    df = df.withColumn("model", F.when(F.col("model") == "a/short", "route/short").otherwise(F.col("model")))
    got = {r.model: r for r in I.project_models(df, aliases, routes).collect()}
    assert (got["route/short"].modelFamily, got["route/short"].modelVersion) == ("long-name", "long-name") and got["route/short"].configurationHash != "old"
    assert got["other/short"].modelFamily == "short" and got["m"].provider == "home" and got["z"].configurationHash == "old"
    again = I.project_models(I.project_models(df, aliases, routes), aliases, routes)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, I.project_models(df, aliases, routes).collect()))


def test_classifiers(spark):
    assert one(spark, C.tool_category(F.col("a")), a="eval") == "native-code" and one(spark, C.tool_category(F.col("a")), a="x") == "other"
    assert one(spark, C.narrow_family(F.col("a")), a="copy-within-10-plain") == "Copy within file"
    with pytest.raises(Exception, match="unknown task"):
        one(spark, C.narrow_family(F.col("a")), a="nothing")
    assert one(spark, C.shell_functions(F.col("a")), a="echo") == ["other shell work"]
    assert one(spark, C.workspace_write(F.col("a")), a="cat x > /tmp/y") is False and one(spark, C.workspace_write(F.col("a")), a="echo > src/a.ts") is True
    assert one(spark, C.infrastructure_kind(F.col("a")), a="spawn ENOENT") == "missing-file" and one(spark, C.infrastructure_kind(F.col("a")), a=None) is None
    assert one(spark, C.failure_kind(F.col("a"), F.lit(False), F.lit(1), F.lit(False), F.lit(None)), a="HTTP 429 rate limit") == "rate-limit"
    assert one(spark, C.rejection_code(F.col("a")), a="bad schema") == "invalid-schema" and one(spark, C.rejection_code(F.col("a")), a="?") == "invalid-envelope"
    assert one(spark, C.redact(F.col("a")), a="key sk-abcdefghijklmnopqrst") == "key [redacted]" and one(spark, C.sensitive(F.col("a")), a="x '/home/me") is True
    assert one(spark, I.badge_color(F.col("a").cast("double")), a="0.75") == "green" and one(spark, I.split_suffix(F.col("a"), ["ide", "x"]), a="m-y-ide").head == "m-y"
    assert one(spark, C.labels(F.col("a"), C.SHELL_MUTATIONS), a="sed -i s/a/b/ f") == ["sed -i"] and one(spark, X.quoted(F.col("a")), a="é\n😀") == '"\\u00e9\\n😀"'
    assert one(spark, X.clip(F.col("a"), 2, "+"), a="abc") == "ab+" and one(spark, I.reasoning_rank(F.col("a")), a="low") == 2


def test_tasks(spark):
    m = T.task_matrix(spark)
    assert m.count() == 226 and m.select("taskId").distinct().count() == 226 and {r.variant: r["count"] for r in m.groupBy("variant").count().collect()} == {"plain": 109, "unicode": 117}
    bad = m.withColumn("p", T.parse_task_id(F.col("taskId"))).where("p.category <> category or p.scale <> scale or p.suffix <> suffix or p.variant <> variant")
    assert bad.count() == 0
    assert [one(spark, T.edit(F.lit("aXbXc"), op, F.lit("X"), F.lit("Y")), a="") for op in ("replace-all", "delete", "copy", "insert-before", "move-to-end")] == ["aYbYc", "abXc", "aXXbXc", "aYXbXc", "abXcX"]
    names = spark.createDataFrame([("a",), ("b",)], "model string"), spark.createDataFrame([("x",)], "harness string")
    assert T.matrix(*names).count() == 2
    with pytest.raises(ValueError, match="J20"):
        T.matrix(*names, spark.createDataFrame([("a", "x")], "model string, harness string"))
