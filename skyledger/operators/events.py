"""Event logs of agents as JSON lines: tool calls and metrics, by dialect, over VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.classify import command_features, tool_category

#: Event dialects, by what they call a tool call: type of a call, of a model round, of an error: fixed values.
ITEM_CALLS = ["command_execution", "file_change", "mcp_tool_call", "web_search"]
#: Completed items of timelines: actions with the tool that they count as, and others: fixed values.
ACTION_ITEMS = {
    "commandExecution": "command_execution", "fileChange": "edit", "fileRead": "read", "search": "search", "webSearch": "webSearch", "webFetch": "webFetch", "imageView": "imageView", "imageGeneration": "imageGeneration", "backgroundTask": "backgroundTask", "delegation": "delegation",
}
OTHER_ITEMS = ["userMessage", "agentMessage", "text", "image", "localImage", "localFile", "reasoning", "plan", "planSteps", "contextCompaction", "extension"]
#: Tools that the code-mode profile must declare: fixed values.
PROFILE_TOOLS = ["codemode", "read", "bash", "write", "search", "replace", "insert", "delete", "copy", "move"]
DIALECTS = ["items", "parts", "messages", "turns", "executions"]


def get(path: str, kind: str = "string", event: str = "event") -> Column:
    return F.try_variant_get(F.col(event), f"$.{path}", kind)


def parse_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines as VARIANT events; what doesn't parse is dropped."""
    return lines.withColumn("event", F.try_parse_json(text)).where("event is not null")


def count_malformed(lines: DataFrame, key: Sequence[str], text: str = "value") -> DataFrame:
    """Lines per key that aren't JSON; blank ones don't count."""
    return lines.groupBy(*key).agg(F.count_if(F.try_parse_json(text).isNull() & (F.trim(text) != "")).alias("malformed"))


def call_data(event: str = "event") -> Column:
    """Id, name, command and error of a tool call in any dialect."""
    g = lambda p, k="string": get(p, k, event)
    t, item = g("type"), g("item.type")
    text_args = F.try_parse_json(g("data.arguments"))
    command = F.coalesce(F.try_variant_get(text_args, "$.command", "string"), g("data.arguments.command"))
    exit_code, status = g("item.exit_code", "int"), g("item.status")
    one = lambda i, n, c, e: F.struct(i.alias("id"), n.alias("name"), c.alias("command"), e.cast("boolean").alias("error"))
    return (
        F.when((t == "item.completed") & (item == "command_execution"), one(g("item.id"), item, g("item.command"), F.when(exit_code.isNotNull(), exit_code != 0)))
        .when(t == "item.completed", one(g("item.id"), item, g("item.command"), F.when(status.isNotNull(), status != "completed")))
        .when(t == "tool_use", one(g("part.callID"), g("part.tool"), g("part.state.input.command"), F.when(g("part.state.status").isNotNull(), g("part.state.status") == "error")))
        .when(t == "tool.execution_start", one(g("data.toolCallId"), g("data.toolName"), g("data.arguments.command"), F.lit(None)))
        .when(t == "tool/call", one(g("data.callId"), g("data.name"), command, F.lit(None)))
        .otherwise(one(g("toolCallId"), F.coalesce(g("toolName"), F.lit("unknown")), g("args.command"), F.lit(None)))
    )


def is_call(dialect: str) -> Column:
    t = get("type")
    if dialect == "items":
        return (t == "item.completed") & get("item.type").isin(ITEM_CALLS)
    return t == {"parts": "tool_use", "messages": "tool_execution_start", "turns": "tool/call", "executions": "tool.execution_start"}[dialect]


def tool_facts(events: DataFrame, dialect: str, key: Sequence[str], seq: str) -> DataFrame:
    """Argument-free facts of each call: tool, category, outcome, command features; ordinal by seq from 0."""
    from pyspark.sql import Window

    calls = events.where(is_call(dialect)).withColumn("c", call_data())
    order = Window.partitionBy(*key).orderBy(seq)
    name = F.col("c.name")
    command = F.when(name.isin("bash", "command_execution", "read_bash"), F.coalesce("c.command", F.lit(""))).otherwise("")
    return calls.select(*key, (F.row_number().over(order) - 1).alias("ordinal"), name.alias("tool"), tool_category(name).alias("category"), F.when(F.col("c.error"), "error").when(~F.col("c.error"), "completed").alias("outcome"), command_features(command).alias("commandFeatures"))


def event_metrics(events: DataFrame, dialect: str, key: Sequence[str]) -> DataFrame:
    """Calls, model rounds, errors, usage and cost per log. What a dialect doesn't report is null, never 0."""
    t = get("type")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    none_long, none_double = F.lit(None).cast("long"), F.lit(None).cast("double")
    assistant = (t == "message_end") & (get("message.role") == "assistant")
    errors = {
        "items": t.isin("error", "turn.failed"), "parts": t == "error", "messages": (t == "message_end") & (get("message.stopReason") == "error"),
        "turns": (t == "turn/end") & ~get("data.reason.kind").eqNullSafe("completed"), "executions": t == "session.error",
    }[dialect]
    rounds = {"items": None, "parts": t == "step_finish", "messages": assistant, "turns": t == "assistant/message", "executions": t == "assistant.turn_start"}[dialect]
    out = {c: none_long for c in ("inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens", "totalTokens", "failedToolCalls", "invalidToolCalls")} | {"costUsd": none_double}
    usage_sum = lambda when, seen, path: F.when(n(when & seen) > 0, F.sum(F.when(when & seen, F.coalesce(get(path, "long"), F.lit(0)))))
    if dialect == "messages":
        seen = get("message.usage", "variant").isNotNull()
        for c, f in (("inputTokens", "input"), ("outputTokens", "output"), ("cacheReadTokens", "cacheRead"), ("cacheWriteTokens", "cacheWrite"), ("totalTokens", "totalTokens")):
            out[c] = usage_sum(assistant, seen, f"message.usage.{f}")
        out["costUsd"] = F.sum(F.when(assistant, get("message.usage.cost.total", "double")))
        ended = t == "tool_execution_end"
        failed = get("isError", "boolean").eqNullSafe(True) | get("result.isError", "boolean").eqNullSafe(True)
        out["failedToolCalls"] = F.when(n(ended) > 0, n(ended & failed))
    if dialect == "items":
        done, seen = t == "turn.completed", get("usage", "variant").isNotNull()
        total, cached, written, output = (usage_sum(done, seen, f"usage.{f}") for f in ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens"))
        fits = total - cached - written >= 0
        for c, v in (("inputTokens", total - cached - written), ("outputTokens", output), ("cacheReadTokens", cached), ("cacheWriteTokens", written), ("totalTokens", total + output)):
            out[c] = F.when(fits, v)
        bad = (get("item.status") == "failed") | (F.coalesce(get("item.exit_code", "int"), F.lit(0)) != 0)
        out["failedToolCalls"] = F.when(n(is_call(dialect)) > 0, n(is_call(dialect) & F.coalesce(bad, F.lit(False))))
    return events.groupBy(*key).agg(F.count("*").alias("eventCount"), n(is_call(dialect)).alias("toolCalls"), (n(rounds) if rounds is not None else none_long).alias("modelRounds"), n(errors).alias("errors"), *[c.alias(k) for k, c in out.items()])


def timeline_tool() -> Column:
    """The tool of a completed timeline item; null for items that are no action; an unknown item fails."""
    kind = get("data.item.type")
    named = F.coalesce(get("data.item.tool"), F.lit(""))
    call = F.when(named == "", F.raise_error(F.lit("tool call without a tool name")).cast("string")).otherwise(named)
    out = F.when(kind.isNull() | kind.isin(OTHER_ITEMS), F.lit(None).cast("string")).when(kind == "toolCall", call)
    for item, tool in ACTION_ITEMS.items():
        out = out.when(kind == item, tool)
    return F.when(get("type") == "item/completed", out.otherwise(F.raise_error(F.concat(F.lit("unknown timeline item: "), kind)).cast("string")))


def timeline_metrics(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Model rounds as the larger of token and context updates; usage only if there are as many of the former.

    Cost and failed calls are not reported there and stay null. An item of an unknown type fails the query.
    """
    t, last = get("type"), "data.tokenUsage.last"
    used = (t == "thread/tokenUsage/updated") & get(last, "variant").isNotNull()
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    tokens, contexts = n(used), n(t == "thread/contextWindowUsage/updated")
    whole = (tokens > 0) & (tokens >= contexts)
    total = lambda c: F.when(whole, F.sum(F.when(used, F.coalesce(get(f"{last}.{c}", "long"), F.lit(0)))))
    none = F.lit(None)
    return events.groupBy(*key).agg(
        F.count("*").alias("eventCount"), F.count(timeline_tool()).alias("toolCalls"), F.greatest(tokens, contexts).alias("modelRounds"), n((t == "turn/completed") & ~get("data.status").eqNullSafe("completed")).alias("errors"),
        *[total(c).alias(name) for name, c in (("inputTokens", "inputTokens"), ("outputTokens", "outputTokens"), ("cacheReadTokens", "cachedInputTokens"), ("totalTokens", "totalTokens"))], none.cast("double").alias("costUsd"), none.cast("long").alias("failedToolCalls"),
    )


def profile_errors(declared: DataFrame, tools: str = "tools", required: Sequence[str] = tuple(PROFILE_TOOLS)) -> DataFrame:
    """Rows whose declared tools lack required ones, with those that are missing, in the order required."""
    missing = F.array_except(F.array(*map(F.lit, required)), F.col(tools))
    return declared.withColumn("missing", missing).where(F.size("missing") > 0)
