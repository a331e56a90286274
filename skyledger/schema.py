"""Explicit schemas of the evidence tables; their field names are fixed values. Readers never infer."""

from __future__ import annotations

RUNS = (
    "runId string, submissionId string, contract string, taskSetSha256 string, verifierSha256 string, "
    "policy struct<oracleRecoveries:int,retryFailures:int,concurrency:int,timeoutMs:bigint>, "
    "definitions struct<benchmark:struct<id:string,version:string,contract:string,kind:string,hash:string>,"
    "taskSet:struct<hash:string,taskIds:array<string>>,"
    "harnesses:array<struct<id:string,name:string,version:string,sourceHash:string>>,"
    "runner:struct<id:string,name:string,version:string>>, "
    "submittedBy struct<platform:string,accountId:string,profileUrl:string>"
)
PROFILES = (
    "runId string, profileId string, modelId string, harnessId string, model string, thinking string, harnessVersion string, harnessKind string, "
    "transport string, sourceCommit string, agentFamily string, agentVersion string, modelFamily string, modelVersion string, provider string, "
    "harnessFamily string, adapterVersion string, configurationHash string, configurationLabels array<string>"
)
CONFIGURATIONS = (
    "configurationId string, agentFamily string, agentVersion string, modelFamily string, modelVersion string, provider string, harnessFamily string, "
    "harnessVersion string, adapterVersion string, model string, thinking string, transport string, harnessKind string, tools array<string>, "
    "extensions array<string>, rules array<string>, runtimeFlags array<string>, environment array<string>, configurationLabels array<string>, configurationHash string"
)
TRIALS = (
    "runId string, trialId string, taskId string, profileId string, modelId string, harnessId string, fixtureSha256 string, "
    "firstExactPassed boolean, finalExactPassed boolean, rounds int, infrastructureFailure string"
)
ROUNDS = (
    "runId string, roundId string, trialId string, round int, exactPassed boolean, normalizedPassed boolean, difference string, timedOut boolean, "
    "providerFailure string, exitCode int, seconds double, toolCallCount int, modelRoundCount int, eventErrors int, toolCallsObserved boolean, costUsd double, "
    "inputTokens bigint, outputTokens bigint, cacheReadTokens bigint, cacheWriteTokens bigint, totalTokens bigint, failedToolCalls int, invalidToolCalls int"
)
TOOL_CALLS = "runId string, roundId string, ordinal int, tool string, category string, outcome string, commandFeatures array<string>"
TABLES = {"profiles": PROFILES, "configurations": CONFIGURATIONS, "trials": TRIALS, "rounds": ROUNDS, "tool-calls": TOOL_CALLS}
#: Enumerations: fixed values.
DIFFERENCES = ["pass", "eof", "other", "unknown"]
CATEGORIES = ["read", "search", "mutation", "command", "native-code", "planning/control", "other"]
OUTCOMES = ["completed", "error"]
PURPOSES = ["official", "community", "exploratory", "smoke", "debug"]
KEYS = {"profiles": ["runId", "profileId"], "configurations": ["configurationHash"], "trials": ["runId", "trialId"], "rounds": ["runId", "roundId"], "tool-calls": ["runId", "roundId", "ordinal"]}


def columns(ddl: str) -> list[str]:
    """Top-level column names of a DDL string."""
    depth, part, out = 0, "", []
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.split()[0])
            part = ""
        else:
            part += c
    return out
