"""Classifiers of task ids, tools, shell commands, errors and texts, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Task families by id, two groupings: fixed values.
BROAD_FAMILIES = [
    (r"\Alanguage-", "Language edits"), (r"\Aunicode-fix-", "Unicode fixes"), (r"\Aliteral-", "Literal edge cases"), (r"\A(replace|delete|move|copy|insert)-block-", "Block edits"), (r"\A(copy-within|move-between|insert-payload)-", "Cross-file edits"),
    (r"\A(select|delete|insert)-subset-", "Subset edits"), (r"\Areplace-all-", "Replace all"), (r"\Aselect-one-", "Select one"), (r"\Amulti-file-", "Multi-file edits"), (r"\Adistinct-edits-", "Distinct edits"), (r"\Aunique-", "Unique match"),
]
NARROW_FAMILIES = {
    "language-": "Language variants", "unicode-fix-": "Unicode repairs", "unique-": "Unique replacement", "replace-all-": "Replace all", "multi-file-": "Multiple files", "select-one-": "Select one", "select-subset-": "Select subset", "delete-subset-": "Delete subset", "insert-subset-": "Insert subset", "distinct-edits-": "Different edits",
    "literal-": "Literal text", "replace-block-": "Replace block", "delete-block-": "Delete block", "move-block-": "Move block", "copy-block-": "Copy block", "insert-block-": "Insert block", "insert-payload-": "Insert payload", "copy-within-": "Copy within file", "move-between-": "Move between files",
}
#: Units of scale by category: fixed values.
SCALE_UNITS = {
    "unique": "surrounding-routes", "replace-all": "occurrences", "multi-file": "files", "select-one": "similar-tests", "select-subset": "similar-tests", "delete-subset": "similar-tests", "insert-subset": "similar-tests", "distinct-edits": "files", "literal": "replacement", "unicode-fix": "replacement", "insert-block": "surrounding-table-rows",
    "insert-payload": "inserted-table-rows", "replace-block": "source-table-rows", "delete-block": "source-table-rows", "copy-block": "source-table-rows", "copy-within": "source-table-rows", "move-block": "source-table-rows", "move-between": "source-table-rows", "language-replace": "occurrences", "language-select": "similar-entries", "language-insert": "inserted-entries",
}
#: Tools by category: fixed values.
TOOLS = {
    "command": ["bash", "command_execution", "read_bash"], "mutation": ["apply_patch", "copy", "create", "delete", "edit", "file_change", "insert", "move", "replace", "str_replace_editor", "undo", "write"], "read": ["read", "view"], "search": ["glob", "grep", "rg", "search"],
    "native-code": ["eval"], "planning/control": ["exit_plan_mode", "report_intent", "task", "todo", "todo_write", "todowrite", "update_goal"],
}
#: Shell command features, with their labels in facts and in trajectory tables: fixed values.
COMMANDS = [
    ("search", "search", r"(^|[;&|()\s])(rg|grep|find)(\s|$)"), ("read", "line or file read", r"(^|[;&|()\s])(cat|head|tail|sed|awk|wc)(\s|$)"), ("byte-check", "byte or EOF check", r"(^|[;&|()\s])(xxd|od|file)(\s|$)"),
    ("checksum", "checksum", r"(^|[;&|()\s])(sha\w*sum|md5sum)(\s|$)"), ("compare", "diff or compare", r"(^|[;&|()\s])(diff|cmp)(\s|$)"), ("list", "file listing", r"(^|[;&|()\s])ls(\s|$)"), ("file-operation", "file operation", r"(^|[;&|()\s])(cp|mv|rm|touch|mkdir)(\s|$)"),
    ("script", "script", r"(^|[;&|()\s])(python\d*|node|perl|ruby)(\s|$)"), ("test-or-build", "test or build", r"(^|[;&|()\s])(npm|pnpm|yarn|bun|pytest|vitest|tsc)(\s|$)"),
]
#: Redirections and writing commands: fixed values.
REDIRECT = r"""(?:^|[^<])>{1,2}\s*["']?([^\s;|"']+)"""
WRITES = r"\b(sed|perl)\s+[^;&|]*-i\b|\btee\b|(^|[;&|]\s*)(cp|mv|rm|touch|mkdir)\b"
#: Mutations and activities in shell commands: fixed values.
SHELL_MUTATIONS = {
    "sed -i": r"""\bsed\b[^\n]*(?:\s-i(?:\s|['"]|-)|--in-place)""",
    "perl -i/-pi": r"\bperl\b[^\n]*\s-[^\s]*i[^\s]*",
    "Python write script": r"""\bpython(?:3)?\b[\s\S]*(?:\.write\s*\(|\.write_(?:text|bytes)\s*\(|\.writelines\s*\(|open\s*\([^\n)]*,\s*(?:encoding\s*=\s*[^,]+,\s*)?['"][wax+]|shutil\.(?:copy|move)|fileinput\.input\s*\([^)]*inplace\s*=\s*True)""",
    "Node fs write script": r"\bnode\b[\s\S]*(?:writeFile|appendFile|copyFile|renameSync|createWriteStream)",
    "append/redirect into workspace file": r"""(?:sed|awk|cat|printf|echo|head|tail)\b[^\n]*(?:>>?|\|\s*tee(?:\s+-a)?)\s+(?!(?:/tmp|/dev|null|\$))["']?(?:/workspace/)?[^\s;&|"']+\.(?:ts|js|py|go|md|txt|json|yaml|yml|toml|rs|java|c|cpp|h)\b""",
    "cp/mv/install into workspace": r"(?:^|[;&|\n]\s*)(?:cp|mv|install)\b[^\n]*(?:/workspace/|\s+(?!/tmp)[^\s;&|]+\.(?:ts|js|py|go|md|txt|json|yaml|yml|toml|rs|java|c|cpp|h)\b)",
    "truncate/rm target": r"(?:^|[;&|\n]\s*)(?:truncate\b|rm\b[^\n]*\.(?:ts|js|py|go|md|txt|json|yaml|yml|toml|rs|java|c|cpp|h)\b)",
    "patch/git apply": r"\b(?:patch|git\s+apply|apply_patch)\b",
}
SHELL_ACTIVITIES = {
    "grep": r"\b(?:grep|rg)\b", "find/ls/stat/file": r"\b(?:find|ls|stat|file)\b", "head/tail": r"\b(?:head|tail)\b", "sed": r"\bsed\b", "cat": r"\bcat\b", "xxd/od/hexdump": r"\b(?:xxd|od|hexdump)\b", "wc/diff/cmp": r"\b(?:wc|diff|cmp)\b", "Python": r"\bpython(?:3)?\b", "Perl": r"\bperl\b", "Node": r"\bnode\b",
}
#: Credentials and machine-local paths: fixed values.
SENSITIVE = [
    r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----", r"\bsk[_-][A-Za-z0-9_-]{16,}", r"\bhf_[A-Za-z0-9]{16,}", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{16,}", r"\bgithub_pat_[A-Za-z0-9_]{16,}", r"\bxox[baprs]-[A-Za-z0-9-]{10,}", r"\bAIza[0-9A-Za-z_-]{30,}", r"\bAKIA[0-9A-Z]{16}\b", r"""(?:^|["'])/(?:root|home)/""",
]
#: Failure and rejection evidence, first match wins: fixed values.
FAILURES = [
    ("authentication", r"(?i)\b(401|403|unauthorized|forbidden|expired token|invalid api key)\b"), ("model-unavailable", r"(?i)\b(404|model not found|unknown model|unsupported model)\b"), ("rate-limit", r"(?i)\b(429|rate.?limit|quota exceeded)\b"), ("missing-module", r"(?i)\b(ERR_MODULE_NOT_FOUND|cannot find module|module not found)\b"),
]
REJECTIONS = [
    ("revoked-workflow", "Revoked signer workflow SHA"), ("wrong-signer", "Unknown signer workflow SHA|signer SHA mismatch"), ("invalid-signature", "(?i)attestation|signature|Sigstore|gh exited"), ("invalid-schema", "(?i)schema"), ("invalid-envelope", "(?i)JSON|object|fields must be exactly|expected fields"),
    ("invalid-metrics", "(?i)metric|token|tool-call|round|ordinal|nullable"), ("hidden-retries", "(?i)retry|recover"), ("invalid-contract", "(?i)task|fixture|verifier|contract|policy|runner|configuration|identity"),
]


def first_match(text: Column, table: Sequence[tuple[str, str]], default: Column) -> Column:
    out = default
    for pattern, label in reversed(table):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def task_family(task: Column) -> Column:
    """Broad families; Other for the rest."""
    return first_match(task, BROAD_FAMILIES, F.lit("Other"))


def narrow_family(task: Column, strict: bool = True) -> Column:
    """Narrow families; raises for unknown ids, or gives null if not strict."""
    unknown = F.raise_error(F.concat(F.lit("unknown task: "), task)).cast("string") if strict else F.lit(None).cast("string")
    out = unknown
    for prefix, label in reversed(NARROW_FAMILIES.items()):
        out = F.when(task.startswith(prefix), label).otherwise(out)
    return out


def tool_category(name: Column, native: str = "native-code") -> Column:
    """P14. Facts say native-code; trajectory tables say native code."""
    out = F.lit("other")
    for label, names in reversed(TOOLS.items()):
        out = F.when(name.isin(names), native if label == "native-code" else label).otherwise(out)
    return out


def workspace_write(command: Column, declared: Column | None = None) -> Column:
    """Does a shell command likely write into the workspace? declared: the event says so itself."""
    targets = F.regexp_extract_all(command, F.lit(REDIRECT), F.lit(1))
    redirects = F.exists(targets, lambda x: ~x.startswith("/tmp/") & ~x.startswith("/dev/"))
    writes = command.rlike(WRITES) & (command.contains("/workspace/") | ~command.contains("/tmp/"))
    return F.coalesce(declared, F.lit(False)) | redirects | writes if declared is not None else redirects | writes


def command_features(command: Column, declared: Column | None = None) -> Column:
    """Labels of a shell command's facts; empty for an empty command."""
    found = [F.when(command.rlike(p), fact) for fact, _, p in COMMANDS] + [F.when(workspace_write(command, declared), "likely-workspace-write")]
    return F.when(F.coalesce(command, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*found)))


def shell_functions(command: Column, declared: Column | None = None) -> Column:
    """P15 with the labels of trajectory tables; other shell work if nothing else fits."""
    found = F.array_compact(F.array(*[F.when(command.rlike(p), label) for _, label, p in COMMANDS], F.when(workspace_write(command, declared), "likely workspace write")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other shell work")))


def labels(text: Column, table: dict[str, str]) -> Column:
    """All labels whose pattern is found; categories overlap."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), k) for k, p in table.items()]))


def sensitive(text: Column) -> Column:
    """a possible credential or machine-local path."""
    return text.rlike("|".join(f"(?:{p})" for p in SENSITIVE))


def redact(text: Column) -> Column:
    """Credentials replaced by a mark."""
    return F.regexp_replace(text, "|".join(f"(?:{p})" for p in SENSITIVE[1:8]), "[redacted]")


def infrastructure_kind(error: Column) -> Column:
    """P20."""
    kind = F.when(error.contains("ERR_FS_FILE_TOO_LARGE"), "file-too-large").when(error.contains("ENOENT"), "missing-file").when(error.contains("timed out"), "timeout").otherwise("runner-error")
    return F.when(error.isNotNull() & (error != ""), kind)


def failure_kind(evidence: Column, timed_out: Column, exit_code: Column, has_errors: Column, exact: Column) -> Column:
    """One of ten outcomes; evidence is the text of errors and stderr."""
    out = F.when(~exit_code.eqNullSafe(0), "process-failed").when(has_errors, "agent-errors").when(exact.eqNullSafe(False), "incorrect-edit").otherwise("unknown")
    denied = evidence.rlike(r"(?i)\b(bwrap|bubblewrap)\b") & evidence.rlike(r"(?i)\b(permission denied|operation not permitted)\b")
    out = F.when(denied, "sandbox-permission").otherwise(out)
    for label, pattern in reversed(FAILURES):
        out = F.when(evidence.rlike(pattern), label).otherwise(out)
    return F.when(F.coalesce(timed_out, F.lit(False)), "timeout").otherwise(out)


def rejection_code(message: Column) -> Column:
    """A stable code for a rejection message."""
    return first_match(message, [(p, label) for label, p in REJECTIONS], F.lit("invalid-envelope"))


def difference_kind(passed: Column, structural: Column, changes: Column) -> Column:
    """Pass, file-set, execution-only, eof, line-breaks, ascii-layout or other-text.

    changes: array of structs with onlyEof, onlyLineBreaks, onlyAsciiLayout; structural: files missing, unexpected or invalid.
    """
    every = lambda f: F.forall(changes, lambda c: c[f])
    return (
        F.when(passed, "pass").when(structural, "file-set").when(F.size(changes) == 0, "execution-only").when(every("onlyEof"), "eof").when(every("onlyLineBreaks"), "line-breaks").when(every("onlyAsciiLayout"), "ascii-layout").otherwise("other-text")
    )


def normalized_difference(passed: Column, structural: Column, only_eof: Column) -> Column:
    """Pass, eof, other, or unknown when nothing was observed."""
    return F.when(passed, "pass").when(structural, "other").when(only_eof.isNull(), "unknown").when(only_eof, "eof").otherwise("other")


def eof_pass(passed: Column, difference: Column, timed_out: Column, exit_code: Column) -> Column:
    """Exact, or differing only at the end in a round that ended well. Unlike normalizedPassed, which ignores how it ended."""
    return passed | ((difference == "eof") & ~timed_out & exit_code.eqNullSafe(0))


def trial_passes(exit_code: Column, timed_out: Column, errors: Column, exact: Column) -> Column:
    """D06."""
    return exit_code.eqNullSafe(0) & ~F.coalesce(timed_out, F.lit(False)) & (F.coalesce(errors, F.lit(0)) == 0) & F.coalesce(exact, F.lit(False))
