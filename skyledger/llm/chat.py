"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. The operator renders successive prefixes of a
conversation and compares consecutive outputs: what a prefix adds is its last turn's span. A second rendering with a
sentinel in place of the turn's text locates the text inside the span. An output that doesn't start with its
predecessor comes from a template that rewrites history; that is reported, and the span starts where the two part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
CONTROL = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE")
HEAD = re.compile(r'<<ROLE ("(?:[^"\\]|\\.)*")>>\n')


def escape(text: str) -> str:
    """Double backslashes, then put one after the first character of each control string."""
    return CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\\\|\\", lambda m: m[0][1:], text)


def instruct_template(turns: list[Turn]) -> str:
    """Users in [INST] marks, assistants up to </s>, systems in <<SYS>> marks, other roles with their name."""
    out = []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body} </s>")
        elif role == "system":
            out.append(f"<<SYS>>\n{body}\n<</SYS>>\n")
        else:
            name = json.dumps(role).replace("<", "\\u003c").replace("[", "\\u005b")
            out.append(f"<<ROLE {name}>>\n{body}\n<</ROLE>>\n")
    return "".join(out)


#: Its author says that a turn never changes what comes before it; see locate().
instruct_template.append_only = True


def read_back(output: str) -> list[Turn]:
    """The turns of instruct_template's output."""
    turns, at = [], 0
    while at < len(output):
        if output.startswith("<s>[INST] ", at):
            role, start, end = "user", at + 10, " [/INST]"
        elif output.startswith("<<SYS>>\n", at):
            role, start, end = "system", at + 8, "\n<</SYS>>\n"
        elif found := HEAD.match(output, at):
            role, start, end = json.loads(found[1]), found.end(), "\n<</ROLE>>\n"
        elif output[at] == " ":
            role, start, end = "assistant", at + 1, " </s>"
        else:
            raise ValueError(f"no turn at {at}")
        stop = output.index(end, start)
        turns.append((role, unescape(output[start:stop])))
        at = stop + len(end)
    return turns


Spans = list[tuple[int, int, int, int]]
WINDOWED = 32  # turns from which a template that is declared append-only is rendered by windows


def sentinel_for(turns: list[Turn]) -> str | None:
    """A private-use character that no text holds."""
    used = {c for _, text in turns for c in text if "\ue000" <= c < "\uf900"}
    return next(c for c in map(chr, range(0xE000, 0xF900)) if c not in used) if len(used) < 6400 else None


def text_span(now: str, probe: str, sentinel: str | None, start: int) -> tuple[int, int]:
    at = probe.find(sentinel) if sentinel else -1
    # a template that drops or changes this text has an empty span at the turn's start
    return (start, start) if at < 0 else (at, max(at, len(now) - (len(probe) - at - 1)))


def locate_by_windows(template: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, Spans] | None:
    """locate() in linear time, for templates in which a turn adds a piece that depends on it and the turn before.

    A turn's piece is what it adds to its predecessor alone. That the pieces make up the template's output is verified
    on the whole and on prefixes of doubling length; None if it isn't so.
    """
    whole, sentinel = template(turns), sentinel_for(turns)
    start, spans, checks = len(template([])), [], 1
    if not whole.startswith(template([])):
        return None
    for i, (role, text) in enumerate(turns):
        before = template(turns[i - 1 : i]) if i else template([])
        now = template(turns[max(0, i - 1) : i + 1])
        piece = now[len(before) :]
        if not now.startswith(before) or not whole.startswith(piece, start):
            return None
        probe = template([*turns[max(0, i - 1) : i], (role, sentinel)]) if sentinel else ""
        first, last = (x - len(before) + start for x in text_span(now, probe, sentinel, len(before)))
        spans.append((start, start + len(piece), first, last))
        start += len(piece)
        if i + 1 == checks:
            checks *= 2
            if template(turns[: i + 1]) != whole[:start]:
                return None
    return (whole, spans) if start == len(whole) else None


def locate(template: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, Spans, bool]:
    """The whole output; each turn's span and its text's span; whether the template rewrote history.

    Where it did, spans are those of the prefix that ended with the turn, cut to the final output's length. Every prefix
    is rendered, however many turns there are, so that no rewriting goes unseen; only for a template with the attribute
    append_only are long conversations rendered by windows, which takes linear time.
    """
    if len(turns) >= WINDOWED and getattr(template, "append_only", False) and (found := locate_by_windows(template, turns)):
        return *found, False
    sentinel, before, spans, rewrites = sentinel_for(turns), template([]), [], False
    for i, (role, _) in enumerate(turns):
        now = template(turns[: i + 1])
        start = len(before) if now.startswith(before) else len(os.path.commonprefix([before, now]))
        rewrites |= start < len(before)
        probe = template([*turns[:i], (role, sentinel)]) if sentinel else ""
        spans.append((start, len(now), *text_span(now, probe, sentinel, start)))
        before = now
    return before, [tuple(min(x, len(before)) for x in s) for s in spans], rewrites


SPANS = "array<struct<role:string,start:long,stop:long,text_start:long,text_stop:long,loss:boolean>>"


def format_chats(rows: DataFrame, template: Callable[[list[Turn]], str] = instruct_template, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format every conversation. Columns: conv_col, formatted, spans (role, span, text's span, loss), rewrites.

    Turns are ordered by turn_col, ties by role and then text; rows that repeat stay as turns of their own. A null
    text or role is empty; null turns come first; a row with a null id is a conversation of its own. Other columns are
    ignored, whatever their names. An empty table gives no rows. A conversation is one example and so one task's work: two
    renderings per turn, of prefixes or, in long conversations and if the template is declared append-only (its attribute
    append_only), of two turns.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    schema = f"`{conv_col}` {kind}, formatted string, spans {SPANS}, rewrites boolean"
    span_type = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("start", "stop", "text_start", "text_stop")), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outs = []
            for turns in batch.column(1).to_pylist():
                pairs = [(t["role"], t["text"]) for t in turns]
                text, spans, rewrites = locate(template, pairs)
                outs.append((text, [dict(zip(("role", "start", "stop", "text_start", "text_stop", "loss"), (r, *s, r in loss_roles), strict=True)) for (r, _), s in zip(pairs, spans, strict=True)], rewrites))
            cols = list(zip(*outs, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], span_type), pa.array(cols[2], pa.bool_())], [conv_col, "formatted", "spans", "rewrites"])

    turns = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = rows.select(F.col(conv_col), turns.alias("_t"))
    grouped = picked.where(F.col(conv_col).isNotNull()).groupBy(conv_col).agg(F.sort_array(F.collect_list("_t")).alias("turns"))
    single = picked.where(F.col(conv_col).isNull()).select(conv_col, F.array("_t").alias("turns"))
    return grouped.unionAll(single).mapInArrow(run, schema)


def digest(formatted: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from format_chats' output with instruct_template: counts and hashes of turns and loss text."""
    kind = formatted.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["text_start"] : s["text_stop"]]) for s in spans if s["loss"])
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), batch.column(3)], [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

    return formatted.select(conv_col, "formatted", "spans", "rewrites").mapInArrow(run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
