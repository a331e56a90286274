"""URL filtering with a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And automaton: a bit per pattern position, a match mask and a
self-loop mask per character class. Every step advances all patterns over all active URLs of a block at once:
``D = ((D << 1) & match[c]) | (D & loop[c])``, with the shift's carry passed between words. The rules travel with the
function; nothing is shuffled, and a task holds one Arrow batch and a block's state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import LOWER, UPPER

PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
ASCII_LOWER = str.maketrans(UPPER, LOWER)
BLOCK = 8192


class Rule(NamedTuple):
    """A glob over "." + host + path: ``*`` any run without "/", ``**`` any run, ``?`` one character but "/"."""

    glob: str
    verdict: str
    name: str


def domain_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains, where the URL's path starts with path."""
    if re.search(r"[*?]", host + path):
        raise ValueError("hosts and paths of domain rules are literal")
    return Rule(f"*.{host}{path}**", verdict, host + path)


def split_url(url: str | None) -> tuple[str, str]:
    found = PARTS.search(url) if url else None
    if not found:
        return "", ""
    host, path = found.groups()
    return host.lower() if host.isascii() else host.translate(ASCII_LOWER), path


class Automaton:
    def __init__(self, rules: Sequence[Rule]):
        tokens = [re.findall(r"\*\*|.", r.glob, re.S) for r in rules]
        self.codes = np.array(sorted({ord(t) for ts in tokens for t in ts if len(t) == 1 and t not in "*?"} | {ord("/")}), np.uint32)
        cls = {int(c): i + 1 for i, c in enumerate(self.codes)}  # 0: any other character
        n, slash = len(cls) + 1, cls[ord("/")]
        width = sum(1 + sum(t not in ("*", "**") for t in ts) for ts in tokens)
        words = max(1, -(-width // 64))
        match, loop = np.zeros((n, words * 64), bool), np.zeros((n, words * 64), bool)
        first, self.final, at = np.zeros(words * 64, bool), [], 0
        for ts in tokens:
            first[at] = True
            for t in ts:
                if t == "**":
                    loop[:, at] = True
                elif t == "*":
                    loop[np.arange(n) != slash, at] = True
                else:
                    at += 1
                    match[(np.arange(n) != slash) if t == "?" else cls[ord(t)], at] = True
            self.final.append(at)
            at += 1
        pack = lambda bits: np.packbits(bits, axis=-1, bitorder="little").view("<u8")
        self.match, self.loop, self.first = pack(match), pack(loop), pack(first)

    def run(self, texts: list[str]) -> np.ndarray:
        """A boolean for each text and rule."""
        out = np.zeros((len(texts), len(self.final)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for start in range(0, len(order), BLOCK):
            some = order[start : start + BLOCK]
            lengths = np.array([len(texts[i]) for i in some])
            points = np.frombuffer("".join(texts[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.searchsorted(self.codes, points).clip(max=len(self.codes) - 1)
            kinds = np.where(self.codes[at] == points, at + 1, 0)
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            state = np.repeat(self.first[None], len(some), 0)
            for step in range(int(lengths[0]) if len(some) else 0):
                active = int(np.searchsorted(-lengths, -step, "left"))  # texts longer than step come first
                c, d = kinds[begin[:active] + step], state[:active]
                moved = d << np.uint64(1)
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
                state[:active] = moved & self.match[c] | d & self.loop[c]
            for j, bit in enumerate(self.final):
                out[some, j] = state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
        return out


def judge_urls(pages: DataFrame, base: Sequence[Rule], extra: Sequence[Rule] = (), *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdict of each URL: the longest fitting base rule's; else the longest fitting extra rule's; else default.

    Columns: id_col, host, path, rule (base rule's name or null), verdict, extra_rule. A null URL, or one without
    "://", has an empty host and path, and rules are run over "." then. Ties in length go to the rule listed first.
    Rows that repeat, and null ids, are judged like any other. Other columns are ignored, whatever their names. An
    empty table gives no rows. Whole URLs are read, however long.
    """
    rules, n = [*base, *extra], len(base)
    kind = pages.schema[id_col].dataType.simpleString()
    ranked = lambda part: sorted(range(len(part)), key=lambda i: -len(part[i].name))
    base_order, extra_order = ranked(base), ranked(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            fits = automaton.run([f".{h}{p}" for h, p in parts])

            def chosen(order: list[int], shift: int) -> list:
                found = np.full(len(parts), -1)
                for i in reversed(order):
                    found[fits[:, shift + i]] = shift + i
                return [rules[i] if i >= 0 else None for i in found]

            own, other = chosen(base_order, 0), chosen(extra_order, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], [r and r.name for r in own], [(r or o).verdict if r or o else default for r, o in zip(own, other, strict=True)], [o and o.name for o in other]))],
                [id_col, "host", "path", "rule", "verdict", "extra_rule"],
            )

    return pages.select(F.col(id_col), F.col(url_col).alias("_url")).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, extra_rule string")
