"""Text comparison and quoting."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXT = 70


def only_eof(a: Column, b: Column) -> Column:
    """Equal but for whole line ends at the end of the text."""
    trim = lambda c: F.regexp_replace(c, r"(?:\r\n|\n)+\z", "")
    return trim(a) == trim(b)


def only_line_breaks(a: Column, b: Column) -> Column:
    strip = lambda c: F.translate(c, "\r\n", "")
    return strip(a) == strip(b)


def only_ascii_layout(a: Column, b: Column) -> Column:
    strip = lambda c: F.translate(c, "\r\n\t ", "")
    return strip(a) == strip(b)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


DIFF = T.StructType([T.StructField("firstDifference", T.IntegerType()), T.StructField("actual", T.StringType()), T.StructField("expected", T.StringType())])


@F.pandas_udf(DIFF)
def difference_window(actual: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """Where two texts first differ, in UTF-16 units, and both with context around what differs."""
    out = []
    for a, b in zip(actual, expected, strict=True):
        if a is None or b is None:
            out.append((None, None, None))
            continue
        x, y = (list(s.encode("utf-16-be", "surrogatepass")[i : i + 2] for i in range(0, 2 * len(s.encode("utf-16-be", "surrogatepass")) // 2, 2)) for s in (a, b))
        first = len(os.path.commonprefix([x, y]))
        tail = len(os.path.commonprefix([x[first:][::-1], y[first:][::-1]]))
        part = lambda z: b"".join(z[max(0, first - CONTEXT) : max(0, len(z) - tail + CONTEXT)]).decode("utf-16-be", "replace")  # noqa: B023, E731
        out.append((first, part(x), part(y)))
    return pd.DataFrame(out, columns=["firstDifference", "actual", "expected"])


def compare_text(actual: Column, expected: Column) -> Column:
    """D01 as a struct."""
    window = difference_window(actual, expected)
    return F.struct(utf16_length(actual).alias("actualLength"), utf16_length(expected).alias("expectedLength"), only_eof(actual, expected).alias("onlyEof"), only_line_breaks(actual, expected).alias("onlyLineBreaks"), only_ascii_layout(actual, expected).alias("onlyAsciiLayout"), window["firstDifference"].alias("firstDifference"), window["actual"].alias("actual"), window["expected"].alias("expected"))


def clip(text: Column, limit: int, mark: str = "…[truncated]") -> Column:
    """P33."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


@F.pandas_udf(T.StringType())
def quoted(text: pd.Series) -> pd.Series:
    """A JSON string in which U+007F to U+FFFF are escaped and characters beyond are not."""
    def one(s: str | None) -> str | None:
        return s and "".join(f"\\u{ord(c):04x}" if 0x7F <= ord(c) <= 0xFFFF else c for c in json.dumps(s, ensure_ascii=False)) if s else s if s is None else '""'

    return text.map(one)
