"""Tar.gz archives as a source. Whole archives are accepted or refused; a refusal is a row, never a failed job.

An archive is a partition's row. It is gone through twice, both times as a stream of blocks: once to check it against
the limits and the layout, keeping nothing, and, if it is accepted, once to emit its entries. What is held is the packed
archive, whose size is limited before it is read, and one entry.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIB = 1 << 20
#: The files of an official archive, all of them required: fixed values.
OFFICIAL = (
    "official-manifest.json", "execution-plan.json", "installed-dependencies.json", "normalized/manifest.json", "normalized/profiles.jsonl",
    "normalized/configurations.jsonl", "normalized/trials.jsonl", "normalized/rounds.jsonl", "normalized/tool-calls.jsonl",
)
ENTRY = "path string, name string, content binary, code string, message string"


@dataclass(frozen=True)
class Limits:
    """Bytes of an archive, of what it holds and of an entry, and rows (lines that are not empty) of a .jsonl entry."""

    packed: int = 32 * MIB
    raw: int = 128 * MIB
    entry: int = 4 * MIB
    rows: int = 100_000


class Refused(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Counted(io.RawIOBase):
    """A stream that refuses to go on beyond so many bytes."""

    def __init__(self, inner: io.BufferedIOBase, most: int):
        self.inner, self.left = inner, most

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        data = self.inner.read(min(size, 1 << 16) if size >= 0 else 1 << 16)
        self.left -= len(data)
        if self.left < 0:
            raise Refused("invalid-archive", "decompressed limit")
        return data


def entries(content: bytes, files: Sequence[str], limits: Limits) -> Iterator[tuple[str, Callable[[], bytes]]]:
    """The entries of an archive, each with a way to read it before the next; raises Refused where it breaks a rule.

    Only the given files may stand in it, each once and as a regular file, and all of them must; a folder that they
    stand in may be named too.
    """
    folders = {f.rsplit("/", i)[0] for f in files for i in range(1, f.count("/") + 1)}
    seen: set[str] = set()
    try:
        with tarfile.open(fileobj=Counted(gzip.GzipFile(fileobj=io.BytesIO(content)), limits.raw), mode="r|") as tar:
            for member in tar:
                if member.size > limits.entry:
                    raise Refused("invalid-archive", f"entry too large: {member.name}")
                if member.isdir() and member.name in folders:
                    continue
                if not member.isreg():
                    raise Refused("invalid-archive", f"not a regular file: {member.name}")
                if member.name not in files:
                    raise Refused("invalid-layout", f"unexpected entry: {member.name}")
                if member.name in seen:
                    raise Refused("invalid-layout", f"duplicate entry: {member.name}")
                seen.add(member.name)

                def read(member=member) -> bytes:
                    body = tar.extractfile(member).read()
                    if len(body) < member.size:
                        raise Refused("invalid-archive", f"truncated entry: {member.name}")
                    return body

                yield member.name, read
    except (tarfile.TarError, EOFError, OSError, zlib.error) as broken:
        raise Refused("invalid-archive", f"unreadable: {type(broken).__name__}") from broken
    if missing := [f for f in files if f not in seen]:
        raise Refused("invalid-layout", f"missing entry: {missing[0]}")


def check(content: bytes, files: Sequence[str], limits: Limits) -> None:
    if len(content) > limits.packed:
        raise Refused("invalid-archive", "compressed limit")
    for name, read in entries(content, files, limits):
        body = read()
        if name.endswith(".jsonl") and sum(1 for line in body.split(b"\n") if line) > limits.rows:
            raise Refused("invalid-archive", f"row limit exceeded: {name}")


def unpack(archives: DataFrame, files: Sequence[str] = OFFICIAL, limits: Limits = Limits()) -> DataFrame:
    """ENTRY rows of archives (path, content): each entry of an accepted archive, or one row with code and message.

    A null content is an archive that was found too large to be read. Entries are emitted one at a time.
    """
    files = tuple(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, (pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()), strict=True)], ["path", "name", "content", "code", "message"])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                try:
                    if data is None:
                        raise Refused("invalid-archive", "compressed limit")
                    check(data, files, limits)
                except Refused as refused:
                    yield row(path.as_py(), None, None, refused.code, str(refused))
                    continue
                for name, read in entries(data, files, limits):
                    yield row(path.as_py(), name, read(), None, None)

    return archives.select("path", "content").mapInArrow(run, ENTRY)


def archives(spark: SparkSession, root: str, files: Sequence[str] = OFFICIAL, limits: Limits = Limits(), pattern: str = "*.tar.gz") -> DataFrame:
    """unpack() of the archives below a folder. Those larger than the limit are refused by their size and never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    small = found.where(F.col("length") <= limits.packed).select("path", "content")
    large = found.where(F.col("length") > limits.packed).select("path", F.lit(None).cast("binary").alias("content"))
    return unpack(small.unionAll(large), files, limits)


def json_entries(unpacked: DataFrame, name: str, ddl: str) -> DataFrame:
    """Rows of one .jsonl entry of all accepted archives, with the archive's path; a line that doesn't parse fails."""
    lines = unpacked.where(F.col("name") == name).select("path", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    return lines.select("path", F.from_json("line", ddl, {"mode": "FAILFAST"}).alias("r")).select("path", "r.*")
