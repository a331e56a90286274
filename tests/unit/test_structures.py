"""Archives with every kind of fault, layouts by patterns, digests of ordered files, bitmaps against plain sets."""

import gzip
import hashlib
import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from skyledger.operators import stats as ST
from skyledger.operators.layout import layout_violations
from skyledger.sources import archives as A
from skyledger.sources import writers as W

FILES = ("m.json", "n/a.jsonl", "n/b.jsonl")


def packed(entries, cut=0, kind=None):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, body in entries:
            info = tarfile.TarInfo(name)
            if body is None:
                info.type = kind or tarfile.DIRTYPE
                info.linkname = "m.json"
                tar.addfile(info)
            else:
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
    data = buffer.getvalue()
    return data[: len(data) - cut] if cut else data


GOOD = [("m.json", b"{}"), ("n", None), ("n/a.jsonl", b'{"x": 1}\n\n{"x": 2}\n'), ("n/b.jsonl", b"")]


@pytest.mark.parametrize("content,code,message", [
    (packed(GOOD), None, None),
    (packed(GOOD[::-1]), None, None),
    (packed(GOOD[:3]), "invalid-layout", "missing entry: n/b.jsonl"),
    (packed([*GOOD, ("extra", b"x")]), "invalid-layout", "unexpected entry: extra"),
    (packed([*GOOD, ("n/../m.json", b"x")]), "invalid-layout", "unexpected entry: n/../m.json"),
    (packed([*GOOD, ("/m.json", b"x")]), "invalid-layout", "unexpected entry: /m.json"),
    (packed([*GOOD, ("m.json", b"x")]), "invalid-layout", "duplicate entry: m.json"),
    (packed([*GOOD, ("other", None)]), "invalid-archive", "not a regular file: other"),
    (packed([("m.json", None), *GOOD], kind=tarfile.SYMTYPE), "invalid-archive", "not a regular file: m.json"),
    (packed([("m.json", b"y" * 2000), *GOOD[1:]]), "invalid-archive", "entry too large: m.json"),
    (packed([*GOOD[:2], ("n/a.jsonl", b"1\n" * 60), GOOD[3]]), "invalid-archive", "row limit exceeded: n/a.jsonl"),
    (packed(GOOD, cut=30), "invalid-archive", "unreadable: EOFError"),
    (b"no gzip", "invalid-archive", "unreadable: BadGzipFile"),
    (b"", "invalid-archive", None),
    (gzip.compress(b"z" * 30_000), "invalid-archive", None),
    (gzip.compress(bytes(10_000_000)), "invalid-layout", None),
    (None, "invalid-archive", "compressed limit"),
    (b"\x1f\x8b" + bytes(9000), "invalid-archive", "compressed limit"),
])
def test_archives_are_taken_whole_or_refused(spark, content, code, message):
    limits = A.Limits(packed=20_000 if content and content[:2] == b"\x1f\x8b" and len(content) < 9000 or content and len(content) > 9100 else 8000, raw=20_480, entry=1000, rows=50)
    rows = A.unpack(spark.createDataFrame([("p", content)], "path string, content binary"), FILES, limits).collect()
    if code is None:
        assert sorted((r.name, bytes(r.content)) for r in rows) == sorted((n, b) for n, b in GOOD if b is not None) and {r.code for r in rows} == {None}
    else:
        (r,) = rows
        assert r.code == code and r.name is None and (message is None or r.message == message), r


def test_a_bad_archive_spares_the_others(spark, tmp_path):
    for name, data in (("a", packed(GOOD)), ("b", b"junk"), ("c", packed([("m.json", b"3"), *GOOD[1:]])), ("d", bytes(60_000))):
        (tmp_path / f"{name}.tar.gz").write_bytes(data)
    (tmp_path / "e.txt").write_bytes(b"no archive")
    got = A.archives(spark, f"file://{tmp_path}", FILES, A.Limits(packed=50_000)).cache()
    assert sorted((r.path[-8:], r.code, r.message) for r in got.where("code is not null").collect()) == [("b.tar.gz", "invalid-archive", "unreadable: BadGzipFile"), ("d.tar.gz", "invalid-archive", "compressed limit")]
    assert got.where("code is null").count() == 6
    assert sorted((r.path[-8:], r.x) for r in A.json_entries(got, "n/a.jsonl", "x int").collect()) == [("a.tar.gz", 1), ("a.tar.gz", 2), ("c.tar.gz", 1), ("c.tar.gz", 2)]
    assert A.unpack(spark.createDataFrame([], "path string, content binary")).collect() == []


def test_layouts(spark):
    allowed, required = ("manifest.json", "report/report.md", "trials/*/result.json", "trials/*/rounds/*", "*/notes"), ("manifest.json", "report/report.md")
    rows = [
        ("a", "manifest.json"), ("a", "report/report.md"), ("a", "trials/t1/result.json"), ("a", "trials/t1/rounds/0"), ("a", "x/notes"), ("a", "trials/notes"), ("a", "manifest.json"),
        ("b", "manifest.json/x"), ("b", "report"), ("b", "trials/t1"), ("b", "trials//result.json"), ("b", "trials/../notes"), ("b", "trials/t/rounds/0/1"), ("b", "/manifest.json"), ("b", "Manifest.json"), ("b", ""), ("c", None),
    ]
    files = spark.createDataFrame([(*r, "x") for r in rows], "root string, path string, rule string")
    got = sorted(tuple(r) for r in layout_violations(files, allowed, required).collect())
    assert got == sorted([("unexpected", r, p) for r, p in rows if r == "b"] + [("missing", r, p) for r in "bc" for p in required])
    assert layout_violations(files.limit(0), allowed, required).collect() == []


def test_digest_of_an_ordered_file(spark):
    rows = [(i % 7, f"text é {i}", None if i % 3 else 1.5) for i in range(500)] + [(None, "null first", None)] * 3
    df = spark.createDataFrame(rows, "k int, t string, v double").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or 0))
    text = "".join(json.dumps(dict(zip("ktv", r, strict=True)), separators=(",", ":"), ensure_ascii=False) + "\n" for r in want).encode()
    for chunk in (1, 300, 1 << 20):
        (got,) = W.ordered_digest(df, ["k", "t", "v"], chunk=chunk).collect()
        assert (got.rows, got.bytes, got.sha256) == (503, len(text), hashlib.sha256(text).hexdigest())
    (one,) = W.table_digest(df, ["k", "t", "v"]).collect()
    assert (one.rows, one.bytes, one.sha256) == (got.rows, got.bytes, got.sha256)
    (none,) = W.ordered_digest(df.limit(0), ["k"]).collect()
    assert (none.rows, none.bytes, none.sha256) == (0, 0, hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("group", [[], ["g"]])
def test_bitmaps_equal_sets(spark, group):
    rng = random.Random(2)
    rows = [(g, m, t, rng.random() < (0.3 if m < "e" else 0.0)) for g in "xy" for m in "abcdefg" for t in range(40) if rng.random() < 0.8]
    rows += [("x", "h", t, t in (1, 2)) for t in range(40)] + [("x", "i", t, t in (1, 2)) for t in range(0, 40)] + [("x", "h", 1, False)]
    df = spark.createDataFrame(rows, "g string, m string, t int, f boolean")
    key = lambda r: (*(r[c] for c in group), r.left, r.right)
    got = {key(r): r for r in ST.bitmap_overlap(df, group, "m", "t", F.col("f")).collect()}
    want = {key(r): r for r in ST.failure_overlap(df, group, "m", "t", F.col("f")).collect()}
    assert got.keys() == want.keys()
    failed = {}
    for g, m, t, f in rows:
        failed.setdefault((*([g] if group else []), m), set()).update({t} if f else set())
    for k, w in want.items():
        r = got[k]
        assert all(r[c] == w[c] for c in ("shared", "onlyLeft", "onlyRight", "either", "bothPass", "jaccard")), (r, w)
        assert r.equal == (failed[(*k[:-2], k[-2])] == failed[(*k[:-2], k[-1])])
    assert any(r.equal and k[-2] != k[-1] for k, r in got.items())


def test_more_tasks_than_a_bucket_holds(spark):
    rows = spark.range(70_000).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("m"), F.col("id").alias("t"))
    rows = rows.withColumn("f", F.when(F.col("m") == "a", F.col("t") % 2 == 0).otherwise(F.col("t") % 3 == 0))
    got = {(r.left, r.right): r for r in ST.bitmap_overlap(rows, [], "m", "t", F.col("f")).collect()}["a", "b"]
    assert (got.shared, got.onlyLeft, got.onlyRight, got.bothPass, got.equal) == (11667, 23333, 11667, 23333, False)


def test_chunks_of_a_file_are_small(spark, monkeypatch):
    """A batch of 10,000 chunks must fit a worker, however large the file is."""
    kept, plain = [], W.stored
    monkeypatch.setattr(W, "stored", lambda df: kept.append(plain(df)) or kept[-1])
    rows = spark.range(120_000).select("id", F.lit("some text that repeats").alias("text"))
    got = W.ordered_digest(rows, ["id"]).collect()[0]
    text = "".join(f'{{"id":{i},"text":"some text that repeats"}}\n' for i in range(120_000)).encode()
    assert tuple(got) == (120_000, len(text), hashlib.sha256(text).hexdigest())
    assert kept[0].agg(F.max(F.octet_length("body"))).collect()[0][0] < 1 << 15
