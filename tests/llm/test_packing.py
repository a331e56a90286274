import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from skyledger.llm.packing import Packer, encoder, pack_examples

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int, start string, prompt string"


def check(rows, texts, capacity, segments, end=1):
    tok = Tokenizer.from_file(PATH)
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, end] for k, t in texts.items()}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert docs.keys() == ids.keys()
    for k, pieces in docs.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[k])
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[k][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[k])
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity and len(pieces) <= segments


def test_round_trip_and_limits(spark):
    texts = {i: t for i, t in enumerate([None, "", "  \n", "It's Ärger, don't! ÉCOLE 3.14%%%", "漢字 <|endoftext|> Ⅷ ǅ İstanbul", "word " * 9000, "x" * 3000, *[f"number {i} of many" for i in range(300)]])}
    df = spark.createDataFrame([(k, t, 1, "clash", "p") for k, t in texts.items()], SCHEMA).repartition(2)
    rows = pack_examples(df, PATH, capacity=256, max_segments=8).collect()
    check(rows, texts, 256, 8)


def test_prompt_loss_and_ids(spark):
    df = spark.createDataFrame([(1, "answer one two three", 0, "", "a long prompt of words"), (1, "answer one two three", 0, "", "a long prompt of words"), (None, None, 0, "", None)], SCHEMA)
    rows = pack_examples(df, PATH, capacity=8, max_loss=3, prompt_col="prompt", with_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    p, t = (tok.encode(x, add_special_tokens=False).ids for x in ("a long prompt of words", "answer one two three"))
    by = defaultdict(lambda: [0, 0])
    for r in rows:
        by[r.sequence_id][0] += r.length
        by[r.sequence_id][1] += r.loss_tokens
        if r.doc_id == 1:
            assert r.ids == (p + t + [1])[r.start : r.start + r.length]
    assert sum(r.length for r in rows) == 2 * len(p + t + [1]) + 1
    assert sum(r.loss_tokens for r in rows) == 2 * len(t + [1]) + 1
    assert all(n <= 8 and loss <= 3 for n, loss in by.values())


def test_empty_table(spark):
    assert pack_examples(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_padding_is_small(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = defaultdict(int)
    for r in pack_examples(df, PATH).collect():
        n[r.sequence_id] += r.length
    assert sum(0 if x & (x - 1) == 0 else 2048 - x for x in n.values()) <= 0.002 * sum(n.values())


def test_same_ids_as_library():
    table, tok = encoder(PATH), Tokenizer.from_file(PATH)
    for text in ["don't we'll I'VE", "naïve façade ñandú ß", "á é", "\x85a\xa0b", "０１２ ①", "tab\tvt\x0bff\x0c", "don''s '", "'S 'LL", " x", "a\x1cb"]:
        assert np.frombuffer(table.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_segment_limit():
    bins = []
    p = Packer(10, 2, 10, bins.append)
    for i in range(25):
        p.add(i, 1, 0)
    p.finish()
    assert sorted(x[0] for b in bins for x in b) == list(range(25)) and max(map(len, bins)) <= 2


def test_short_documents_leave_little_padding():
    rng = np.random.default_rng(0)
    for sizes in (np.full(20_000, 10), np.full(5000, 1), rng.integers(1, 40, 8000), rng.integers(1, 3000, 2000)):
        bins = []
        p = Packer(2048, 2048, 2048, bins.append)
        for i, n in enumerate(sizes):
            p.add(i, int(n), 0)
        p.finish()
        lengths = [sum(b - a for _, a, b in x) for x in bins]
        assert sum(lengths) == sizes.sum() and max(lengths) <= 2048
        assert sum(0 if x & (x - 1) == 0 else 2048 - x for x in lengths) <= 0.001 * sizes.sum()


def test_no_tokenizer_outlives_its_task(spark):
    import gc

    def left(batches):
        from skyledger.llm.packing import ChunkIds

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, ChunkIds) for x in gc.get_objects())])], ["n"])

    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(8)], "doc_id long, text string").repartition(4)
    assert pack_examples(docs, public_tokenizers.path("word_bpe_49k.json")).count() >= 8
    found = [r.n for r in spark.range(0, 400, 1, 8).mapInArrow(left, "n long").collect()]  # the same workers
    assert found and set(found) == {0}
