"""Language-model scoring: a Katz back-off bigram model over whole corpora.

Texts are read once and kept as blocks of integers: the hashes of a block's distinct words, its tokens as places in that
list, and the lengths of its texts. Everything after that is made of blocks.

Counting: words, and pairs of consecutive tokens, are counted per block and merged by key. Pairs live in a table of parts
(a row each, arrays packed) that is dealt out by the first word, and by both for the most frequent first words.
Fitting: counts up to k are discounted by Good-Turing. A word's back-off weight is what its continuations leave, over
what the unigrams give to all words that were not seen after it, so that every distribution sums to one:

    P(w | v) = d(n) n / n(v)         if the pair (v, w) was seen n times
             = a(v) P(w)             otherwise; a(v) = 1 where nothing was seen after v
    P(w)     = d(c) c / N            if w was seen c times
             = what is left, for an unknown word

Scoring follows that recursion token by token. Frequent words and pairs are broadcast (bounded numbers of them); tokens
of other pairs go to their part and are settled there; what then still depends on a rare word is a join with the table
of rare words. Words are told apart by 62-bit hashes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut, release, tidy

#: Frequent words and pairs that are broadcast; tokens of a block and pairs of a part, about.
HOT_WORDS = 1 << 19
HOT_PAIRS = 1 << 19
BLOCK_TOKENS = 1_000_000  # so a block has fewer than 2 ** 22 texts
PART_PAIRS = 1_000_000
#: Contexts among so many most frequent words (and the start of a text) are dealt over all parts.
SPREAD = 4096
START = -1
HASHED = 1 << 62
#: Largest count that Good-Turing discounts.
LARGEST = 5

BLOCK = "block long, hashes binary, tokens binary, lengths binary, learned binary, ids array<string>"
PACKED = "part int, ctx binary, suf binary, n binary, n_all binary"
#: What blocks and parts tell each other: a block's texts (ids), a question about pairs (ctx, suf) or about rare words
#: (code, role, and the block of each), or sums for a block's texts (at).
MESSAGE = "part int, block long, at binary, ctx binary, suf binary, code binary, role binary, blocks binary, ids array<string>, learned binary, n_tokens binary, known binary, base binary, score binary"
WORDS = "part int, code binary, n binary, p binary, a binary, t binary"
TOTAL = "id string, learned boolean, n_tokens long, n_known long, base_score double, score double"
#: A rare word's roles in a token: context of a pair that was seen, of one that was not, the word itself, and alone.
GIVEN, BACKED, WORD, ALONE = 1, 2, 4, 8


def pack(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: small ones take little room."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(packed: bytes, kind: type = np.int64) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(packed[8:], n, "zstd", asbytes=True), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """pack() of the steps between numbers that mostly rise."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(packed: bytes, kind: type = np.int64) -> np.ndarray:
    return np.cumsum(unpack(packed, kind), dtype=kind)


def arrow_type(name: str) -> pa.DataType:
    return {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[name]


def record_batch(schema: str, columns: dict) -> pa.RecordBatch:
    """columns by the schema; those that are missing are null."""
    fields = [f.split(" ") for f in schema.split(", ")]
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[name], arrow_type(kind)) if name in columns else pa.nulls(n, arrow_type(kind)) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


class Places(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def encode(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of docs. Tokens are the runs of anything but ASCII white space, A-Z lower-cased, and an end for each text.

    learn says of which rows a model may learn (null: not). A null or empty text is an end alone. Ids may be null and
    repeat; other columns are ignored.
    """
    picked = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0

        def block() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) & (HASHED - 1) | HASHED for w in places), np.int64, len(places))
            columns = {
                "block": [task << 18 | number], "hashes": [hashes.tobytes()], "tokens": [pack(np.frombuffer(tokens, np.int32))],
                "lengths": [pack(np.array(lengths, np.int32))], "learned": [pack(np.array(learned, np.int8))], "ids": [ids],
            }
            return record_batch(BLOCK, columns)

        def fresh() -> tuple:
            return Places({b"": 0}), array("i"), [], [], []

        places, tokens, lengths, learned, ids = fresh()
        for batch in batches:
            for i, text, known in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                before = len(tokens)
                tokens.extend(map(places.__getitem__, text.lower().split()))
                tokens.append(0)
                lengths.append(len(tokens) - before)
                learned.append(known)
                ids.append(i)
            if len(tokens) >= BLOCK_TOKENS:
                yield block()
                number += 1
                places, tokens, lengths, learned, ids = fresh()
        if ids:
            yield block()

    return picked.mapInArrow(tidy(run), BLOCK)


class Block:
    """A block's arrays."""

    def __init__(self, row: dict):
        self.block, self.ids = row["block"], row["ids"]
        self.hashes = np.frombuffer(row["hashes"], np.int64)
        self.tokens = unpack(row["tokens"], np.int32)
        self.lengths = unpack(row["lengths"], np.int32).astype(np.int64)
        self.learned = unpack(row["learned"], np.int8).astype(bool)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def coded(self, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes of START and of the distinct words, in order; tokens as places in them; and pairs: per token the
        place of the one before times the number of codes, plus its own."""
        code = codes.of(self.hashes)
        order = np.argsort(code)
        place = np.empty(len(code), np.int64)
        place[order] = np.arange(1, len(code) + 1)
        tokens = place[self.tokens]
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = 0
        return np.append(START, code[order]), tokens, before * (len(code) + 1) + tokens


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


class Codes(NamedTuple):
    """Frequent words: hashes in order, and the rank of each, which is its code. Other words' codes are their hashes."""

    hashes: np.ndarray
    ranks: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = hashes.copy()
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            same = self.hashes[at] == hashes
            out[same] = self.ranks[at[same]]
        return out


def frequent(counts: DataFrame, n: Column, most: int) -> float:
    """A bound on n that most rows of counts reach at most. Bounds are a fourth of an octave apart."""
    rows = counts.groupBy(F.floor(4 * F.log2(n)).alias("b")).agg(F.count("*").alias("n")).where("b >= 0").collect()  # 256 rows at most
    bound, seen = 2.0**63, 0
    for b, many in sorted(((r.b, r.n) for r in rows), reverse=True):
        seen += many
        if seen > most:
            break
        bound = 2 ** (b / 4)
    return bound


def discounts(having: dict[int, int], largest: int = LARGEST) -> np.ndarray:
    """Katz's d(0..k) from the numbers of types that were seen once, twice, ...: the largest k up to largest for which
    all lie in (0, 1]; none (k = 0) if there is no such k."""
    for k in range(largest, 0, -1):
        if all(having.get(r, 0) > 0 for r in range(1, k + 2)):
            rest = (k + 1) * having[k + 1] / having[1]
            if rest < 1:
                d = [((r + 1) * having[r + 1] / (having[r] * r) - rest) / (1 - rest) for r in range(1, k + 1)]
                if all(0 < x <= 1 for x in d):
                    return np.array([1.0, *d])
    return np.array([1.0])


def discounted(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n < len(d), d[np.minimum(n, len(d) - 1)], 1.0) * n


def part_of(ctx: np.ndarray, suf: np.ndarray, parts: int) -> np.ndarray:
    mixed = (ctx + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= np.where(ctx < SPREAD, (suf + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def by_part(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Ranges of a sorted part column."""
    for a, b in pairwise([*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]):
        yield int(part[a]), slice(a, b)


def learned_pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those pairs (ctx, suf, n) of a packed row that were learned, in order."""
    ctx, suf, n = unpack_sorted(row["ctx"]), unpack(row["suf"]), unpack(row["n"])
    some = n > 0
    return ctx[some], suf[some], n[some]


class KatzModel(NamedTuple):
    """pairs: rows of PACKED, a row a part. rare: (code, n, p, a, t) of words that are not broadcast. The rest is bounded."""

    pairs: DataFrame
    rare: DataFrame
    codes: Codes
    parts: int
    tokens: int  # N
    types: int  # V
    d: np.ndarray  # discounts of pairs
    n: np.ndarray  # per frequent word: its count, log10 P, log10 a and log10 n(v); the last entry of the latter is START's
    p: np.ndarray
    a: np.ndarray
    t: np.ndarray
    unknown: float  # log10 P of an unknown word
    pair_keys: np.ndarray  # frequent pairs of frequent words, and log10 P of each
    pair_scores: np.ndarray


def merge_pairs(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    ctx = np.concatenate([unpack_sorted(r["ctx"]) for r in rows])
    suf, n, n_all = (np.concatenate([unpack(r[c]) for r in rows]) for c in ("suf", "n", "n_all"))
    order = np.lexsort((suf, ctx))
    ctx, suf = ctx[order], suf[order]
    first = np.flatnonzero(np.append(True, (ctx[1:] != ctx[:-1]) | (suf[1:] != suf[:-1])))
    n, n_all = (np.add.reduceat(x[order], first) for x in (n, n_all))
    columns = {"part": [rows[0]["part"]], "ctx": [pack_sorted(ctx[first])], "suf": [pack(suf[first])], "n": [pack(n)], "n_all": [pack(n_all)]}
    return pa.Table.from_batches([record_batch(PACKED, columns)])


def count_pairs(blocks: DataFrame, codes, parts: int) -> DataFrame:
    """Rows of PACKED: each pair of consecutive codes with how often it was learned and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_in(batches):
            code, _, pairs = block.coded(codes.value)
            seen, times = np.unique(pairs * 2 + np.repeat(block.learned, block.lengths), return_counts=True)
            pair = seen >> 1
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            n_all, n = np.add.reduceat(times, first), np.add.reduceat(times * (seen & 1), first)
            ctx, suf = code[pair[first] // len(code)], code[pair[first] % len(code)]
            part = part_of(ctx, suf, parts)
            order = np.argsort(part, kind="stable")
            ctx, suf, n, n_all = (x[order] for x in (ctx, suf, n, n_all))
            out: dict[str, list] = {k: [] for k in ("part", "ctx", "suf", "n", "n_all")}
            for number, where in by_part(part[order]):
                out["part"].append(number)
                out["ctx"].append(pack_sorted(ctx[where]))
                for k, x in (("suf", suf), ("n", n), ("n_all", n_all)):
                    out[k].append(pack(x[where]))
            yield record_batch(PACKED, out)

    return blocks.mapInArrow(tidy(run), PACKED).groupBy("part").applyInArrow(merge_pairs, PACKED)


def count_words(blocks: DataFrame) -> DataFrame:
    """(h, n, n_all) of each word's hash: how often it was learned and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_in(batches):
            width, known = len(block.hashes), np.repeat(block.learned, block.lengths)
            n, n_all = np.bincount(block.tokens[known], minlength=width), np.bincount(block.tokens, minlength=width)
            yield record_batch("h long, n long, n_all long", {"h": block.hashes, "n": n, "n_all": n_all})

    return blocks.mapInArrow(tidy(run), "h long, n long, n_all long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def fit_katz(blocks: DataFrame, *, largest: int = LARGEST, hot_words: int = HOT_WORDS, hot_pairs: int = HOT_PAIRS) -> KatzModel:
    """A model of the learned texts of blocks (see encode). hot_words and hot_pairs bound what is broadcast, not results."""
    spark = blocks.sparkSession
    words = cut(count_words(blocks))
    few = [F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, largest + 2)]
    got = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_all"), F.lit(0)).alias("all"), F.count_if(F.col("n") > 0).alias("types"), *few).first()
    tokens, types, d1 = int(got.tokens), got.types, discounts({r: got[f"n{r}"] for r in range(1, largest + 2)}, largest)

    # unigrams: what the discounts take, or one count if they take none, is left to the unknown word
    kept = tokens - sum((1 - d1[r]) * r * got[f"n{r}"] for r in range(1, len(d1)))
    over, left = (tokens, tokens - kept) if kept < tokens else (tokens + 1, 1.0)
    unknown = float(np.log10(left / over))
    log_p = lambda n: np.where(n > 0, np.log10(np.maximum(discounted(d1, n), 1e-300) / over), unknown)

    bound = frequent(words, F.col("n_all"), hot_words)
    top = words.where(F.col("n_all") >= bound).toPandas().sort_values(["n_all", "h"], ascending=[False, True])  # hot_words rows at most
    order = np.argsort(top.h.to_numpy(np.int64))
    codes = Codes(top.h.to_numpy(np.int64)[order], order.astype(np.int64))
    hot, n = len(top), top.n.to_numpy(np.int64)
    p = log_p(n)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(got["all"]) // (2 * PART_PAIRS)))
    shared = spark.sparkContext.broadcast(codes)
    pairs = cut(count_pairs(blocks, shared, parts))
    shared.destroy()
    release(spark)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seen = np.bincount(np.minimum(unpack(row["n"]), largest + 2), minlength=largest + 3)
                octaves = np.bincount(np.floor(4 * np.log2(unpack(row["n_all"]))).astype(int))
                kinds, values = np.repeat([0, 1], [len(seen), len(octaves)]), np.append(np.arange(len(seen)), np.arange(len(octaves)))
                yield record_batch("kind long, v long, n long", {"kind": kinds, "v": values, "n": np.append(seen, octaves)})

    tally = pairs.mapInArrow(tidy(numbers), "kind long, v long, n long").groupBy("kind", "v").agg(F.sum("n").alias("n")).collect()
    d2 = discounts({r.v: r.n for r in tally if r.kind == 0 and 0 < r.v <= largest + 1}, largest)
    pair_bound, seen = 2.0**63, 0
    for v, many in sorted(((r.v, r.n) for r in tally if r.kind == 1), reverse=True):
        seen += many
        if seen > hot_pairs:
            break
        pair_bound = 2 ** (v / 4)

    # contexts: what the discounts keep, and what the unigrams give to the words that follow
    prob = np.power(10.0, p)
    known = spark.sparkContext.broadcast(prob)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ctx, suf, n = learned_pairs(row)
                if len(ctx):
                    first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
                    low = np.zeros(len(suf))
                    low[suf < hot] = known.value[suf[suf < hot]]
                    total, kept, low = (np.add.reduceat(x, first) for x in (n, discounted(d2, n), low))
                    yield record_batch("ctx long, total long, kept double, low double", {"ctx": ctx[first], "total": total, "kept": kept, "low": low})

    def rare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ctx, suf, _ = learned_pairs(row)
                yield record_batch("ctx long, h long", {"ctx": ctx[suf >= hot], "h": suf[suf >= hot]})

    def given(n: Column) -> Column:
        """P of a word that was learned n times."""
        d = F.element_at(F.array(*[F.lit(float(x)) for x in d1]), F.least(n, F.lit(len(d1) - 1)).cast("int") + 1)
        return F.when(n == 0, F.lit(left / over)).when(n < len(d1), d * n / over).otherwise(n / F.lit(over))

    rare_words = words.where(F.col("n_all") < bound)
    rest = pairs.mapInArrow(tidy(rare_pairs), "ctx long, h long").join(rare_words, "h").groupBy("ctx").agg(F.sum(given(F.col("n"))).alias("low"))
    whole = pairs.mapInArrow(tidy(sums), "ctx long, total long, kept double, low double").unionByName(rest.select("ctx", F.lit(0).cast("long").alias("total"), F.lit(0.0).alias("kept"), "low"))
    contexts = whole.groupBy("ctx").agg(*[F.sum(c).alias(c) for c in ("total", "kept", "low")])
    some = F.col("kept") < F.col("total") * (1 - 1e-12)  # else nothing was discounted, and one more count is left over
    over_v = F.when(some, F.col("total")).otherwise(F.col("total") + 1)
    left_v = F.when(some, F.col("total") - F.col("kept")).otherwise(F.lit(1.0)) / over_v
    contexts = cut(contexts.select("ctx", F.log10(left_v / F.greatest(1 - F.col("low"), F.lit(left / over))).alias("a"), F.log10(over_v).alias("t")))
    known.destroy()
    a, t = np.zeros(hot + 1), np.zeros(hot + 1)
    of_hot = contexts.where(F.col("ctx") < hot).toPandas()  # hot_words rows at most
    a[of_hot.ctx.to_numpy(np.int64)], t[of_hot.ctx.to_numpy(np.int64)] = of_hot.a, of_hot.t
    rare = rare_words.select(F.col("h").alias("code"), "n", F.log10(given(F.col("n"))).alias("p"))
    rare = cut(rare.join(contexts.select(F.col("ctx").alias("code"), "a", "t"), "code", "left"))
    release(spark)

    def frequent_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ctx = unpack_sorted(row["ctx"])
                suf, n, n_all = (unpack(row[c]) for c in ("suf", "n", "n_all"))
                some = (n_all >= pair_bound) & (ctx < hot) & (suf < hot)
                yield record_batch("key long, n long", {"key": (ctx[some] + 1) << 32 | suf[some], "n": n[some]})

    chosen = pairs.mapInArrow(tidy(frequent_pairs), "key long, n long").toPandas().sort_values("key")  # hot_pairs rows at most
    keys, times = chosen.key.to_numpy(np.int64), chosen.n.to_numpy(np.int64)
    ctx, suf = (keys >> 32) - 1, keys & 0xFFFFFFFF
    scores = np.where(times > 0, np.log10(np.maximum(discounted(d2, times), 1e-300)) - t[ctx], a[ctx] + p[suf]) if len(keys) else np.zeros(0)
    return KatzModel(pairs, rare, codes, parts, tokens, types, d2, n, p, a, t, unknown, keys, scores)


def score_katz(blocks: DataFrame, model: KatzModel) -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score) of each text of blocks, one row a text.

    n_known counts tokens that were learned, base_score is the add-one unigram log10 probability, score the model's.
    Messages go from blocks to the parts of the pairs, from there to the parts of the rare words, and back to the blocks.
    """
    spark, hot, parts, d = blocks.sparkSession, len(model.n), model.parts, model.d
    smallest = -float(np.log10(model.tokens + model.types + 1.0))
    unknown = model.unknown
    shared = spark.sparkContext.broadcast((model.codes, model.n, model.p, model.a, model.t, model.pair_keys, model.pair_scores))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, *_, keys, scores = shared.value
        for block in blocks_in(batches):
            code, tokens, pairs = block.coded(codes)
            frequent = (code >= 0) & (code < hot)
            base, known = np.zeros(len(code)), np.zeros(len(code), np.int64)
            base[frequent] = np.log10(n[code[frequent]] + 1.0) + smallest
            known[frequent] = n[code[frequent]] > 0
            pair, at = np.unique(pairs, return_inverse=True)
            ctx, suf = code[pair // len(code)], code[pair % len(code)]
            value, settled = np.zeros(len(pair)), np.zeros(len(pair), bool)
            if len(keys):
                both = (ctx < hot) & (suf < hot)
                key = (ctx[both] + 1) << 32 | suf[both]
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                settled[both] = keys[place] == key
                value[both] = np.where(keys[place] == key, scores[place], 0.0)
            per_text = lambda x: np.add.reduceat(x, block.starts)
            sums = {"n_tokens": block.lengths, "known": per_text(known[tokens]), "base": per_text(base[tokens]), "score": per_text(value[at])}
            yield record_batch(MESSAGE, {"part": [block.block % parts], "block": [block.block], "ids": [block.ids], "learned": [pack(block.learned.astype(np.int8))]} | {k: [pack(v)] for k, v in sums.items()})
            still = np.flatnonzero(~settled[at])
            text = np.repeat(np.arange(len(block.lengths), dtype=np.int32), block.lengths)[still]
            at = at[still]
            part = part_of(ctx, suf, parts)[at]
            order = np.lexsort((at, part))
            at, text = at[order], text[order]
            out: dict[str, list] = {k: [] for k in ("part", "block", "ctx", "suf", "at")}
            for number, where in by_part(part[order]):
                out["part"].append(number)
                out["block"].append(block.block)
                out["ctx"].append(pack_sorted(ctx[at[where]]))
                out["suf"].append(pack(suf[at[where]]))
                out["at"].append(pack(text[where]))
            if out["part"]:
                yield record_batch(MESSAGE, out)

    def settle_pairs(held: pa.Table, asked: pa.Table) -> pa.Table:
        """Sums of what frequent words and the pair's count settle; questions about rare words, of all blocks together."""
        _, _, p, a, t, _, _ = shared.value
        mix = lambda ctx, suf: (ctx + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + suf.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        own = [learned_pairs(r) for r in held.to_pylist()]
        ctx, suf, n = (np.concatenate([x[i] for x in own]) if own else np.zeros(0, np.int64) for i in range(3))
        keys = mix(ctx, suf)
        order = np.argsort(keys)
        keys, ctx, suf, n = keys[order], ctx[order], suf[order], n[order]
        out = passed_on(asked, "ctx")
        open_words: list[tuple[np.ndarray, ...]] = []
        for row in asked.filter(pc.is_valid(asked["ctx"])).to_pylist():
            block, v, w, text = row["block"], unpack_sorted(row["ctx"]), unpack(row["suf"]), unpack(row["at"], np.int32)
            times = np.zeros(len(v), np.int64)
            if len(keys):
                key = mix(v, w)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                same = (keys[at] == key) & (ctx[at] == v) & (suf[at] == w)
                times[same] = n[at[same]]
            seen, hot_v, hot_w = times > 0, v < hot, w < hot
            value = np.zeros(len(v))
            value[seen] = np.log10(discounted(d, times[seen]))
            value[seen & hot_v] -= t[v[seen & hot_v]]
            value[~seen & hot_v] += a[v[~seen & hot_v]]
            value[~seen & hot_w] += p[w[~seen & hot_w]]
            out.append(summed(block, parts, text, score=value))
            code = np.concatenate([v[~hot_v], w[~hot_w]])
            role = np.concatenate([np.where(seen, GIVEN, BACKED)[~hot_v], np.where(seen, WORD, WORD | ALONE)[~hot_w]]).astype(np.int8)
            open_words.append((code, role, np.concatenate([text[~hot_v], text[~hot_w]]), np.full(len(code), block)))
        if open_words:
            code, role, text, block = (np.concatenate(x) for x in zip(*open_words, strict=True))
            part = part_of(code, code, parts)
            order = np.lexsort((code, part))
            columns: dict[str, list] = {k: [] for k in ("part", "code", "role", "at", "blocks")}
            for number, where in by_part(part[order]):
                rows = order[where]
                columns["part"].append(number)
                columns["code"].append(pack_sorted(code[rows]))
                for k, x in (("role", role), ("at", text), ("blocks", block)):
                    columns[k].append(pack(x[rows]))
            if columns["part"]:
                out.append(record_batch(MESSAGE, columns))
        return pa.Table.from_batches(out or [record_batch(MESSAGE, {"part": []})])

    def settle_words(held: pa.Table, asked: pa.Table) -> pa.Table:
        """Sums of what rare words add: as a context, seen with the next word or not, and as a word."""
        rows = held.to_pylist()
        code, n = (np.concatenate([unpack(r[c]) for r in rows]) if rows else np.zeros(0, np.int64) for c in ("code", "n"))
        p, a, t = (np.concatenate([unpack(r[c], np.float64) for r in rows]) if rows else np.zeros(0) for c in "pat")
        order = np.argsort(code)
        # the last entry stands for words that are not in the table
        code, n, p, a, t = code[order], np.append(n[order], 0), np.append(p[order], unknown), np.append(a[order], 0.0), np.append(t[order], 0.0)
        out = passed_on(asked, "code")
        rows = asked.filter(pc.is_valid(asked["code"])).to_pylist()
        if rows:
            wanted = np.concatenate([unpack_sorted(r["code"]) for r in rows])
            role, text, block = (np.concatenate([unpack(r[c], k) for r in rows]) for c, k in (("role", np.int8), ("at", np.int32), ("blocks", np.int64)))
            at = np.searchsorted(code, wanted)
            there = at < len(code)
            there[there] = code[at[there]] == wanted[there]
            at[~there] = len(code)
            score = (role & BACKED > 0) * a[at] - (role & GIVEN > 0) * t[at] + (role & ALONE > 0) * p[at]
            word = role & WORD > 0
            base, known = word * (np.log10(n[at] + 1.0) + smallest), (word & (n[at] > 0)).astype(float)
            order = np.argsort(block, kind="stable")
            for first, last in pairwise([*np.flatnonzero(np.diff(block[order], prepend=-1)), len(order)]):
                some = order[first:last]
                out.append(summed(int(block[some[0]]), parts, text[some], score=score[some], base=base[some], known=known[some]))
        return pa.Table.from_batches(out or [record_batch(MESSAGE, {"part": []})])

    def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            p, a, t = (pc.fill_null(batch.column(i), 0.0).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            part = part_of(code, code, parts)
            order = np.argsort(part, kind="stable")
            columns: dict[str, list] = {k: [] for k in ("part", "code", "n", "p", "a", "t")}
            for number, where in by_part(part[order]):
                columns["part"].append(number)
                for k, x in (("code", code), ("n", n), ("p", p), ("a", a), ("t", t)):
                    columns[k].append(pack(x[order[where]]))
            yield record_batch(WORDS, columns)

    asked = blocks.mapInArrow(tidy(ask), MESSAGE)
    met = model.pairs.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(settle_pairs, MESSAGE)
    words = model.rare.select("code", "n", "p", "a", "t").mapInArrow(tidy(pack_words), WORDS)
    known = words.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(settle_words, MESSAGE)
    totals = known.groupBy("block").applyInArrow(total, TOTAL)
    return totals.select("id", "learned", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def passed_on(asked: pa.Table, column: str) -> list[pa.RecordBatch]:
    """The messages that a stage has no question in."""
    return asked.filter(pc.is_null(asked[column])).to_batches()


def summed(block: int, parts: int, text: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    """A message to a block: what is added to the values of its texts, summed by text."""
    texts, at = np.unique(text, return_inverse=True)
    return record_batch(MESSAGE, {"part": [block % parts], "block": [block], "at": [pack_sorted(texts)]} | {k: [pack(np.bincount(at, v))] for k, v in values.items()})


def total(group: pa.Table) -> pa.Table:
    """The texts of a block with all that was added to their values, in the order of the messages' parts of texts."""
    rows = group.to_pylist()
    (own,) = [r for r in rows if r["ids"] is not None]
    known, base, score = unpack(own["known"]).astype(float), unpack(own["base"], np.float64).copy(), unpack(own["score"], np.float64).copy()
    for r in rows:
        if r["ids"] is None:
            at = unpack_sorted(r["at"], np.int32)
            for sums, name in ((known, "known"), (base, "base"), (score, "score")):
                if r[name] is not None:
                    sums[at] += unpack(r[name], np.float64)
    columns = {"id": own["ids"], "learned": unpack(own["learned"], np.int8).astype(bool), "n_tokens": unpack(own["n_tokens"]), "n_known": known.astype(np.int64), "base_score": base, "score": score}
    return pa.Table.from_batches([record_batch(TOTAL, columns)])
