"""Exact n-gram Jaccard join with token-combination prefixes, and the components of its links.

A document is the set of its word n-grams, as 64-bit hashes. Equal sets are one node. Tokens are ordered by how often
their hash bucket occurs in all documents, rare ones first; tokens of crowded buckets form the frequent class.

Signatures. Let p = n - ceil(t n) + 1 be the usual prefix of a set of n tokens. Any partner shares at least ceil(t n)
tokens, so its first common token lies within p. If that token is rare, the two share it as a signature. Otherwise all
common tokens are frequent: they are dealt to m subclasses, the prefix is extended to p + m, and among the first m + 1
common tokens, all inside both prefixes, two fall into one subclass. So frequent tokens are indexed as pairs within a
subclass. m follows the size bracket of the larger partner (sizes of partners differ by one bracket at most), which
keeps a set's signatures linear in its prefix.

Linking without all pairs. Each signature's list gets a hub, its most typical node; every node is paired with the hub.
Components of the links found settle most lists. Near texts share many signatures, so of lists of the same nodes one is
kept. Lists that are still open get further hubs from their largest component, with which the nodes outside it are
paired. Of what is open then, every pair across components is looked at: pair by pair for short lists, and there only
in the first list that both nodes are in; in blocks of nodes within a task for long ones, where the nodes outside the
largest component meet all others and those inside it don't meet each other. After that no link between different components
can be missing. Lists of very frequent tokens are salted, and their hubs linked in a second level. Pairs are first
screened by parity sketches, which bound the difference of two sets from below; the rest is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import cut, row_key, slices, tidy

BUCKETS = 1 << 16
SHORT_LIST, CHUNK, HOT_LIST = 128, 512, 20_000
ROUNDS, HUBS = 2, 4  # of further hubs for open lists
BROADCAST_IDS = 500_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SIZE_BITS = (1 << 24) - 1  # node.d2 holds 32 bits of hash, 24 of size (clipped), 8 free


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    return (x ^ (x >> np.uint64(27))) * M2


def token_sets(texts: list[str | None], n: int, known: WordHash) -> list[np.ndarray]:
    """Each text's set of word n-grams as sorted 64-bit hashes; a shorter text is one token, its words with the spaces
    that no word holds between them."""
    split = [t.encode().lower().split() if t else [] for t in texts]  # bytes: lower() takes A-Z, split() ASCII space
    flat = [w for ws in split for w in ws]
    h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    grams = np.zeros(len(h), np.uint64)
    if len(h) >= n:
        x = h[: len(h) - n + 1]
        for j in range(1, n):
            x = mix(x) + h[j : len(h) - n + 1 + j]
        grams[: len(x)] = mix(x)
    out, at = [], 0
    for ws in split:
        k = len(ws)
        if k >= n:
            out.append(np.unique(grams[at : at + k - n + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=k)] if k else [], np.uint64))
        at += k
    return out


def node_of(tokens: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
    d1, high = digest >> 64, digest >> 32 & 0xFFFFFFFF
    d2 = high << 32 | min(len(tokens), SIZE_BITS) << 8
    return d1 - (d1 >> 63 << 64), d2 - (d2 >> 63 << 64)


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def least_size(percent: int) -> int:
    """Smaller sets link with equal ones only: k tokens of k + 1 are too few below this k."""
    return -(-percent // max(1, 100 - percent))


def brackets(percent: int, largest: int = SIZE_BITS + 2) -> np.ndarray:
    """Lower ends of size brackets such that linked sets lie in the same or in neighbouring ones."""
    ends = [1, 2]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, 100 * (ends[-1] - 1) // percent + 1))
    return np.array(ends)


def signatures(tokens: np.ndarray, counts: np.ndarray, hot: float, percent: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A set's signatures, the counts of what they stand on, and how typical the set is (0 most, 255 least)."""
    n = len(tokens)
    times = counts[(tokens % np.uint64(BUCKETS)).astype(np.int64)]
    typical = 255 - int(min(255, 8 * np.log2(times + 1.0).mean()))
    p = n - least_overlap(n, percent) + 1
    order = np.lexsort((tokens, times))
    tokens, times = tokens[order], times[order]
    rare = int(np.searchsorted(times, hot, "right"))
    single = tokens[: min(p, rare)]
    found, weight = [mix(single)], [times[: len(single)]]
    if rare < p:
        own = int(np.searchsorted(ends, n, "right")) - 1
        for b in (own, own + 1):
            low = int(ends[min(b, len(ends) - 1)])
            m = max(1, (low - least_overlap(low, percent) + 1) // 2)
            some, many = tokens[rare : p + m], times[rare : p + m]
            sub = (mix(some) >> np.uint64(33)) % np.uint64(m)
            by = np.lexsort((some, sub))
            some, many, sub = some[by], many[by], sub[by]
            for d in range(1, len(some)):  # pairs at distance d in one subclass; soon there are none
                same = sub[d:] == sub[:-d]
                if not same.any():
                    break
                found.append(mix(mix(some[:-d][same]) + some[d:][same] + np.uint64(b)))
                weight.append(np.minimum(many[:-d], many[d:])[same])
    return np.concatenate(found), np.concatenate(weight), typical


def enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def sketch(tokens: np.ndarray) -> bytes:
    """The parity of how many tokens fall on each of 2^k >= 2 n places. Every place where two sketches differ stands for
    a token of one set only, so they bound the sets' difference from below. Halves fold by exclusive or."""
    bits = max(256, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 256
    parity = np.bincount((mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def fold(x: np.ndarray, length: int) -> np.ndarray:
    while x.shape[-1] > length:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def may_link(x: bytes, y: bytes, n: int, percent: int) -> bool:
    """n: both sets' sizes together. False only if they can't link."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    m = min(len(a), len(b))
    apart = int(np.bitwise_count(fold(a, m) ^ fold(b, m)).sum())
    return apart * (100 + percent) <= (100 - percent) * n


def screened(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b of nodes) that their sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n = batch.column(2), batch.column(3), batch.column(4).to_pylist()
            keep = [n[i] >= SIZE_BITS or may_link(x[i].as_buffer(), y[i].as_buffer(), n[i], percent) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    named = lambda of: sketches.select(F.col("node").alias(of), F.col("sketch").alias(f"{of}_sketch"))
    joined = pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "a_sketch", "b_sketch", (set_size(F.col("a")) + set_size(F.col("b"))).alias("n"))
    return joined.mapInArrow(tidy(run), pairs.select("a", "b").schema)


def set_size(node: Column) -> Column:
    return F.shiftright(node["d2"], 8).bitwiseAND(F.lit(SIZE_BITS))


def similar_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(set_size(a), set_size(b)) * 100 >= F.greatest(set_size(a), set_size(b)) * percent


def verify(pairs: DataFrame, rows: DataFrame, owners: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b of nodes) that link, by their whole sets; sets are made anew for the nodes in pairs only.

    owners: a row's id for each node. Only texts with such ids are split again and shuffled, as sets.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = cut(owners.join(wanted, "node", "left_semi").select(F.col("id").alias("_id")).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            for s in slices(batch.num_rows, 256):
                out = {node_of(x): x for x in token_sets(batch.column(0).slice(s.start, s.stop - s.start).to_pylist(), n, known)}
                yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in out], pa.int64()) for i in (0, 1)), pa.array([x.tobytes() for x in out.values()], pa.binary())], ["d1", "d2", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [enough(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    texts = rows.where("text is not null").join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = cut(texts.mapInArrow(tidy(build), "d1 long, d2 long, tokens binary").select(F.struct("d1", "d2").alias("node"), "tokens"))
    named = lambda of: sets.select(F.col("node").alias(of), F.col("tokens").alias(f"{of}_tokens"))
    return pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "a_tokens", "b_tokens").mapInArrow(tidy(run), pairs.select("a", "b").schema).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached; only nodes with links. Labels jump, so chains go fast."""
    edges = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select("b", "a")).distinct())
    labels = cut(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels.node == near.u).select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        moved = cut(stepped.join(jump, stepped.next == jump["at"], "left").select("node", F.coalesce(F.least("next", "far"), "next").alias("label"), "old"))
        labels = moved.select("node", "label")
        if moved.where("label != old").isEmpty():
            return labels


def distinct_lists(lists: DataFrame) -> DataFrame:
    """lists (sig, node: each once) without those that have the same nodes as another; lists are told apart by 128 bits."""
    hashes = [F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("_s"), F.bit_xor(F.xxhash64(F.lit("second"), "node")).alias("_x"), F.count("*").alias("_n")]
    kept = lists.groupBy("sig").agg(*hashes).groupBy("_s", "_x", "_n").agg(F.min("sig").alias("sig"))
    return lists.join(kept.select("sig"), "sig", "left_semi")


def pairs_across(lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b of nodes) of similar size that a list (sig, node, label) has in different components. A pair comes
    once, from the first list that both nodes are in, as near texts meet in dozens of lists."""
    before = F.collect_list("sig").over(Window.partitionBy("node").orderBy("sig").rowsBetween(Window.unboundedPreceding, -1))
    rows = cut(lists.select("sig", "node", "label", before.alias("before")))
    one, two = (rows.select("sig", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "label", "before")]) for x in "ab")
    a, b = F.col("a_node"), F.col("b_node")
    met = (one["sig"] == two["sig"]) & (a < b) & (F.col("a_label") != F.col("b_label")) & similar_size(a, b, percent) & ~F.arrays_overlap("a_before", "b_before")
    return one.join(two, met).select(a.alias("a"), b.alias("b"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, with_keys: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id reachable by links, itself included).

    Two documents link when 100 * |A & B| >= percent * |A | B| (percent from 80 to 100). Null, empty and blank texts
    have no shingles and link with nothing, so their component is their own id. Rows that repeat are documents of
    their own that link; rows that share an id but not a text are told apart by their text. A row with a null id has a
    null component if it links with nothing else, and doesn't lend its id. Columns other than id_col and text_col are
    ignored. An empty table gives no rows. Whole texts are read; no list, group or set is cut short. with_keys adds
    _k1 and _k2, the hashes by which common.row_key tells rows apart, and _label, the component (null without shingles).
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ends, least = brackets(percent), least_size(percent)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes of rows (part 0; a task gives a node's sketch once), and how often each bucket occurs (part 1: n times,
        bucket d1)."""
        known, counts, id_type, seen = WordHash(), np.zeros(BUCKETS, np.int64), None, set()
        names = ["part", "id", "n", "d1", "d2", "_k1", "_k2", "sketch"]
        for batch in batches:
            id_type = batch.schema.field(0).type
            for s in slices(batch.num_rows, 256):
                some = batch.slice(s.start, s.stop - s.start)
                sets = token_sets(some.column(1).to_pylist(), n, known)
                nodes = [node_of(x) for x in sets]
                sketches = []
                for x, node in zip(sets, nodes, strict=True):
                    if len(seen) >= 100_000:
                        seen.clear()
                    sketches.append(None if node in seen else sketch(x))
                    seen.add(node)
                counts += np.bincount((np.concatenate(sets) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), some.column(0), pa.array([len(x) for x in sets], pa.int64()), *(pa.array([d[i] for d in nodes], pa.int64()) for i in (0, 1)), *some.columns[2:], pa.array(sketches, pa.binary())], names)
        at = counts.nonzero()[0]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.nulls(len(at), id_type), pa.array(counts[at]), pa.array(at), *[pa.array(np.zeros(len(at), np.int64))] * 3, pa.nulls(len(at), pa.binary())], names)

    surveyed = cut(rows.select("id", "text", *row_key(F.col("id"), F.col("text"))).mapInArrow(tidy(survey), f"part int, id {kind}, n long, d1 long, d2 long, _k1 long, _k2 long, sketch binary"))
    members = surveyed.where("part = 0").select("id", "n", F.struct("d1", "d2").alias("node"), "_k1", "_k2", "sketch")
    counts = np.zeros(BUCKETS, np.int64)
    for r in surveyed.where("part = 1").groupBy("d1").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        counts[r.d1] = r.n
    hot = 3 * counts.mean() + 50
    counts_bc = spark.sparkContext.broadcast(counts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHash(), set()
        for batch in batches:
            for s in slices(batch.num_rows, 256):
                sigs, salts, firsts, seconds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for tokens in token_sets(batch.column(0).slice(s.start, s.stop - s.start).to_pylist(), n, known):
                    if len(tokens) < least or (node := node_of(tokens)) in seen:
                        continue
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(node)
                    found, weight, typical = signatures(tokens, counts_bc.value, hot, percent, ends)
                    parts = weight // HOT_LIST
                    sigs.append(found)
                    salts.append(np.where(parts > 0, 1 + node[0] % (parts + 1), 0).astype(np.int32))
                    firsts.append(np.full(len(found), node[0]))
                    seconds.append(np.full(len(found), node[1] | typical))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (salts, firsts, seconds))], ["sig", "salt", "d1", "d2"])

    post = rows.where("text is not null").select("text").mapInArrow(tidy(sign), "sig long, salt int, d1 long, d2 long")
    bare = lambda c: F.struct(c["d1"].alias("d1"), c["d2"].bitwiseAND(F.lit(~255)).alias("d2"))
    ranked = F.struct(F.col("d2").bitwiseAND(F.lit(255)).alias("typical"), "d1", "d2")
    whole = Window.partitionBy("sig", "salt")
    lists = post.withColumn("_hub", F.min(ranked).over(whole)).withColumn("_last", F.max(ranked).over(whole)).withColumn("size", F.count("*").over(whole))
    lists = cut(lists.where("_hub != _last or salt > 0").select("sig", "salt", "size", bare({"d1": F.col("d1"), "d2": F.col("d2")}).alias("node"), bare(F.col("_hub")).alias("hub")))

    tops = lists.where("salt > 0").groupBy("sig").agg(F.min("hub").alias("top"))
    upper = lists.where("salt > 0").select("sig", "hub").distinct().join(tops, "sig").select(F.col("hub").alias("node"), F.col("top").alias("hub"))
    spokes = lists.select("node", "hub").unionAll(upper).where((F.col("node") != F.col("hub")) & similar_size(F.col("node"), F.col("hub"), percent))
    starred = cut(spokes.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())

    listed = lists.select("node").distinct()
    # one row per node and task is left of a group of copies before anything is shuffled
    firsts = members.where("sketch is not null").select("node", "id", "sketch")
    owners = cut(firsts.join(listed, "node", "left_semi").dropDuplicates(["node"]))
    links = cut(verify(cut(screened(starred, owners, percent)), rows, owners, n, percent))
    comps = components(links)

    # lists of two are settled: their only pair was verified; of lists of the same nodes one is kept
    longer = distinct_lists(lists.where("size > 2 or salt > 0").select("sig", "node").distinct())

    def still_open(among: DataFrame) -> DataFrame:
        """The lists with nodes in several components: sig, node, label, size, main (the list's largest component)."""
        placed = cut(among.join(comps, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label")))
        parts = placed.groupBy("sig", "label").agg(F.count("*").alias("n"))
        per = parts.groupBy("sig").agg(F.sum("n").alias("size"), F.count("*").alias("parts"), F.max(F.struct("n", "label"))["label"].alias("main")).where("size > 2 and parts > 1")
        return placed.join(per.drop("parts"), "sig")

    left, tried = cut(still_open(longer)), starred
    for step in range(ROUNDS):
        if left.isEmpty():
            break
        inside = left.where(F.col("label") == F.col("main"))
        hubs = inside.groupBy("sig").agg(F.array(*[F.min(F.struct(F.xxhash64(F.lit(HUBS * step + i), "node"), "node"))["node"] for i in range(HUBS)]).alias("hubs"))
        asked = left.where(F.col("label") != F.col("main")).join(hubs, "sig").select("node", F.explode(F.array_distinct("hubs")).alias("hub")).distinct()
        asked = asked.where(similar_size(F.col("node"), F.col("hub"), percent)).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        asked = cut(asked.join(tried, ["a", "b"], "left_anti"))
        more = cut(verify(cut(screened(asked, owners, percent)), rows, owners, n, percent))
        tried = cut(tried.unionAll(asked))
        if more.isEmpty():
            break
        links = cut(links.unionAll(more))
        comps = components(links)
        left = cut(still_open(left.select("sig", "node")))
    many, short = left.where(F.col("size") > SHORT_LIST), left.where(F.col("size") <= SHORT_LIST)
    across = screened(pairs_across(short, percent).join(tried, ["a", "b"], "left_anti"), owners, percent)

    def within(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs across components that may link, between the two chunks of a cell or inside its only one."""
        out = []
        label = pd.factorize(pd.Series(list(zip(pdf.l1, pdf.l2, strict=True))))[0]
        chunk, sizes = pdf.chunk.to_numpy(), (pdf.d2.to_numpy() >> 8) & SIZE_BITS
        lengths = np.array([len(x) for x in pdf.sketch])
        kinds = {length: np.flatnonzero(lengths == length) for length in np.unique(lengths)}
        arrays = {k: np.stack([np.frombuffer(pdf.sketch[i], np.uint64) for i in at]) for k, at in kinds.items()}
        for k, rows_k in kinds.items():
            for k2 in (k, 2 * k):  # partners' sketches differ by one doubling at most
                if k2 not in kinds:
                    continue
                x, y, rows_2 = arrays[k], fold(arrays[k2], k // 8), kinds[k2]
                for r, i in enumerate(rows_k):
                    total = sizes[i] + sizes[rows_2]
                    good = np.bitwise_count(x[r] ^ y).sum(1, dtype=np.int64) * (100 + percent) <= (100 - percent) * total
                    good |= total >= SIZE_BITS
                    good &= (label[i] != label[rows_2]) & (100 * np.minimum(sizes[i], sizes[rows_2]) >= percent * np.maximum(sizes[i], sizes[rows_2]))
                    if key[1] != key[2]:
                        good &= chunk[i] != chunk[rows_2]
                    if k2 == k:
                        good &= rows_2 > i
                    out.append(np.stack([np.full(int(good.sum()), i), rows_2[good]], 1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        d1, d2 = pdf.d1.to_numpy(), pdf.d2.to_numpy()
        return pd.DataFrame({"a1": d1[pairs[:, 0]], "a2": d2[pairs[:, 0]], "b1": d1[pairs[:, 1]], "b2": d2[pairs[:, 1]]}, dtype="int64")

    # chunks 0 to mains - 1 hold the largest component's nodes, the others the rest; two of the former never meet
    outside = F.col("label") != F.col("main")
    sizes = many.groupBy("sig").agg(*[F.ceil(F.count_if(c) / CHUNK).cast("int").alias(x) for c, x in ((~outside, "mains"), (outside, "rests"))])
    chunk = lambda of: F.pmod(F.xxhash64("node"), of).cast("int")
    dealt = many.join(sizes, "sig").withColumn("chunk", F.when(outside, F.col("mains") + chunk(F.col("rests"))).otherwise(chunk(F.col("mains"))))
    dealt = dealt.withColumn("_from", F.when(outside, 0).otherwise(F.col("mains"))).join(owners.select("node", "sketch"), "node")
    cells = dealt.withColumn("other", F.explode(F.sequence(F.col("_from"), F.col("mains") + F.col("rests") - 1))).select(
        "sig", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", "node.d1", "node.d2", F.col("label.d1").alias("l1"), F.col("label.d2").alias("l2"), "sketch"
    )
    blocks = cells.groupBy("sig", "c1", "c2").applyInPandas(within, "a1 long, a2 long, b1 long, b2 long")
    x, y = (F.struct(F.col(f"{c}1").alias("d1"), F.col(f"{c}2").alias("d2")) for c in "ab")
    blocks = blocks.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    found = cut(verify(cut(across.unionAll(blocks).distinct()), rows, owners, n, percent))
    if not found.isEmpty():
        comps = components(links.unionAll(found))

    labelled = members.join(comps, "node", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"), "_k1", "_k2")
    # written, so that both sides of the join below are plain exchanges and a large group's rows can be split
    smallest = cut(labelled.where("label is not null").groupBy("label").agg(F.min("id").alias("least")))
    out = labelled.join(smallest, "label", "left")
    keys = [F.col("_k1"), F.col("_k2"), F.col("label").alias("_label")] if with_keys else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), *keys)
