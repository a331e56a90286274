"""Conversation prefix trie by an LCP-aware external mergesort.

A conversation is a path of turns, 16 bytes of hash each, so that texts are read once and never compared or shuffled
again. Tasks sort bounded runs of paths; a run keeps, for each path, how many turns it shares with the one before (its
LCP) and only the turns after those. Runs are cut at splitters into ranges of paths. Per range a loser tree merges the
runs by their LCPs, so turns that are known to be shared are not compared again, and the merged stream goes over the
open path: a stack of nodes, which are finished when the stream leaves them.

Nodes on the first and last path of a range may go on in its neighbours. Those (ranges times depth at most) are summed
by the digest of their path and rolled up at the end; any other node is whole within its range. A hot first turn, even
of all conversations, is such a node, and what hangs below it is spread over the ranges.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import cut, tidy

WIDTH = 16
#: Bytes of paths in a run and in a range; turns of a sampled path that a splitter has at most.
RUN_BYTES = 16 << 20
RANGE_BYTES = 48 << 20
SPLITTER_TURNS = 256
NODE = "digest binary, parent binary, depth long, conv_id long, parent_conv_id long, n long, children long, leaves long, saved long, size long, open boolean"


def turn_paths(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, path, sizes): each conversation's turns in order, as hex digits of their hashes and bytes of their texts.

    Turns are ordered by turn (null first), those that tie by role and text; a null role or text is empty; rows without
    an id belong to no conversation. Other columns are ignored.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turn = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    placed = rows.select("conv_id", F.row_number().over(order).alias("p"), turn.alias("h"), F.octet_length("text").alias("b"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("p", "h", "b"))).alias("t"))
    return grouped.select("conv_id", F.array_join(F.transform("t", lambda x: x["h"]), "").alias("path"), F.transform("t", lambda x: x["b"]).alias("sizes"))


def with_openings(paths: DataFrame, base: Column, turns: Column) -> DataFrame:
    """paths whose first turns come from another conversation: base is its id and turns says how many, of all it has.

    What follows is the conversation's own turns after as many. Where there is no base, nothing comes from it.
    """
    digits = 2 * WIDTH
    own = paths.select("*", base.alias("_base"), turns.cast("int").alias("_h"))
    bases = paths.select(F.col("conv_id").alias("_base"), F.col("path").alias("_path"), F.col("sizes").alias("_sizes"))
    both = own.join(bases, "_base", "left")
    path = F.concat(F.substring(F.coalesce("_path", F.lit("")), F.lit(1), digits * F.col("_h")), F.substring("path", digits * F.col("_h") + 1, F.length("path")))
    sizes = F.concat(F.coalesce(F.slice("_sizes", F.lit(1), F.col("_h")), F.array().cast("array<int>")), F.slice("sizes", F.col("_h") + 1, F.size("sizes")))
    return both.select("conv_id", path.alias("path"), sizes.alias("sizes"))


def shared(a: bytes, b: bytes, turns: int) -> int:
    """How many turns two paths share, known to be at least turns."""
    top = min(len(a), len(b))
    at = turns * WIDTH
    while at < top and a[at : at + WIDTH] == b[at : at + WIDTH]:
        at += WIDTH
    return at // WIDTH


class Run:
    """A sorted run that is read path by path: the current path, its LCP with the one before, sizes, count, least id."""

    def __init__(self, row: dict):
        ints = lambda name, kind: np.frombuffer(row[name], kind).tolist()
        self.lcps, self.depths, self.counts, self.ids = ints("lcps", np.int32), ints("depths", np.int32), ints("counts", np.int64), ints("ids", np.int64)
        self.suffixes, self.sizes_left = row["suffixes"], ints("sizes", np.int32)
        self.i, self.at, self.path, self.sizes = -1, 0, b"", []
        self.step()

    @staticmethod
    def pack(entries: list[tuple[bytes, list[int], int, int]]) -> dict:
        """entries (path, sizes, count, least id) in order: each path as its LCP and the turns after it."""
        lcps, before = [], b""
        for path, *_ in entries:
            lcps.append(shared(before, path, 0))
            before = path
        sizes = [x for (_, s, _, _), lcp in zip(entries, lcps, strict=True) for x in s[lcp:]]
        return {
            "lcps": np.array(lcps, np.int32).tobytes(),
            "depths": np.array([len(e[0]) // WIDTH for e in entries], np.int32).tobytes(),
            "suffixes": b"".join(e[0][lcp * WIDTH :] for e, lcp in zip(entries, lcps, strict=True)),
            "sizes": np.array(sizes, np.int32).tobytes(),
            "counts": np.array([e[2] for e in entries], np.int64).tobytes(),
            "ids": np.array([e[3] for e in entries], np.int64).tobytes(),
        }

    def step(self) -> None:
        self.i += 1
        self.done = self.i == len(self.lcps)
        if not self.done:
            self.lcp, depth = self.lcps[self.i], self.depths[self.i]
            to = self.at + depth - self.lcp
            self.path = self.path[: self.lcp * WIDTH] + self.suffixes[self.at * WIDTH : to * WIDTH]
            self.sizes = self.sizes[: self.lcp] + self.sizes_left[self.at : to]
            self.at = to


def merge(runs: list[Run]) -> Iterator[tuple[bytes, list[int], int, int, int]]:
    """The distinct paths of all runs in order (path, sizes, count, least id, LCP with the path before).

    A loser tree: every run's lcp is that with the path that came out last. Of two, the one that shares more comes
    first; only if both share as much are they compared, from there on, and the loser learns what it shares with the
    winner.
    """
    k = len(runs)
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = runs[a], runs[b]
        if x.done or y.done:
            return (b, a) if x.done else (a, b)
        if x.lcp != y.lcp:
            return (a, b) if x.lcp > y.lcp else (b, a)
        common = shared(x.path, y.path, x.lcp)
        cut_at = common * WIDTH
        first, second = (a, b) if x.path[cut_at : cut_at + WIDTH] <= y.path[cut_at : cut_at + WIDTH] else (b, a)
        runs[second].lcp = common
        return first, second

    def build(node: int) -> int:
        if node >= k:
            return node - k
        best, losers[node] = play(build(2 * node), build(2 * node + 1))
        return best

    best = build(1) if k > 1 else 0
    held = None
    while not runs[best].done:
        run = runs[best]
        n, least = run.counts[run.i], run.ids[run.i]
        if held is not None and run.lcp * WIDTH == len(run.path) == len(held[0]):
            held[2] += n
            held[3] = min(held[3], least)
        else:
            if held is not None:
                yield tuple(held)
            held = [run.path, run.sizes, n, least, run.lcp]
        run.step()
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2
    if held is not None:
        yield tuple(held)


class Node:
    __slots__ = ("digest", "depth", "size", "n", "least", "children", "leaves", "saved", "open", "kids")

    def __init__(self, digest, depth: int, size: int, first: bool):
        self.digest, self.depth, self.size, self.open = digest, depth, size, first
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.kids = None, []

    def meet(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


def nodes_of(stream: Iterator[tuple[bytes, list[int], int, int, int]]) -> Iterator[tuple]:
    """Rows of NODE from merged paths, each when the stream has left it; those of the first and last path are open."""
    stack: list[Node] = []

    def finish() -> Iterator[tuple]:
        node = stack.pop()
        above = stack[-1] if stack else None
        own = node.digest.digest()
        for kid in node.kids:  # an open node's least id is not known yet, so its children name its digest
            yield (kid[0], own, *kid[2:]) if node.open else (*kid[:4], node.least, *kid[5:])
        if not node.open:
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.size
        row = (own, above.digest.digest() if node.open and above else None, node.depth, node.least, None, node.n, node.children, node.leaves, node.saved, node.size, node.open)
        if above is not None:
            above.meet(node.n, node.least)
            if not node.open:
                above.children += 1
                above.leaves += node.leaves
                above.saved += node.saved
        if node.open:
            yield row
        elif above.open:
            yield (row[0], above.digest.digest(), *row[2:])
        else:
            above.kids.append(row)

    first = True
    for path, sizes, n, least, lcp in stream:
        if not stack:
            stack.append(Node(hashlib.md5(), 0, 0, True))
        while len(stack) > lcp + 1:
            yield from finish()
        for d in range(lcp, len(path) // WIDTH):
            digest = stack[-1].digest.copy()
            digest.update(path[d * WIDTH : (d + 1) * WIDTH])
            stack.append(Node(digest, d + 1, sizes[d], first))
        stack[-1].meet(n, least)
        first = False
    for node in stack:
        node.open = True
    while stack:
        yield from finish()


def node_table(rows: list[tuple]) -> pa.Table:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in NODE.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for c, (name, kind) in zip(columns, fields, strict=True)})


def roll_up(group: pa.Table) -> pa.Table:
    """Open nodes, one row each, with their open descendants' sums added, deepest first."""
    rows = sorted(group.to_pylist(), key=lambda r: -r["depth"])
    known = {r["digest"]: r for r in rows}
    for r in rows:
        r["leaves"] = r["leaves"] or 1
        r["saved"] += (r["n"] - 1) * r["size"]
        if (above := known.get(r["parent"])) is not None:
            r["parent_conv_id"] = above["conv_id"]
            above["children"] += 1
            above["leaves"] += r["leaves"]
            above["saved"] += r["saved"]
    return node_table([tuple(r[x.split()[0]] for x in NODE.split(", ")) for r in rows])


def splitters(paths: DataFrame, ranges: int) -> list[bytes]:
    """ranges - 1 paths at most that part the table evenly, from a sample of about 64 paths a range. They settle how
    work is dealt out, never the result."""
    step = max(1, paths.count() // (64 * ranges))
    path = F.substring("path", F.lit(1), F.lit(2 * WIDTH * SPLITTER_TURNS))
    some = sorted({bytes.fromhex(r.path) for r in paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(step)) == 0).select(path.alias("path")).collect()})
    return sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []


def ends_of(paths: DataFrame, parts: int) -> DataFrame:
    """(digest, ends_sha256): the ids of the conversations that end at a path, ascending, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        out: list[tuple[bytes, str]] = []
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["digest", "ends_sha256"])
        for batch in batches:
            for digest, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest == now:
                    sha.update(b",%d" % i)
                else:
                    if now is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = digest, hashlib.sha256(b"%d" % i)
            if len(out) > 1000:
                yield as_batch()
                out.clear()
        if now is not None:
            out.append((now, sha.hexdigest()))
        yield as_batch()

    ends = paths.select(F.unhex(F.md5(F.unhex("path"))).alias("digest"), "conv_id")
    return ends.repartition(parts, "digest").sortWithinPartitions("digest", "conv_id").mapInArrow(tidy(run), "digest binary, ends_sha256 string")


def prefix_trie(paths: DataFrame, *, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per node of the trie of paths (conv_id, path, sizes; see turn_paths), the root (depth 0) included.

    conv_id is the node's smallest member and parent_conv_id its parent's (null for the root); n_convs counts members,
    n_children children, n_leaves the childless nodes of its subtree; saved_tokens sums, over its subtree, each node's
    members less one times the bytes of its last text; ends_sha256 hashes the ids, ascending and joined by commas, of
    the members that end there. Equal conversations share all their nodes; one without turns ends at the root. Ids must
    be distinct. An empty table has no nodes.
    """
    spark = paths.sparkSession
    paths = cut(paths.select("conv_id", "path", "sizes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    volume = paths.agg(F.coalesce(F.sum(F.length("path")), F.lit(0)).cast("long")).first()[0]
    edges = spark.sparkContext.broadcast(splitters(paths, max(parts, volume // (2 * range_bytes))))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(rows: list[tuple[bytes, int, list[int]]]) -> pa.RecordBatch:
            rows.sort(key=lambda r: r[:2])
            parted: dict[int, list] = {}
            for path, i, sizes in rows:
                own = parted.setdefault(bisect_right(edges.value, path), [])
                if own and own[-1][0] == path:
                    own[-1][2] += 1
                else:
                    own.append([path, sizes, 1, i])
            packed = {"range": list(parted)} | {k: [] for k in ("lcps", "depths", "suffixes", "sizes", "counts", "ids")}
            for entries in parted.values():
                for k, v in Run.pack(entries).items():
                    packed[k].append(v)
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "range" else pa.binary()) for k, v in packed.items()], list(packed))

        rows, held = [], 0
        for batch in batches:
            for i, path, sizes in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows.append((bytes.fromhex(path), i, sizes))
                held += 4 * len(path) + 200
            if held > run_bytes:
                yield runs(rows)
                rows, held = [], 0
        if rows:
            yield runs(rows)

    def build(group: pa.Table) -> pa.Table:
        return node_table([*nodes_of(merge([Run(r) for r in group.drop(["range"]).to_pylist()]))])

    schema = "range int, lcps binary, depths binary, suffixes binary, sizes binary, counts binary, ids binary"
    nodes = cut(paths.mapInArrow(tidy(sort), schema).groupBy("range").applyInArrow(build, NODE))
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    partial = nodes.where("open").groupBy("digest").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("size").alias("size"), *sums)
    named = partial.select("digest", "parent", "depth", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n", "children", "leaves", "saved", "size", F.lit(True).alias("open"))
    stitched = cut(named.groupBy().applyInArrow(roll_up, NODE))
    hanging = nodes.where("not open and parent is not null").drop("parent_conv_id")
    above = stitched.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.where("not open and parent is null").unionByName(hanging.join(above, "parent")).unionByName(stitched)
    found = whole.join(ends_of(paths, parts), "digest", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
