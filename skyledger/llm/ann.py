"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Equal vectors are first collapsed (tasks do it before the shuffle), keeping for each the smallest ids that can appear in
a result. Distinct vectors are dealt to shards of bounded size by a hash. Each shard builds one graph: vectors are put
in by batches; a greedy beam search proposes neighbours, and relaxed-distance pruning (alpha > 1) keeps edges that
point in different directions. Inner product is made a Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2), so
vectors of any norm work. Blocks of queries then meet every shard's graph in a beam search, whose results are scored
exactly and merged.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEGREE, BUILD_BEAM, ALPHA = 32, 64, 1.2
#: A search in a graph of four times the size costs a third more (measured: 8,192 and 32,768 vectors of 64 components), so
#: shards are as large as one task builds in about half a minute.
SHARD_ROWS, LEAST_SHARDS, QUERY_BLOCK = 32_768, 4, 8_192


def beam_search(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each query the beam's node numbers and squared distances, nearest first; -1 and inf where there are fewer.

    All queries advance together: each step expands every query's nearest unexpanded node.
    """
    n, m = len(queries), len(points) if limit is None else limit
    ids, dist = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    first = entry[:beam]
    ids[:, : len(first)] = first
    dist[:, : len(first)] = ((queries[:, None] - points[first][None]) ** 2).sum(2)
    seen = np.zeros((n, m), bool)
    seen[:, first] = True
    order = np.argsort(dist, 1, kind="stable")
    ids, dist, done = (np.take_along_axis(x, order, 1) for x in (ids, dist, done))
    active = np.arange(n)
    while len(active):
        open_ = ~done[active] & (ids[active] >= 0)
        going = open_.any(1)
        active, open_ = active[going], open_[going]
        if not len(active):
            break
        at = open_.argmax(1)
        done[active, at] = True
        found = edges[ids[active, at]]
        bad = (found < 0) | seen[active[:, None], np.maximum(found, 0)]
        seen[active[:, None], np.maximum(found, 0)] |= ~bad
        d = np.einsum("nkd,nkd->nk", gap := points[np.maximum(found, 0)] - queries[active][:, None], gap)
        d[bad] = np.inf
        all_ids = np.concatenate([ids[active], np.where(bad, -1, found)], 1)
        all_dist = np.concatenate([dist[active], d], 1)
        all_done = np.concatenate([done[active], np.zeros_like(bad)], 1)
        order = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        ids[active], dist[active], done[active] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_dist, all_done))
    return ids, dist


def robust_prune(points: np.ndarray, centre: int, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of centre: the nearest candidate, less those nearer to it (relaxed by alpha) than to centre, and so on."""
    cand = np.unique(cand[(cand >= 0) & (cand != centre)])
    p = points[cand]
    d = ((p - points[centre]) ** 2).sum(1)
    order = np.argsort(d, kind="stable")
    cand, p, d = cand[order], p[order], d[order]
    between = ((p * p).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * p @ p.T) * alpha**2
    alive, kept = np.ones(len(cand), bool), []
    for i in range(len(cand)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= between[i] > d
    return cand[kept]


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (-1 where fewer) and entry nodes. Nodes go in by growing batches, in a random order.

    Incoming edges may fill half a degree more than pruning leaves, so that a node is pruned once in many additions.
    """
    n, most = len(points), degree + degree // 2
    edges = np.full((n, most), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    middle = int(((points - points.mean(0)) ** 2).sum(1).argmin()) if n else 0
    order = np.concatenate([[middle], order[order != middle]]).astype(np.int64) if n else order
    entry, at = order[:1], 1
    while at < n:
        batch = order[at : at + min(512, max(8, at // 4))]
        found, _ = beam_search(points, edges, points[batch], entry, beam)
        back: dict[int, list[int]] = {}
        for b, cand in zip(batch.tolist(), found, strict=True):
            near = batch[((points[batch] - points[b]) ** 2).sum(1).argsort(kind="stable")[:9]] if len(batch) <= 512 else batch[:0]
            kept = robust_prune(points, b, np.concatenate([cand, near]), degree, alpha)
            edges[b, : len(kept)] = kept
            for k in kept.tolist():
                back.setdefault(k, []).append(b)
        fresh = set(batch.tolist())
        for k, sources in back.items():
            n_own = int((edges[k] >= 0).sum())
            if k in fresh:  # only nodes of one batch can have chosen each other
                known = set(edges[k, :n_own].tolist())
                sources = [x for x in sources if x not in known]
            if n_own + len(sources) <= most:
                edges[k, n_own : n_own + len(sources)] = sources
            else:
                kept = robust_prune(points, k, np.concatenate([edges[k, :n_own], sources]).astype(np.int64), degree, alpha)
                edges[k] = -1
                edges[k, : len(kept)] = kept
        at += len(batch)
    return edges, entry


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, beam: int = 160, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each row of queries its k nearest rows of vectors, by inner product, but for the row with its own id.

    Columns: query_id, rank (from 1), vec_id, score (double precision, on the original vectors). Ties go to the
    smaller id. Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a
    null id. Rows that repeat count once; several vectors of one id are candidates each, and the best of them counts.
    Vectors of another length than a query's are no candidates of it. With fewer candidates than k all are returned. Other columns are ignored,
    whatever their names. Empty tables give no rows. beam bounds the search's width, at least k. Rows of queries that share
    an id but not a vector are one query, of which each vector's hits count.
    """
    beam, spare = max(beam, 2 * k), k + 1
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal vectors of a task become one row, with their smallest ids."""
        found: dict[bytes, list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                keys = list(found)
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in keys], pa.binary()), pa.array(keys, pa.binary()), pa.array([found[x] for x in keys], pa.list_(pa.int64()))], ["key", "raw", "ids"])
                found.clear()

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = found.setdefault((np.asarray(value, "<f8") + 0.0).tobytes(), [])
                if key not in ids:
                    ids.append(key)
                    if len(ids) > spare:
                        ids.remove(max(ids))
            if len(found) >= 20_000:
                yield from out()
        yield from out()

    parts = clean(vectors).mapInArrow(collapse, "key binary, raw binary, ids array<long>")
    merged = parts.groupBy("key").agg(F.first("raw").alias("raw"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, spare).alias("ids"))
    n = clean(vectors).count()
    shards = max(LEAST_SHARDS, -(-n // shard_rows))
    dealt = merged.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).withColumn("dims", F.length("raw"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        original = np.stack([np.frombuffer(x, "<f8") for x in pdf.raw])
        scale = np.abs(original).max()
        points = original / scale
        norms = (points**2).sum(1)
        points = np.concatenate([points, np.sqrt(np.maximum(0, norms.max() - norms))[:, None]], 1).astype(np.float32)
        edges, entry = build_graph(points)
        ids = np.full((len(pdf), spare), -1, np.int64)
        for i, x in enumerate(pdf.ids):
            ids[i, : len(x)] = x
        return pd.DataFrame({"shard": [key[0]], "dims": [key[1]], "graph": [pack(original=original, points=points, edges=edges.astype(np.int32), entry=entry, ids=ids)]})

    graphs = dealt.groupBy("shard", "dims").applyInPandas(build, "shard int, dims int, graph binary")
    asked = clean(queries).distinct().withColumn("dims", F.size("v") * 8)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            with np.load(io.BytesIO(left.graph[0])) as g:
                original, points, edges, entry, ids = (g[x] for x in ("original", "points", "edges", "entry", "ids"))
            edges = edges.astype(np.int64)
            own, q = right.id.to_numpy(), np.stack(right.v.to_numpy())
            for at in range(0, len(q), 512):
                some = q[at : at + 512]
                flat = np.concatenate([some / np.abs(some).max(1, keepdims=True), np.zeros((len(some), 1))], 1)
                # a query's length doesn't change the order of inner products; at unit scale its distances compare well
                flat = (flat / np.sqrt((flat**2).sum(1, keepdims=True)) * np.sqrt((points**2).sum(1).max())).astype(np.float32)
                found, _ = beam_search(points, edges, flat, entry, beam)
                for j in range(len(some)):
                    hit = found[j][found[j] >= 0]
                    score = (original[hit] * some[j]).sum(1)
                    names, scores = ids[hit].ravel(), np.repeat(score, spare)
                    keep = (names >= 0) & (names != own[at + j])
                    names, scores = names[keep], scores[keep]
                    best = np.lexsort((names, -scores))[:k]
                    out["query_id"].append(np.full(len(best), own[at + j]))
                    out["vec_id"].append(names[best])
                    out["score"].append(scores[best])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pd.DataFrame({"query_id": cat(out["query_id"], "int64"), "vec_id": cat(out["vec_id"], "int64"), "score": cat(out["score"], float)})

    cells = ["shard", "dims", "block"]
    per_shard = graphs.groupBy(*cells).cogroup(asked.groupBy(*cells)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = per_shard.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
