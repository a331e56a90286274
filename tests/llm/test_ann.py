import numpy as np

from skyledger.llm.ann import build_graph, beam_search, nearest, robust_prune

SCHEMA = "vec_id long, embedding array<float>, label int, score int, rank int"


def brute(rows, k, every=20):
    good = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.asarray(v, float)).all() and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            best = {}
            for i, v in good:
                if i != q and len(v) == len(x):
                    best[i] = max(best.get(i, -np.inf), float((v * x).sum()))
            out[q] = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k]
    return out


def run(spark, rows, k=20, **more):
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), k=k, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_small_is_exact_with_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4) * rng.uniform(0.1, 5)]) for i in range(60)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 160)]  # copies, with queries among them
    rows += [rows[0], (200, None), (220, [0.0] * 4), (240, [None, 1.0, 1.0, 1.0]), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, []), (None, [1.0] * 4), (300, [1.0, 2.0])]
    got, want = run(spark, rows), {q: v for q, v in brute(rows, 20).items() if v}
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    assert run(spark, []) == {} and run(spark, [(20, [1.0, 1.0])]) == {}


def test_recall_on_driver_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = brute(rows, 20)
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {i for i, _ in v}) / len(v) for q, v in want.items()])
    assert recall >= 0.95, recall


def test_prune_keeps_diverse_edges():
    points = np.array([[0, 0], [1, 0], [1.01, 0], [0, 1], [-5, 0]], np.float32)
    assert robust_prune(points, 0, np.array([1, 2, 3, 4, -1, 0]), 4, 1.2).tolist() == [1, 3, 4]
    edges, entry = build_graph(np.random.default_rng(0).normal(size=(300, 8)).astype(np.float32))
    reached, todo = set(entry.tolist()), entry.tolist()
    while todo:
        for j in edges[todo.pop()]:
            if j >= 0 and j not in reached:
                reached.add(int(j))
                todo.append(int(j))
    assert len(reached) == 300 and beam_search(np.zeros((1, 2), np.float32), np.full((1, 2), -1), np.zeros((1, 2), np.float32), np.array([0]), 4)[0][0, 0] == 0
