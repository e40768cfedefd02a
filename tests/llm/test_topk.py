import numpy as np
from pyspark.sql import functions as F

from snapweave.llm import topk

KIND = "vec_id long, embedding array<float>"


def brute(rows, k=5):
    q = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in rows}
    out = []
    for i in sorted(x for x in q if x % 50 == 0):
        ranked = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked)]
    return out


def run(spark, vectors, **options):
    got = topk.top_k(spark.createDataFrame(vectors, KIND), F.col("vec_id") % 50 == 0, **options)
    return sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    for shape in ("normal", "clusters", "ties"):
        x = rng.normal(size=(700, 16))
        if shape == "clusters":
            x = x * 0.05 + rng.normal(size=(7, 16))[np.arange(700) % 7]
        if shape == "ties":
            x = rng.integers(-1, 2, size=(700, 16)) / 256
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        assert run(spark, rows, rows=100, sample=50) == brute(rows)
    assert run(spark, rows, block_bytes=600) == brute(rows)
    few = rows[:120]
    assert run(spark, few + few[:1] * 500, sample=16, block_bytes=100) == brute(few)


def test_pruning_leaves_work_undone():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(size=(4000, 16)) * 0.05 + rng.normal(size=(40, 16))[np.arange(4000) % 40]))
    evaluated, own = [], topk.dot
    try:
        topk.dot = lambda a, q: (evaluated.append(len(a)), own(a, q))[1]
        s = topk.Search(np.array([0]), x[:1], topk.pick_pivots(x[:500], 24), 5)
        s.offer(np.arange(4000), x)
    finally:
        topk.dot = own
    assert sum(evaluated) < 2000


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [1.0]), (None, [9.0, 9.0]), (50, [2.0, 2.0]), (50, [3.0, 3.0]), (100, []), (150, [1e30, 1e30]), (7, [-1e30, 0.0])]
    got = run(spark, rows)
    assert [r for r in got if r[0] == 100] == []
    assert (0, 1, 150, (1 << 63) - 1) in got
    assert [r[2] for r in got if r[0] == 0] == [150, 50, 50, 1, 7]
    assert run(spark, rows[:1]) == [] and topk.top_k(spark.createDataFrame([], KIND), F.col("vec_id") % 50 == 0).count() == 0
