"""Exact top-k inner-product search by pivot-table elimination.

Inner product becomes distance by one more dimension: with M at least every candidate's norm, candidate v
is the point (v, sqrt(M^2 - |v|^2)) and query q the point (q, 0), so |q' - v'|^2 = |q|^2 + M^2 - 2 q.v. A
table of distances from candidates to many pivots gives, by the triangle inequality, the largest
lower bound max_p |d(q',p') - d(v',p')| and so an upper bound of each score. Candidates are evaluated in
the order of that bound until the next bound is below the k-th score; the result is exact.

Scale: candidates are read once per block of queries and never shuffled; the queries (a fiftieth of the rows)
come in blocks of at most `block_bytes`. Pivots, and a first k-th score for every query, come from a
sample of about `sample` candidates, so most tasks emit only what can still be in the result. A
task holds `rows` candidates at a time and emits at most k rows per query, which a window limited per
partition merges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, bounded_batches, hashed_share, table

RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: list[list[float]]) -> np.ndarray:
    """floor(256 x) of every component, as doubles that hold integers."""
    return np.floor(256.0 * np.asarray(vectors, np.float64).reshape(len(vectors), -1))


def dot(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 2^63 they are held at the nearest 64-bit integer."""
    if a.size and max(np.abs(a).max(), np.abs(q).max(initial=0)) ** 2 * a.shape[1] >= 1 << 53:
        whole = [sum(int(x) * int(y) for x, y in zip(r, q, strict=True)) for r in a]
        return np.array([min(max(s, 1 - (1 << 63)), (1 << 63) - 1) for s in whole], np.int64)
    return (a @ q).astype(np.int64)


def pick_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first rows: each is as far as can be from those before it."""
    if not len(points):
        return points
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


class Search:
    """A block of queries of one dimension, with their pivots and the best scores known so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.q, self.pivots, self.k = ids, vectors, pivots, k
        self.norm = (vectors**2).sum(1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), ascending
        self.least = np.full(len(ids), -np.inf)  # a score that k candidates are known to reach

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Search one block of candidates."""
        norm = (vectors**2).sum(1)
        pivots = self.pivots if len(self.pivots) else vectors[:1]
        top = norm.max()
        far = lambda square: np.sqrt(np.maximum(square, 0))
        own = (pivots**2).sum(1)[:, None]
        to_v = far(top - 2 * pivots @ vectors.T + own)  # pivots lie where queries do, at 0 in the further dimension
        to_q = far(self.norm[None] - 2 * pivots @ self.q.T + own)
        for low in range(0, len(self.ids), 64):
            part = slice(low, low + 64)
            bound = np.zeros((len(self.ids[part]), len(ids)))
            for p in range(len(pivots)):
                np.maximum(bound, np.abs(to_q[p, part, None] - to_v[p]), out=bound)
            # score <= (|q|^2 + M^2 - bound^2) / 2; the slack is far above the rounding of doubles
            most = (self.norm[part, None] + top - bound**2) / 2 + 1 + 1e-9 * (self.norm[part, None] + top)
            for j, upper in enumerate(most, low):
                self._one(j, ids, vectors, upper)

    def _one(self, j: int, ids: np.ndarray, vectors: np.ndarray, upper: np.ndarray) -> None:
        left = np.flatnonzero(upper >= self.least[j])
        left = left[np.argsort(-upper[left], kind="stable")]
        best, at, step = self.best[j], 0, 64
        while at < len(left) and upper[left[at]] >= self.least[j]:
            some = left[at : at + step]
            score = dot(vectors[some], self.q[j])
            keep = (score >= self.least[j]) & (ids[some] != self.ids[j])
            if keep.any():
                best = sorted({*best, *zip((-score[keep]).tolist(), ids[some][keep].tolist(), strict=True)})[: self.k]
                if len(best) == self.k:
                    self.least[j] = max(self.least[j], -best[-1][0])
            at, step = at + step, step * 4
        self.best[j] = best

    def rows(self):
        return [(int(q), v, -s) for q, least, best in zip(self.ids, self.least, self.best, strict=True) for s, v in best if -s >= least]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))


def top_k(vectors: DataFrame, is_query, k: int = 5, pivots: int = 24, sample: int = 2048, block_bytes: int = 16 << 20, rows: int = 8192) -> DataFrame:
    """The k rows of highest inner product for each row of `vectors` (`vec_id`, `embedding`) where `is_query`.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer candidates
    give fewer rows. Null ids, null vectors and vectors with null or non-finite components take no part. A
    query's own id is never a candidate. Rows that repeat id and vector count once; an id with several
    vectors has each as a candidate and takes the smallest vector (in list order) as its query. Vectors
    of another dimension than the query's are no candidates. Other columns take no part.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    good = usable(vectors)
    queries = good.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sized = queries.agg(F.count("*").alias("n"), F.sum(F.size("embedding") * 8 + 64).alias("bytes")).first()
    blocks = 1 + int((sized.bytes or 0) // block_bytes)
    seen = hashed_share(good, sample, "vec_id").collect()
    by_dim: dict[int, list] = {}
    for r in seen:
        by_dim.setdefault(len(r.embedding), []).append(r)
    samples = {d: (np.array([r.vec_id for r in rs]), quantised([r.embedding for r in rs])) for d, rs in by_dim.items()}
    shelf, found = Shelf(spark), None
    for b in range(blocks):  # one after the other: the driver and the tasks hold one block at a time
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(_searches(own.collect(), samples, k, pivots))
        part = shelf.put(_block(good, shared, rows), f"block{b}")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searches(queries: list, samples: dict, k: int, pivots: int) -> dict[int, Search]:
    """A block of queries by dimension, each with the k-th score that the sample reaches."""
    made = {}
    for d in {len(r.embedding) for r in queries}:
        own = [r for r in queries if len(r.embedding) == d]
        ids, points = samples.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
        s = Search(np.array([r.vec_id for r in own]), quantised([r.embedding for r in own]), pick_pivots(points, pivots), k)
        if len(ids):
            s.offer(ids, points)
            s.best = [[] for _ in own]  # every task meets its own candidates anew; only the k-th scores stay
        made[d] = s
    return made


def _block(good: DataFrame, shared, rows: int) -> DataFrame:
    """Each task's best candidates for one block of queries."""

    def search(batches):
        import copy

        states, held = copy.deepcopy(shared.value), {}

        def flush(d):
            ids, vectors = zip(*held.pop(d), strict=True)
            states[d].offer(np.array(ids), quantised(list(vectors)))

        for batch in batches:
            for vec, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(x) in states:
                    held.setdefault(len(x), []).append((vec, x))
                    if len(held[len(x)]) >= rows:
                        flush(len(x))
        for d in list(held):
            flush(d)
        for s in states.values():
            out = s.rows()
            for low in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[low : low + 10_000], strict=True)], names=["query_id", "vec_id", "score"])

    return good.mapInArrow(search, RESULT)


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The five highest scores for every vector whose id is divisible by 50, against all vectors."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
