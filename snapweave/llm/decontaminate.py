"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark's items: `window` consecutive words, or the whole item when
it is shorter. A shift table over blocks of words tells how far the search may jump without missing a
pattern, so most words of a text are never looked at; where the shift is nought, a bucket found by the
suffix block's hash (then by the prefix block) selects the patterns to compare, and a comparison of all
words confirms. Patterns of one length share one table; short items give a few further tables.

Scale: documents are never shuffled. The patterns reach the tasks in blocks of at most `block_bytes` of
benchmark text; one block covers any usual benchmark. With more, each block is one pass over the
documents whose hits (contaminated documents only) are merged at the end.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf, alnum_words, bounded_batches, row_key, without


class Table:
    """Shift and bucket tables for patterns (tuples of words) of one length."""

    def __init__(self, length: int, patterns: dict[tuple, set]):
        self.length, self.block = length, min(3, length)
        b = self.block
        self.default = length - b + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for p, owners in patterns.items():
            for end in range(b, length + 1):
                block, jump = p[end - b : end], length - end
                if jump < self.shift.get(block, self.default):
                    self.shift[block] = jump
            self.buckets[p[-b:]][p[:b]].append((p, tuple(owners)))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def search(self, words: list[bytes]):
        """(start, end, owners) of every occurrence, in order of place."""
        m, b, shift, default, buckets = self.length, self.block, self.shift.get, self.default, self.buckets
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - b : end])
            jump = shift(block, default)
            if jump:
                end += jump
                continue
            first = end - m
            for p, owners in buckets[block].get(tuple(words[first : first + b]), ()):
                if tuple(words[first:end]) == p:
                    yield first, end, owners
            end += 1


def windows(words: list[bytes], window: int) -> set[tuple]:
    """An item's patterns: none for an item without words."""
    if not words:
        return set()
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def build(items: list[tuple], window: int, nameless: bool = False) -> list[Table]:
    """Tables over (item id as text, text) pairs; null texts have no windows, null ids only if `nameless`."""
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        if item is None and not nameless or text is None:
            continue
        for p in windows(alnum_words(text.encode()), window):
            by_length[len(p)][p].add(item)
    return [Table(n, by_length[n]) for n in sorted(by_length)]


def merge(ranges) -> tuple[list, list]:
    """Starts and ends of ranges, with those that touch made one."""
    starts, ends = [], []
    for first, end in sorted(ranges):
        if ends and first <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(first)
            ends.append(end)
    return starts, ends


def in_order(items) -> list:
    """Distinct ids as strings, sorted, null last."""
    return sorted(set(items), key=lambda x: (x is None, x or ""))


def scan(text: bytes | None, tables: list[Table]) -> tuple[int, list, list, list]:
    """Words, merged hit ranges and the items hit in one text."""
    words = alnum_words(text) if text else []
    found, items = [], set()
    for t in tables:
        for first, end, owners in t.search(words):
            found.append((first, end))
            items.update(owners)
    return len(words), *merge(found), in_order(items)


def item_blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark as (item, text) lists of about `block_bytes` each, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = 1 + int(size // block_bytes)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield n, [(r.item, r.text) for r in part.collect()]


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_starts", T.ArrayType(T.LongType())), T.StructField("hit_ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
KINDS = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))


def _pass(docs: DataFrame, items: list[tuple], window: int, nameless: bool) -> DataFrame:
    """`docs` with the columns of FOUND; a narrow map."""
    tables = docs.sparkSession.sparkContext.broadcast(build(items, window, nameless))
    at = [c.lower() for c in docs.columns].index("text")

    def search(batches):
        for batch in batches:
            found = [scan(t, tables.value) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate(KINDS)]
            yield pa.RecordBatch.from_arrays(batch.columns + cols, names=batch.schema.names + FOUND.names)

    return docs.mapInArrow(search, T.StructType([*docs.schema, *FOUND]))


def _in_blocks(docs: DataFrame, blocks, window: int, nameless: bool) -> DataFrame:
    """The same with one pass over distinct (doc_id, text) for each block of items, whose hits are merged."""
    shelf, parts = Shelf(docs.sparkSession), None
    same = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__w_id"), row_key("doc_id", "text").alias("__w_key")]
    keyed = docs.select("*", *same)
    slim = keyed.select("__w_id", "__w_key", "text").dropDuplicates(["__w_id", "__w_key"])
    for k, (_, items) in enumerate(blocks):
        part = _pass(slim, items, window, nameless).where(F.size("items") > 0).drop("text")
        part = shelf.put(part.select("__w_id", "__w_key", F.struct("hit_starts", "hit_ends", "items").alias("__w_hits")), f"block{k}")
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("__w_id", "__w_key").agg(F.collect_list("__w_hits").alias("__w_hits"))  # a struct for each block at most
    full = keyed.join(merged, ["__w_id", "__w_key"], "left").select(*[keyed[c] for c in docs.columns], "__w_hits")
    at, own = [c.lower() for c in docs.columns].index("text"), len(docs.columns)

    def finish(batches):
        for batch in batches:
            found = []
            for text, hits in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(own).to_pylist(), strict=True):
                ranges = [r for h in hits or () for r in zip(h["hit_starts"], h["hit_ends"], strict=True)]
                found.append((len(alnum_words(text)) if text else 0, *merge(ranges), in_order(x for h in hits or () for x in h["items"])))
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate(KINDS)]
            yield pa.RecordBatch.from_arrays(batch.columns[:own] + cols, names=batch.schema.names[:own] + FOUND.names)

    return full.mapInArrow(finish, T.StructType([*docs.schema, *FOUND]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, nameless: bool = False) -> DataFrame:
    """Every row and column of `docs` (which must have `doc_id` and `text`), and

    n_words long, hit_starts and hit_ends array<long> (merged ranges of hit words, end exclusive),
    items array<string> (ids of the items hit, sorted), n_hit long.

    A null or empty text has no words and no hits. Rows that repeat an id are scanned one by one.
    Items without words match nothing, nor do those without id unless `nameless`; then they count as one item and
    `items` ends with a null where any is hit. An empty benchmark gives no hits. Columns of `docs`
    named like an output column, in any case, are replaced; names that begin with `__w_` are reserved and such columns dropped.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, *FOUND.names, "n_hit")
    blocks = item_blocks(benchmark, block_bytes)
    n, items = next(blocks)
    hits = _pass(docs, items, window, nameless) if n == 1 else _in_blocks(docs, _chain((n, items), blocks), window, nameless)
    length = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return hits.withColumn("n_hit", length)


def _chain(first, rest):
    yield first
    yield from rest


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contaminated documents: per document its words, hit words and the items it holds."""
    from .common import table

    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate(docs, benchmark, nameless=True).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM p),
g AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
h AS (SELECT g.doc_id, g.i, g.m, p.item_id FROM g JOIN p ON g.m = p.m AND g.s = p.s),
k AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM h) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(k.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(k.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""
