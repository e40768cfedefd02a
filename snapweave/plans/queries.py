"""Queries over the driver's tables, and the DuckDB SQL that must give the same rows.

Documents stand for a tree: a path from source and id, the text's UTF-8 bytes as content. Generation 1
edits every 33rd document, deletes one in 97 and copies one in 101.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, udfs
from ..functions import columns as c
from ..operators import chunking, snapshot

SIZE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(path, text, doc_id):
    content = F.encode(text, "UTF-8")
    return [path.alias("path"), F.lit(420).alias("mode"), F.octet_length(content).cast("long").alias("size"), (doc_id * 1000).alias("mtime_ns"), c.fingerprint(content).alias("digest"), content.alias("content")]


def generation(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """The tree of generation 0 or 1."""
    docs, doc = table(spark, sf_dir, "documents").select("doc_id", "text", "source"), F.col("doc_id")
    name = F.concat(F.lit("d"), F.lpad(doc.cast("string"), 8, "0"), F.lit(".txt"))
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), name)
    if not number:
        return docs.select(*_file(path, F.col("text"), doc))
    edited = F.when(doc % 33 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    moved = docs.where(doc % 101 == 2).select(*_file(F.concat(F.lit("copy/"), name), F.col("text"), doc))
    return docs.where(doc % 97 != 1).select(*_file(path, edited, doc)).unionByName(moved)


def refs(files: DataFrame, size: int = SIZE) -> DataFrame:
    return chunking.fixed_chunks(files, size)


def store_of(refs_: DataFrame) -> DataFrame:
    return refs_.groupBy("fp").agg(F.min("length").alias("length"))


def _needed(spark, sf):
    cur = snapshot.canonical(refs(generation(spark, sf, 1)))
    return cur, snapshot.need(cur, store_of(refs(generation(spark, sf, 0))))


_DOC_PATH = "'docs/' || source || '/d' || lpad(doc_id::VARCHAR, 8, '0') || '.txt'"
_BASE = f"""
g0 AS (SELECT {_DOC_PATH} AS path, doc_id * 1000 AS mtime_ns, encode(text) AS content FROM documents),
g1 AS (
  SELECT {_DOC_PATH} AS path, doc_id * 1000 AS mtime_ns, encode(CASE WHEN doc_id % 33 = 0 THEN text || ' edited' ELSE text END) AS content FROM documents WHERE doc_id % 97 <> 1
  UNION ALL SELECT 'copy/d' || lpad(doc_id::VARCHAR, 8, '0') || '.txt', doc_id * 1000, encode(text) FROM documents WHERE doc_id % 101 = 2)"""


def _cut(g: str, size: int = SIZE) -> str:
    return f"""(SELECT path, i::INT AS chunk_no, i * {size} AS "offset", least({size}, octet_length(content) - i * {size})::INT AS length,
  sha256(array_slice(content, i * {size} + 1, least((i + 1) * {size}, octet_length(content)))) AS fp
  FROM (SELECT path, content, unnest(range(0, (octet_length(content) + {size - 1}) // {size})) AS i FROM {g}))"""


_REFS = f"{_BASE}, r0 AS {_cut('g0')}, r1 AS {_cut('g1')}"
_CANON = f"""{_REFS},
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY path, chunk_no) AS k FROM r1) WHERE k = 1),
canon AS (SELECT row_number() OVER (ORDER BY path, chunk_no) - 1 AS idx, fp, length, path, chunk_no FROM f1),
need AS (SELECT * FROM canon WHERE fp NOT IN (SELECT fp FROM r0))"""
_RUNS = f"""{_CANON},
isl AS (SELECT idx, idx - row_number() OVER (ORDER BY idx) AS k FROM need),
runs AS (SELECT min(idx) AS "start", max(idx) AS "last" FROM isl GROUP BY k)"""
_DELTAS = f"""{_RUNS},
deltas AS (SELECT "start", "last", "start" - coalesce(lag("last") OVER (ORDER BY "start") + 1, 0) AS gap, "last" - "start" AS extra FROM runs)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {_BASE} SELECT count(*) AS files, sum(octet_length(content))::BIGINT AS logical_bytes, max(octet_length(content))::BIGINT AS largest FROM g0")
def tree_scan_stats(spark, sf):
    g = generation(spark, sf, 0)
    return g.agg(F.count("*").alias("files"), F.sum("size").alias("logical_bytes"), F.max("size").alias("largest"))


@query(f"WITH {_BASE} SELECT path, octet_length(content)::BIGINT AS size, sha256(content) AS digest FROM g0")
def file_digests(spark, sf):
    return generation(spark, sf, 0).select("path", "size", c.to_hex(F.col("digest")).alias("digest")).orderBy("path")


_PATHS = ["a", "a/b", "a.b/c-d", "..a", "a..", "", "/a", "a/", "a//b", ".", "..", "a/..", "../a", "a/./b", "a\\b", "a\tb", "a\nb", "x" * 4096, "x" * 4097]


@query("SELECT doc_id, source || '/' || doc_id AS path, NOT regexp_matches(source || '/' || doc_id, '^/|/$|//|(^|/)[.]{1,2}(/|$)') AS ok FROM documents")
def safe_path_filter(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return d.withColumn("ok", c.valid_path(F.col("path")))


@query("SELECT source, regexp_full_match(source, '[A-Za-z0-9_-][A-Za-z0-9._-]{0,127}') AS ok, count(*) AS n FROM documents GROUP BY 1, 2")
def dataset_name_filter(spark, sf):
    return table(spark, sf, "documents").groupBy("source", c.valid_dataset(F.col("source")).alias("ok")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, left(sha256(text), 32) AS id, regexp_full_match(left(sha256(text), 32), '[a-f0-9-]{1,64}') AS ok FROM documents")
def session_id_filter(spark, sf):
    own = F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)
    return table(spark, sf, "documents").select("doc_id", own.alias("id"), c.valid_session(own).alias("ok"))


@query(f'WITH {_REFS} SELECT path, chunk_no, "offset", length, fp FROM r0')
def fixed_chunks(spark, sf):
    return refs(generation(spark, sf, 0)).withColumn("fp", c.to_hex(F.col("fp")))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, sha256(encode(text)) AS digest, true AS tiles FROM documents WHERE text <> ''")
def cdc_chunks_tile(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    chunks = chunking.cdc_chunks(d, chunking.Params(256, 1024, 4096))
    w = Window.partitionBy("path").orderBy("chunk_no")
    tiled = chunks.withColumn("ok", F.col("offset") == F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = tiled.groupBy("path").agg(F.sum("length").alias("bytes"), F.bool_and("ok").alias("tiles"))
    return ends.join(d.select("path", F.sha2("content", 256).alias("digest")), "path").select(F.col("path").cast("long").alias("doc_id"), "bytes", "digest", "tiles")


def _cdc_sql() -> str:
    """Content-defined chunks in SQL: the rolling hash of every byte by doubling, then chunk after chunk the first byte that a mask accepts.

    The hash from a chunk's first tested byte on is the hash over all bytes less what stood before that byte, shifted as far as it has come.
    """
    p, two64 = chunking.Params(), 1 << 64
    low, avg, high = p.low, p.avg, p.high
    times = lambda a, c_: f"(({a})::UHUGEINT * {c_} % {two64})::UBIGINT"
    doubled = [
        f"f{2 * w} AS (SELECT path, pos, ((f::UHUGEINT + (lag(f, {w}, 0::UBIGINT) OVER (PARTITION BY path ORDER BY pos))::UHUGEINT * {1 << w}) % {two64})::UBIGINT AS f FROM f{w})"
        for w in (1, 2, 4, 8, 16, 32)
    ]
    return f"""WITH RECURSIVE {_BASE},
gx AS (SELECT k, {times("k + 2", chunking.SEED)} AS x FROM (SELECT unnest(range(256)) AS k)),
gy AS (SELECT k, {times("xor(x, x >> 30)", 0xBF58476D1CE4E5B9)} AS x FROM gx), gz AS (SELECT k, {times("xor(x, x >> 27)", 0x94D049BB133111EB)} AS x FROM gy),
gear AS (SELECT list(xor(x, x >> 31) ORDER BY k) AS t FROM gz),
f1 AS (SELECT path, unnest(range(len(v))) AS pos, unnest(v) AS f FROM (SELECT path, list_transform(range(1, octet_length(content) + 1), lambda i: t[('0x' || substr(h, 2 * i - 1, 2))::INT + 1]) AS v
  FROM (SELECT path, content, hex(content) AS h FROM g0 WHERE octet_length(content) > {low}), gear)),
{", ".join(doubled)},
c AS (SELECT path, octet_length(content)::BIGINT AS n, -1 AS chunk_no, 0::BIGINT AS s, 0::BIGINT AS e FROM g0
  UNION ALL SELECT c.path, c.n, c.chunk_no + 1, c.e, coalesce(min(p.pos) + 1, least(c.e + {high}, c.n))
  FROM c LEFT JOIN f64 q ON q.path = c.path AND q.pos = c.e + {low} - 1 AND c.n - c.e > {low}
  LEFT JOIN f64 p ON p.path = c.path AND p.pos >= c.e + {low} AND p.pos < least(c.e + {high}, c.n) AND q.path IS NOT NULL
    AND ((p.f::UHUGEINT + {two64} - CASE WHEN p.pos - c.e - {low} < 63 THEN (q.f::UHUGEINT << (p.pos - c.e - {low} + 1)::UHUGEINT) % {two64} ELSE 0 END) % {two64})::UBIGINT
      & CASE WHEN p.pos < least(c.e + {avg}, c.n) THEN {chunking.STRICT}::UBIGINT ELSE {chunking.LOOSE}::UBIGINT END = 0
  WHERE c.e < c.n GROUP BY c.path, c.n, c.chunk_no, c.e)
SELECT c.path, c.chunk_no::INT AS chunk_no, c.s AS "offset", (c.e - c.s)::INT AS length, sha256(array_slice(g0.content, c.s + 1, c.e)) AS fp FROM c JOIN g0 ON g0.path = c.path WHERE c.chunk_no >= 0"""


@query(_cdc_sql())
def cdc_chunks(spark, sf):
    return chunking.cdc_chunks(generation(spark, sf, 0)).withColumn("fp", c.to_hex(F.col("fp")))


@query(f"WITH {_REFS} SELECT count(*) AS chunk_refs, count(DISTINCT fp) AS chunks, sum(length)::BIGINT AS bytes FROM r0")
def chunk_dedup_ratio(spark, sf):
    return refs(generation(spark, sf, 0)).agg(F.count("*").alias("chunk_refs"), F.count_distinct("fp").alias("chunks"), F.sum("length").alias("bytes"))


@query(f"WITH {_CANON} SELECT idx, fp, length FROM canon")
def canonical_list(spark, sf):
    return snapshot.canonical(refs(generation(spark, sf, 1))).select("idx", c.to_hex(F.col("fp")).alias("fp"), "length")


@query(f'WITH {_REFS}, o AS (SELECT fp, path, chunk_no, coalesce(sum(length) OVER (PARTITION BY path ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length, row_number() OVER (PARTITION BY fp ORDER BY path, chunk_no) AS k FROM r0) SELECT fp, path, chunk_no, "offset", length FROM o WHERE k = 1')
def chunk_offsets(spark, sf):
    return snapshot.chunk_locations(refs(generation(spark, sf, 0))).withColumn("fp", c.to_hex(F.col("fp")))


@query(f"WITH {_BASE} SELECT path, octet_length(g1.content)::BIGINT AS size FROM g1 JOIN g0 USING (path, mtime_ns) WHERE g0.content = g1.content")
def files_unchanged(spark, sf):
    return snapshot.files_unchanged(generation(spark, sf, 0), generation(spark, sf, 1)).select("path", "size")


@query(f"WITH {_CANON} SELECT idx, fp, length FROM need")
def need_set(spark, sf):
    return _needed(spark, sf)[1].select("idx", c.to_hex(F.col("fp")).alias("fp"), "length")


@query(f"WITH {_CANON} SELECT count(*) AS chunks_skipped, sum(length)::BIGINT AS bytes_skipped FROM canon SEMI JOIN r0 USING (fp)")
def chunks_present(spark, sf):
    cur = snapshot.canonical(refs(generation(spark, sf, 1)))
    return snapshot.present(cur, store_of(refs(generation(spark, sf, 0)))).agg(F.count("*").alias("chunks_skipped"), F.sum("length").alias("bytes_skipped"))


@query(f"""WITH {_CANON}, u AS (SELECT g1.content FROM g1 JOIN g0 USING (path, mtime_ns) WHERE g0.content = g1.content)
SELECT (SELECT count(*) FROM canon) AS chunks_total, (SELECT sum(length)::BIGINT FROM canon) AS bytes_total, (SELECT count(*) FROM need) AS chunks_needed, (SELECT coalesce(sum(length), 0)::BIGINT FROM need) AS bytes_needed,
 (SELECT count(*) FROM g1) AS files_total, (SELECT sum(octet_length(content))::BIGINT FROM g1) AS logical_bytes, (SELECT count(*) FROM u) AS files_unchanged, (SELECT coalesce(sum(octet_length(content)), 0)::BIGINT FROM u) AS bytes_in_unchanged, (SELECT count(*) FROM r1) AS chunk_refs""")
def negotiation_summary(spark, sf):
    g0, g1 = generation(spark, sf, 0), generation(spark, sf, 1)
    own = refs(g1)
    cur = snapshot.canonical(own)
    return snapshot.negotiation_summary(g1, own, snapshot.need(cur, store_of(refs(g0))), cur, snapshot.files_unchanged(g0, g1))


@query(f'WITH {_RUNS} SELECT "start", "last" FROM runs')
def need_runs(spark, sf):
    return snapshot.need_runs(_needed(spark, sf)[1], block=64)


@query(f'WITH {_DELTAS} SELECT "start", "last", gap, extra FROM deltas')
def need_deltas(spark, sf):
    return snapshot.run_deltas(snapshot.need_runs(_needed(spark, sf)[1]))


@query(f"WITH {_CANON} SELECT idx FROM need")
def need_expand(spark, sf):
    return snapshot.expand_runs(snapshot.need_runs(_needed(spark, sf)[1]), most=8)


@query(f'WITH {_RUNS} SELECT idx, length FROM canon JOIN runs ON idx BETWEEN "start" AND "last"')
def need_contains(spark, sf):
    cur, needed = _needed(spark, sf)
    return snapshot.in_runs(cur.select("idx", "length"), snapshot.need_runs(needed), block=64)


def _ladder(x: str) -> str:
    return "(1 + " + " + ".join(f"({x} >= {1 << (7 * n)})::INT" for n in range(1, 9)) + ")"


@query(f"WITH {_DELTAS} SELECT coalesce(sum({_ladder('gap')} + {_ladder('extra')}), 0)::BIGINT AS encoded_bytes FROM deltas")
def need_encoded_size(spark, sf):
    return snapshot.encoded_size(snapshot.need_runs(_needed(spark, sf)[1]))


@query(f"WITH {_CANON} SELECT row_number() OVER (ORDER BY idx) - 1 AS seq, idx, fp, length FROM need")
def send_plan(spark, sf):
    return snapshot.send_plan(_needed(spark, sf)[1]).select("seq", "idx", c.to_hex(F.col("fp")).alias("fp"), "length")


@query(f"""WITH RECURSIVE {_CANON}, p AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS seq, length + {_ladder('length')} AS n FROM need),
w AS (SELECT seq, n::BIGINT AS n, 0::BIGINT AS batch, n::BIGINT AS held FROM p WHERE seq = 0
 UNION ALL SELECT p.seq, p.n::BIGINT, w.batch + (w.held >= 2048)::INT, CASE WHEN w.held >= 2048 THEN p.n ELSE w.held + p.n END FROM w JOIN p ON p.seq = w.seq + 1)
SELECT seq, n, batch FROM w""")
def batch_packing(spark, sf):
    return snapshot.pack_batches(snapshot.send_plan(_needed(spark, sf)[1]), limit=2048)


@query(f"WITH {_CANON}, p AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS seq, fp, length FROM need) SELECT seq, fp, length::INT AS n_bytes, 'ok' AS status FROM p")
def read_by_location(spark, sf):
    g1 = generation(spark, sf, 1)
    plan = snapshot.send_plan(_needed(spark, sf)[1])
    found = snapshot.read_chunks(plan, snapshot.chunk_locations(refs(g1)), g1)
    return found.select("seq", c.to_hex(F.col("fp")).alias("fp"), F.octet_length("payload").alias("n_bytes"), "status")


def _arrivals(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_id % 50 <> 49 OR event_id < 600").select(F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("session"), F.floor(F.col("event_id") / 4).alias("seq"))


_ARR = "arr AS (SELECT 's' || (user_id % 4) AS session, event_id // 4 AS seq FROM events WHERE event_id % 50 <> 49 OR event_id < 600)"


@query(f"""WITH {_ARR}, d AS (SELECT DISTINCT session, seq FROM arr), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS k FROM d)
SELECT session, count(*) FILTER (WHERE seq = k) AS high_water, count(*) AS seen FROM r GROUP BY session""")
def high_water(spark, sf):
    return snapshot.high_water(_arrivals(spark, sf))


@query(f"WITH {_ARR} SELECT session, seq, count(*) AS arrivals FROM arr GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_arrivals(spark, sf):
    return _arrivals(spark, sf).groupBy("session", "seq").agg(F.count("*").alias("arrivals")).where("arrivals > 1")


@query(f"WITH {_ARR} SELECT session, seq FROM arr WHERE seq - 10 >= 100")
def out_of_window(spark, sf):
    return snapshot.out_of_window(_arrivals(spark, sf), F.lit(10), window=100)


def _commits(spark, sf):
    n = table(spark, sf, "orders")
    dataset, generation_ = F.concat(F.lit("set"), (F.col("o_custkey") % 7).cast("string")), F.col("o_orderkey") % 5 + F.when(F.col("o_custkey") % 7 == 3, 1).otherwise(0)
    return n.select(dataset.alias("dataset"), generation_.cast("long").alias("generation"), F.sha2(F.concat_ws("/", dataset, generation_, F.when(F.col("o_orderkey") % 1000 == 7, "x")), 256).alias("digest")).distinct()


_COM = """com AS (SELECT DISTINCT dataset, generation, sha256(dataset || '/' || generation || CASE WHEN o_orderkey % 1000 = 7 THEN '/x' ELSE '' END) AS digest
FROM (SELECT 'set' || (o_custkey % 7) AS dataset, o_orderkey % 5 + CASE WHEN o_custkey % 7 = 3 THEN 1 ELSE 0 END AS generation, o_orderkey FROM orders))"""


@query(f"WITH {_COM} SELECT DISTINCT dataset, generation FROM com")
def visible_generations(spark, sf):
    return _commits(spark, sf).select("dataset", "generation").distinct().orderBy("dataset", "generation")


@query(f"WITH {_COM} SELECT dataset, max(generation) AS latest FROM com GROUP BY 1")
def latest_generation(spark, sf):
    return _commits(spark, sf).groupBy("dataset").agg(F.max("generation").alias("latest"))


@query(f"WITH {_COM} SELECT DISTINCT dataset FROM com")
def datasets(spark, sf):
    return _commits(spark, sf).select("dataset").distinct().orderBy("dataset")


@query(f"WITH {_COM} SELECT dataset, min(generation) = 0 AND max(generation) = count(DISTINCT generation) - 1 AS consistent, max(generation) AS latest, count(DISTINCT generation) AS generations FROM com GROUP BY 1")
def prefix_consistent(spark, sf):
    return snapshot.prefix_consistent(_commits(spark, sf))


@query(f"WITH {_COM} SELECT dataset, generation, count(DISTINCT digest) AS digests FROM com GROUP BY 1, 2 HAVING count(DISTINCT digest) > 1")
def commit_conflicts(spark, sf):
    return snapshot.commit_conflicts(_commits(spark, sf))


@query(f"WITH {_COM} SELECT 'set' || (c_custkey % 9) AS dataset, c_custkey % 6 AS generation FROM customer ANTI JOIN com ON com.dataset = 'set' || (c_custkey % 9) AND com.generation = c_custkey % 6")
def orphan_manifests(spark, sf):
    m = table(spark, sf, "customer").select(F.concat(F.lit("set"), (F.col("c_custkey") % 9).cast("string")).alias("dataset"), (F.col("c_custkey") % 6).alias("generation"))
    return snapshot.orphans(m, _commits(spark, sf))


@query(f"""WITH {_REFS}, s AS (SELECT fp, min(length) AS length FROM r0 WHERE left(fp, 2) <> '00' GROUP BY fp), {_COM}
SELECT 'missing chunk' AS problem, count(DISTINCT fp) AS n FROM r0 ANTI JOIN s USING (fp)
UNION ALL SELECT 'conflicting commit', count(*) FROM (SELECT 1 FROM com GROUP BY dataset, generation HAVING count(DISTINCT digest) > 1)
UNION ALL SELECT 'gap in generations', count(*) FROM (SELECT 1 FROM com GROUP BY dataset HAVING NOT (min(generation) = 0 AND max(generation) = count(DISTINCT generation) - 1))""")
def verify_report(spark, sf):
    own = refs(generation(spark, sf, 0))
    store = store_of(own.where(F.hex(F.substring("fp", 1, 1)) != "00"))
    missing = own.join(store, "fp", "left_anti").agg(F.lit("missing chunk").alias("problem"), F.count_distinct("fp").alias("n"))
    com = _commits(spark, sf)
    clash = snapshot.commit_conflicts(com).agg(F.lit("conflicting commit").alias("problem"), F.count("*").alias("n"))
    gaps = snapshot.prefix_consistent(com).where("NOT consistent").agg(F.lit("gap in generations").alias("problem"), F.count("*").alias("n"))
    return missing.unionByName(clash).unionByName(gaps)


@query(f"WITH {_REFS} SELECT left(fp, 2) AS shard, count(DISTINCT fp) AS chunks FROM r0 GROUP BY 1")
def shard_histogram(spark, sf):
    s = store_of(refs(generation(spark, sf, 0))).withColumn("shard", c.shard(F.col("fp")))
    return s.groupBy(F.lower(F.lpad(F.hex("shard"), 2, "0")).alias("shard")).agg(F.count("*").alias("chunks"))


@query(f"WITH {_BASE} SELECT path, sha256(content) AS digest, 0::BIGINT AS missing FROM g1 WHERE octet_length(content) > 0")
def materialize_check(spark, sf):
    own = chunking.fixed_chunks(generation(spark, sf, 1), SIZE, keep_data=True)
    store = own.groupBy("fp").agg(F.any_value("data").alias("payload"))
    return snapshot.assemble(own, store).select("path", F.sha2("content", 256).alias("digest"), "missing")


_GENS = "g AS (SELECT doc_id, unnest(range(0, 4)) AS generation, octet_length(encode(text)) AS n FROM documents), s AS (SELECT generation, n AS logical, CASE WHEN generation = 0 OR doc_id % 33 = generation THEN n // 2 ELSE 0 END AS wire FROM g)"


@query(f"""WITH {_GENS} SELECT CASE WHEN grouping(part) = 1 THEN 'campaign' ELSE part END AS part, coalesce(generation, -1) AS generation, sum(logical)::BIGINT AS logical_bytes, sum(wire)::BIGINT AS wire_bytes, 100 - 100.0::DOUBLE * sum(wire) / sum(logical) AS reduction_pct
FROM (SELECT *, CASE WHEN generation = 0 THEN 'seed' ELSE 'incremental' END AS part FROM s) GROUP BY GROUPING SETS ((part, generation), (part), ())""")
def campaign_reduction(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("logical"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("generation"))
    sent = F.when((F.col("generation") == 0) | (F.col("doc_id") % 33 == F.col("generation")), F.floor(F.col("logical") / 2)).otherwise(0)
    rows = d.withColumn("wire", sent).withColumn("part", F.when(F.col("generation") == 0, "seed").otherwise("incremental"))
    sums = [F.sum("logical").alias("logical_bytes"), F.sum("wire").alias("wire_bytes")]
    each = rows.groupBy("part", "generation").agg(*sums)  # a row a generation; the coarser sums come from these
    total = [F.sum(k).alias(k) for k in ("logical_bytes", "wire_bytes")]
    whole = each.agg(*total).select(F.lit("campaign").alias("part"), F.lit(-1).cast("long").alias("generation"), "logical_bytes", "wire_bytes")
    parts = each.groupBy("part").agg(*total).withColumn("generation", F.lit(-1).cast("long"))
    return each.unionByName(parts).unionByName(whole).withColumn("reduction_pct", 100 - 100 * F.col("wire_bytes") / F.col("logical_bytes"))


@query(f"""WITH {_REFS}, l AS (SELECT list(length ORDER BY length) AS v, count(*) AS n, avg(length) AS mean FROM r0)
SELECT n, mean, v[n * 1 // 100 + 1] AS p1, v[n * 50 // 100 + 1] AS p50, v[n * 99 // 100 + 1] AS p99, v[n] AS most FROM l""")
def size_distribution(spark, sf):
    return snapshot.size_distribution(refs(generation(spark, sf, 0)))


@query(f"WITH {_REFS}, a AS (SELECT DISTINCT fp FROM r0), k AS (SELECT fp FROM r0 INTERSECT SELECT fp FROM r1) SELECT (SELECT count(*) FROM a) AS fps, (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM k) / (SELECT count(*) FROM a) AS share")
def boundary_preservation(spark, sf):
    return snapshot.boundary_preservation(refs(generation(spark, sf, 0)), refs(generation(spark, sf, 1)))


@query("SELECT doc_id, left(sha256(encode(source) || unhex(array_to_string(list_transform(range(0, 8), lambda i: substr(lpad(hex(doc_id), 16, '0'), (15 - 2 * i)::BIGINT, 2)), '')) || unhex(sha256(text))), 32) AS session FROM documents")
def session_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", c.session_id(F.col("source"), F.col("doc_id"), c.fingerprint(F.col("text").cast("binary"))).alias("session"))


@query("""SELECT doc_id, s AS "start", least(1023, n - s)::BIGINT AS length, s + 1023 >= n AS "last" FROM (SELECT doc_id, octet_length(encode(text)) AS n, unnest(range(0, greatest(octet_length(encode(text)), 1), 1023)) AS s FROM documents)""")
def blob_slices(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return d.select("doc_id", F.inline(chunking.slices(F.col("n"), 1023)))


@query("""WITH a AS (SELECT sha256(l_orderkey || '|' || l_linenumber || '|' || l_quantity::DECIMAL(18,2) || '|' || l_extendedprice::DECIMAL(18,2) || '|' || l_returnflag) AS fp FROM lineitem),
b AS (SELECT sha256(l_orderkey || '|' || l_linenumber || '|' || (l_quantity + (l_orderkey % 50 = 3)::INT)::DECIMAL(18,2) || '|' || l_extendedprice::DECIMAL(18,2) || '|' || l_returnflag) AS fp FROM lineitem)
SELECT (SELECT count(*) FROM b) AS rows_total, (SELECT count(*) FROM b ANTI JOIN a USING (fp)) AS rows_new, (SELECT count(*) FROM a ANTI JOIN b USING (fp)) AS rows_gone""")
def row_fingerprint_diff(spark, sf):
    li, money = table(spark, sf, "lineitem"), lambda x: x.cast("decimal(18,2)").cast("string")
    fp = lambda q: F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", money(q), money(F.col("l_extendedprice")), "l_returnflag"), 256)
    both = F.explode(F.array(F.struct(F.unhex(fp(F.col("l_quantity"))).alias("fp"), F.lit(0).alias("side")), F.struct(F.unhex(fp(F.col("l_quantity") + (F.col("l_orderkey") % 50 == 3).cast("int"))).alias("fp"), F.lit(1).alias("side"))))
    own = li.select(both.alias("x")).groupBy("x.fp").agg(F.count_if(F.col("x.side") == 0).alias("a"), F.count_if(F.col("x.side") == 1).alias("b"))  # one scan, one shuffle of 32 bytes a row
    only = lambda here, there: F.coalesce(F.sum(F.when(F.col(there) == 0, F.col(here))), F.lit(0))
    return own.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("rows_total"), only("b", "a").alias("rows_new"), only("a", "b").alias("rows_gone"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content, count(*) AS pieces FROM conversations GROUP BY conv_id")
def conversation_assembly(spark, sf):
    t = table(spark, sf, "conversations")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("content"), F.count("*").alias("pieces"))


@query("SELECT doc_id, n_chars + n_chars // 255 + 16 AS bound, CASE WHEN position('/' IN source || '/' || doc_id) > 0 THEN source ELSE '.' END AS dir, 'g' || lpad(doc_id::VARCHAR, 10, '0') || '.man' AS manifest, 'c' || lpad(doc_id::VARCHAR, 8, '0') || '.dat' AS container FROM documents")
def scalar_formats(spark, sf):
    d, doc = table(spark, sf, "documents"), F.col("doc_id")
    return d.select("doc_id", c.lz_bound(F.col("n_chars")).alias("bound"), c.dirname(F.concat_ws("/", "source", doc.cast("string"))).alias("dir"), c.manifest_file(doc).alias("manifest"), c.container_file(doc).alias("container"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS again FROM documents")
def hex_roundtrip(spark, sf):
    d = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, "zz").otherwise(F.upper(F.sha2(F.col("text").cast("binary"), 256)))
    return d.select("doc_id", c.to_hex(c.from_hex(text)).alias("again"))


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) = 0 THEN 'invalid-argument' WHEN octet_length(encode(text)) > 8192 THEN 'too-large' WHEN doc_id % 10 = 3 THEN 'fingerprint-mismatch' ELSE 'ok' END AS status FROM documents""")
def put_guards(spark, sf):
    d = table(spark, sf, "documents")
    own = F.sha2(F.col("text").cast("binary"), 256)
    return d.select("doc_id", snapshot.put_guard(F.octet_length("text"), F.when(F.col("doc_id") % 10 == 3, "").otherwise(own), own, 8192).alias("status"))


@query("SELECT exp(avg(ln(l_extendedprice / l_quantity))) AS geomean FROM lineitem")
def geometric_mean(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("r"))
    return snapshot.geometric_mean(li, "r")


@query("SELECT doc_id, 3 * 50 / 1000 + n_chars * 8 / (100 * 1e6) AS seconds, 100 - 100 * (n_chars // 2) / n_chars AS reduction_pct FROM documents WHERE n_chars > 0")
def link_cost(spark, sf):
    d = table(spark, sf, "documents").where("n_chars > 0")
    return d.select("doc_id", c.round_trip_cost(F.lit(3), F.lit(50), F.col("n_chars"), F.lit(100)).alias("seconds"), c.reduction_pct(F.floor(F.col("n_chars") / 2), F.col("n_chars")).alias("reduction_pct"))


@query("""WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
b AS (SELECT doc_id, list_transform(range(1, octet_length(encode(text)) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT) AS v FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL))
SELECT doc_id, xor(list_reduce(list_prepend(4294967295, v), lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295) AS crc32c FROM b, t""")
def crc32c_check(spark, sf):
    return table(spark, sf, "documents").select("doc_id", udfs.crc32c_col(F.col("text").cast("binary")).alias("crc32c"))


@query("SELECT DISTINCT o_orderkey * 7919 AS value, 'ok' AS code FROM orders")
def varint_roundtrip(spark, sf):
    v = table(spark, sf, "orders").select((F.col("o_orderkey") * 7919).alias("v")).distinct()
    return v.select(udfs.decode_varint_col(c.varint(F.col("v"))).alias("d")).select(F.col("d.value").cast("long").alias("value"), "d.code")


@query("SELECT doc_id, sha256(text) AS digest, 'ok' AS code FROM documents WHERE octet_length(encode(text)) > 0")
def lz_roundtrip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("raw")).where(F.octet_length("raw") > 0)
    best = d.select("doc_id", "raw", c.smaller(F.col("raw"), udfs.lz_compress_col("raw")).alias("s")).select("doc_id", "raw", "s.*")
    back = best.select("doc_id", "payload", "compressed", udfs.lz_decompress_col("payload", F.octet_length("raw")).alias("d"))
    data = F.when(F.col("compressed"), F.col("d.data")).otherwise(F.col("payload"))
    return back.select("doc_id", F.sha2(data, 256).alias("digest"), F.when(F.col("compressed"), F.col("d.code")).otherwise("ok").alias("code"))


@query("SELECT conv_id, turn, octet_length(encode(text))::INT AS raw_len, sha256(text) AS digest, 'ok' AS code FROM conversations")
def frame_roundtrip(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("raw"))
    f = t.select("conv_id", "turn", udfs.decode_frame_col(udfs.encode_frame_col(F.lit(8), F.lit(0), "turn", F.octet_length("raw"), "raw")).alias("f"))
    return f.select("conv_id", "turn", "f.raw_len", F.sha2("f.payload", 256).alias("digest"), "f.code")


@query(f"WITH {_BASE} SELECT split_part(path, '/', 2) AS dataset, count(*) AS files, sum(octet_length(content))::BIGINT AS bytes, sum((octet_length(content) + {SIZE - 1}) // {SIZE})::BIGINT AS chunks FROM g0 GROUP BY 1")
def manifest_roundtrip(spark, sf):
    return manifest_totals(generation(spark, sf, 0))


def manifest_totals(files: DataFrame, aim: int = 4 << 20) -> DataFrame:
    """(dataset, files, bytes, chunks) of files, read back from their manifests of about `aim` bytes each."""
    n = F.octet_length("content")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(SIZE))).otherwise(F.array().cast("array<int>"))
    part = lambda i: F.substring(F.col("content"), i + 1, F.lit(SIZE))
    chunks = F.transform(starts, lambda i: F.struct(c.fingerprint(part(i)).alias("fp"), F.octet_length(part(i)).alias("length")))
    rows = files.withColumn("dataset", F.split("path", "/")[1]).withColumn("row", F.monotonically_increasing_id())
    # a manifest is one value of at most 64 MiB, so a dataset's files are dealt over as many as they need
    weight = 128 + F.octet_length("path") + 40 * F.ceil(F.col("size") / SIZE)
    large = rows.groupBy("dataset").agg(F.ceil(F.sum(weight) / aim).alias("n")).where("n > 1")  # one row per `aim` bytes at most
    rows = rows.join(F.broadcast(large), "dataset", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("n", F.lit(1))))
    rows = rows.select("dataset", "part", "path", "mode", "size", "mtime_ns", "digest", chunks.alias("chunks"))

    def encode(pdf):
        import pandas as pd

        dataset, out = pdf["dataset"].iloc[0], []
        for _, own in pdf.groupby(pdf.groupby("path").cumcount()):  # a manifest holds a path once
            files = [codecs.FileEntry(r.path, r.mode, r.size, r.mtime_ns, bytes(r.digest), [(bytes(x["fp"]), x["length"]) for x in r.chunks]) for r in own.itertuples()]
            out.append((codecs.encode_manifest(codecs.Manifest(0, dataset, files)),))
        return pd.DataFrame(out, columns=["data"])

    read = rows.groupBy("dataset", "part").applyInPandas(encode, "data binary").select(udfs.decode_manifest_col("data").alias("m"))
    fine = F.when(F.col("m.code") == "ok", F.col("m.files")).otherwise(F.raise_error(F.concat(F.lit("a manifest cannot be read: "), "m.code")))
    total = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["size"])
    count = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + F.size(f["chunks"]))
    own = read.select("m.dataset", fine.alias("files")).select("dataset", F.size("files").cast("long").alias("files"), total.alias("bytes"), count.alias("chunks"))
    return own.groupBy("dataset").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum("chunks").alias("chunks"))
