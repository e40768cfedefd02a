"""Queries over stores, trees and binary files that they write to the shared folder first, and over plans of arriving chunks.

They run on the same two generations as the queries over tables; chunks are of SIZE bytes, so SQL can cut them too.
"""

from __future__ import annotations

import os
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import columns as c
from ..operators import chunking, snapshot
from ..schema import FILES, EngineError
from ..shared import mounted, shared_dir
from ..sources import tree
from . import faults
from .campaign import campaign, shifted_boundaries
from .job import replicate
from .queries import _BASE, _CANON, _REFS, SIZE, _ladder, _needed, generation, query, refs, store_of, table
from .store import Store

FIXED = chunking.Params(SIZE, SIZE, SIZE)


def written_tree(spark: SparkSession, sf: str, number: int) -> str:
    """The path of a generation as files."""
    out = f"{mounted(shared_dir(spark))}/tree"
    tree.write_files(generation(spark, sf, number), out)
    return out


def chunk_data(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, chunks) of a generation: path, chunk_no, offset, length, fp; and fp, payload of each chunk once."""
    own = chunking.fixed_chunks(files, SIZE, keep_data=True)
    return own.drop("data"), own.groupBy("fp").agg(F.any_value("data").alias("payload"))


def filled_store(spark: SparkSession, sf: str, *numbers: int, shift: int = 0) -> Store:
    """A store with these generations committed, numbered from `shift` on."""
    store = Store.open(spark, f"{shared_dir(spark)}/store", FIXED)
    for n in numbers:
        files = generation(spark, sf, n)
        own, chunks = chunk_data(files)
        store.put(chunks)
        store.commit("docs", n + shift, files, own)
    return store


@query(f"WITH {_BASE} SELECT path, 420 AS mode, octet_length(content)::BIGINT AS size, mtime_ns, sha256(content) AS digest FROM g0")
def tree_source(spark, sf):
    tree.register(spark)
    rows = spark.read.format("tree").load(written_tree(spark, sf, 0))
    return rows.select("path", "mode", "size", "mtime_ns", F.sha2("content", 256).alias("digest"))


@query(f'WITH {_REFS} SELECT path, chunk_no, "offset", length, fp FROM r0')
def tree_chunks_source(spark, sf):
    _, own = tree.scan(spark, written_tree(spark, sf, 0), FIXED, payload=False)
    return own.select("path", "chunk_no", "offset", "length", c.to_hex(F.col("fp")).alias("fp"))


@query(f"WITH {_REFS} SELECT (SELECT count(*) FROM g0) AS files, (SELECT sum(octet_length(content))::BIGINT FROM g0) AS logical_bytes, (SELECT count(*) FROM r0) AS chunk_refs, 1::BIGINT AS skipped")
def tree_source_stats(spark, sf):
    root = written_tree(spark, sf, 0)
    os.symlink("/dev/null", f"{root}/link")  # is no regular file
    return tree.scan_stats(*tree.scan(spark, root, FIXED, payload=False), root)


@query(f"WITH {_REFS}, a AS (SELECT fp, any_value(length) AS n FROM r1 GROUP BY fp) SELECT fp, CASE WHEN fp IN (SELECT fp FROM r0) THEN n END::INT AS n_bytes, CASE WHEN fp IN (SELECT fp FROM r0) THEN 'ok' ELSE 'not-found' END AS status FROM a")
def store_lookup(spark, sf):
    store = filled_store(spark, sf, 0)
    found = store.get(refs(generation(spark, sf, 1)).select("fp"))
    return found.select(c.to_hex(F.col("fp")).alias("fp"), F.octet_length("payload").alias("n_bytes"), "status")


@query(f"WITH {_REFS}, a AS (SELECT fp, length FROM r0 UNION SELECT fp, length FROM r1) SELECT count(*) AS chunks, sum(length)::BIGINT AS bytes_stored FROM a")
def store_totals(spark, sf):
    return filled_store(spark, sf, 0, 1).totals()


@query(f"""WITH {_REFS} SELECT 'docs' AS dataset, 0::BIGINT AS generation, count(*) AS files, sum(octet_length(content))::BIGINT AS logical_bytes, (SELECT count(*) FROM r0) AS chunk_refs FROM g0
UNION ALL SELECT 'docs', 1, count(*), sum(octet_length(content))::BIGINT, (SELECT count(*) FROM r1) FROM g1""")
def store_catalog(spark, sf):
    return filled_store(spark, sf, 0, 1).catalog()


@query(f"""WITH {_REFS} SELECT 'missing chunk' AS problem, fp AS detail FROM r0 WHERE left(fp, 1) = '0' GROUP BY fp
UNION ALL SELECT 'gap in generations', 'docs' UNION ALL SELECT 'altered manifest', 'docs 3'""")
def store_problems(spark, sf):
    store = filled_store(spark, sf, 0, shift=3)
    for shard in range(16):
        store.remove(f"chunks/shard={shard}")
    attempt = store.commits().first().attempt
    spark.createDataFrame([("one/more", 420, 0, 0, b"")], FILES).write.mode("append").parquet(f"{store.root}/files/attempt={attempt}")
    return store.problems(deep=True)


@query(f"WITH {_BASE} SELECT path, 420 AS mode, octet_length(content)::BIGINT AS size, sha256(content) AS digest FROM g1")
def store_materialize(spark, sf):
    store, out = filled_store(spark, sf, 0, 1), f"{mounted(shared_dir(spark))}/out"
    store.materialize("docs", 1, out)
    tree.register(spark)
    return spark.read.format("tree").load(out).select("path", "mode", "size", F.sha2("content", 256).alias("digest"))


@query("SELECT 1 AS swept, 1 AS generations, 0 AS problems")
def store_sweep(spark, sf):
    store = filled_store(spark, sf, 0)
    files = generation(spark, sf, 1)
    own, chunks = chunk_data(files)
    store.put(chunks)
    faults.arm("before_marker")
    try:
        store.commit("docs", 1, files, own)
    except EngineError:
        pass  # the attempt died before it was visible
    finally:
        faults.clear()
    return spark.createDataFrame([(store.sweep(), store.commits().count(), store.problems().count())], "swept int, generations int, problems int")


@query(f"""WITH {_REFS}, d0 AS (SELECT DISTINCT fp, length FROM r0), d1 AS (SELECT DISTINCT fp, length FROM r1), n1 AS (SELECT * FROM d1 WHERE fp NOT IN (SELECT fp FROM r0)),
u AS (SELECT g1.content FROM g1 JOIN g0 USING (path, mtime_ns) WHERE g0.content = g1.content)
SELECT 0::BIGINT AS generation, (SELECT count(*) FROM g0) AS files, 0::BIGINT AS files_unchanged, 0::BIGINT AS bytes_in_unchanged, (SELECT sum(octet_length(content))::BIGINT FROM g0) AS logical_bytes, count(*) AS chunks_total, count(*) AS chunks_sent, 0::BIGINT AS chunks_skipped,
  sum(length)::BIGINT AS payload_bytes, 0::BIGINT AS skipped_bytes, (SELECT sum(octet_length(encode(path)) + 56)::BIGINT FROM g0) + 36 * (SELECT count(*) FROM r0) AS manifest_bytes, 100 - 100.0::DOUBLE * sum(length) / (SELECT sum(octet_length(content)) FROM g0) AS reduction_pct FROM d0
UNION ALL SELECT 1, (SELECT count(*) FROM g1), (SELECT count(*) FROM u), (SELECT sum(octet_length(content))::BIGINT FROM u), (SELECT sum(octet_length(content))::BIGINT FROM g1), (SELECT count(*) FROM d1), (SELECT count(*) FROM n1), (SELECT count(*) FROM d1) - (SELECT count(*) FROM n1),
  (SELECT sum(length)::BIGINT FROM n1), (SELECT sum(length)::BIGINT FROM d1) - (SELECT sum(length)::BIGINT FROM n1), (SELECT sum(octet_length(encode(path)) + 56)::BIGINT FROM g1) + 36 * (SELECT count(*) FROM r1), 100 - 100.0::DOUBLE * (SELECT sum(length) FROM n1) / (SELECT sum(octet_length(content)) FROM g1)""")
def replicate_job(spark, sf):
    store = Store.open(spark, f"{shared_dir(spark)}/store", FIXED)
    done = [replicate(spark, written_tree(spark, sf, n), store, "docs", n) for n in (0, 1)]
    kinds = {"reduction_pct": "double"}
    names = "generation files files_unchanged bytes_in_unchanged logical_bytes chunks_total chunks_sent chunks_skipped payload_bytes skipped_bytes manifest_bytes reduction_pct".split()
    return spark.createDataFrame([tuple(d[n] for n in names) for d in done], ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names))


def _write_groups(rows: DataFrame, key: str, folder: str, encode) -> None:
    """A file for each value of `key` (its name) below a mounted folder; `encode` makes its bytes from the group's Arrow table."""

    def write(keys, part):
        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/{keys[0].as_py()}"
        with open(f"{name}.{os.getpid()}.tmp", "wb") as f:
            f.write(encode(part))
        os.replace(f.name, name)
        return pa.table({"n": [part.num_rows]})

    rows.groupBy(key).applyInArrow(write, "n long").agg(F.sum("n")).collect()  # one row


def _records(part: pa.Table) -> bytes:
    """Chunks in order of their names, a damaged stretch after the first, and a torn tail."""
    rows = sorted(zip(part.column("fp").to_pylist(), part.column("payload").to_pylist(), strict=True))
    own = [codecs.encode_record(data) for _, data in rows]
    return own[0] + b"x" * 21 + b"".join(own[1:]) + own[0][:7]


@query(f"""WITH {_REFS}, d AS (SELECT DISTINCT fp, length FROM r0),
o AS (SELECT *, left(fp, 2) AS s, row_number() OVER (PARTITION BY left(fp, 2) ORDER BY fp) AS k, sum(48 + length) OVER (PARTITION BY left(fp, 2) ORDER BY fp) AS e FROM d),
p AS (SELECT 'c' || lpad((('0x' || s)::INT)::VARCHAR, 8, '0') || '.dat' AS container, * FROM o)
SELECT container, 'record' AS kind, (e - 48 - length + CASE WHEN k > 1 THEN 21 ELSE 0 END)::BIGINT AS "offset", (48 + length)::BIGINT AS length, fp FROM p
UNION ALL SELECT container, CASE WHEN n > 1 THEN 'damage' ELSE 'torn' END, first_end, CASE WHEN n > 1 THEN 21 ELSE 28 END, NULL FROM (SELECT container, count(*) AS n, min(e)::BIGINT AS first_end FROM p GROUP BY container)
UNION ALL SELECT container, 'torn', max(e)::BIGINT + 21, 7, NULL FROM p GROUP BY container HAVING count(*) > 1""")
def container_scan(spark, sf):
    _, chunks = chunk_data(generation(spark, sf, 0))
    folder = f"{mounted(shared_dir(spark))}/containers"
    _write_groups(chunks.withColumn("file", c.container_file(c.shard(F.col("fp")).cast("int"))), "file", folder, _records)
    tree.register(spark)
    return spark.read.format("chunk_container").load(folder).select("container", "kind", "offset", "length", c.to_hex(F.col("fp")).alias("fp"))


def _journal(part: pa.Table) -> bytes:
    rows = sorted(zip(part.column("dataset").to_pylist(), part.column("generation").to_pylist(), part.column("digest").to_pylist(), strict=True))
    return b"".join(codecs.encode_commit(*r) for r in rows) + b"\0" * 5


@query("""WITH d AS (SELECT DISTINCT 'set' || (o_custkey % 7) AS dataset, o_orderkey % 5 AS generation FROM orders)
SELECT dataset, generation, sha256(dataset || '/' || generation) AS digest, (SELECT sum(56 + octet_length(encode(dataset)))::BIGINT FROM d) AS sound_bytes FROM d""")
def journal_scan(spark, sf):
    own = table(spark, sf, "orders").select(F.concat(F.lit("set"), (F.col("o_custkey") % 7).cast("string")).alias("dataset"), (F.col("o_orderkey") % 5).cast("long").alias("generation")).distinct()
    own = own.withColumn("digest", F.unhex(F.sha2(F.concat_ws("/", "dataset", "generation").cast("binary"), 256))).withColumn("file", F.lit("GENERATIONS"))
    folder = f"{mounted(shared_dir(spark))}/journal"
    _write_groups(own, "file", folder, _journal)
    tree.register(spark)
    return spark.read.format("commit_journal").load(folder).select("dataset", "generation", c.to_hex(F.col("digest")).alias("digest"), "sound_bytes")


_ISLANDS = """isl AS (SELECT idx, idx - row_number() OVER (ORDER BY idx) AS k FROM (SELECT DISTINCT idx FROM u))"""


@query(f"""WITH {_CANON}, u AS (SELECT idx FROM need UNION SELECT idx FROM canon WHERE idx % 3 > 0), {_ISLANDS} SELECT min(idx) AS "start", max(idx) AS "last" FROM isl GROUP BY k""")
def need_union(spark, sf):
    cur, needed = _needed(spark, sf)
    runs = partial(snapshot.need_runs, block=64)
    return snapshot.union_runs(runs(needed), runs(cur.where("idx % 3 > 0")), block=64)


def _batches(rows: str, limit: int) -> str:
    """Recursive SQL over `rows` (seq, n): the batch of each, and what it holds."""
    return f"""w AS (SELECT seq, n::BIGINT AS n, 0::BIGINT AS batch, n::BIGINT AS held FROM {rows} WHERE seq = 0
 UNION ALL SELECT p.seq, p.n::BIGINT, w.batch + (w.held >= {limit})::INT, CASE WHEN w.held >= {limit} THEN p.n ELSE w.held + p.n END FROM w JOIN {rows} p ON p.seq = w.seq + 1)"""


@query(f"WITH RECURSIVE {_CANON}, p AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS seq, length + {_ladder('length')} AS n FROM need), {_batches('p', 4096)} SELECT max(seq) AS seq, sum(n)::BIGINT AS bytes FROM w GROUP BY batch HAVING sum(n) >= 4096")
def checkpoint_marks(spark, sf):
    return snapshot.checkpoint_marks(snapshot.send_plan(_needed(spark, sf)[1]), 4096, block=8)


@query(f"WITH RECURSIVE {_CANON}, p AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS seq, length + 48 + {_ladder('length + 48')} AS n FROM need), {_batches('p', 3000)} SELECT seq, batch AS container FROM w")
def container_roll(spark, sf):
    return snapshot.roll_containers(snapshot.send_plan(_needed(spark, sf)[1]), 3000, block=4)


@query(f"""WITH {_CANON}, p AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS seq, fp FROM need), a AS (SELECT seq, fp FROM p UNION ALL SELECT seq + 1000000, fp FROM p WHERE seq % 5 = 0)
SELECT seq, CASE WHEN seq >= 1000000 THEN 'protocol' WHEN seq % 7 = 3 THEN 'fingerprint-mismatch' ELSE 'ok' END AS status FROM a""")
def expected_arrivals(spark, sf):
    plan = snapshot.send_plan(_needed(spark, sf)[1])
    _, chunks = chunk_data(generation(spark, sf, 1))
    sent = plan.select("seq", "fp").join(chunks, "fp").select("seq", F.when(F.col("seq") % 7 == 3, F.lit(b"other")).otherwise(F.col("payload")).alias("payload"))
    late = sent.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 1_000_000)
    return snapshot.expected_arrivals(sent.unionByName(late), plan).select("seq", "status")


@query("""SELECT 's' || doc_id AS session, CASE WHEN doc_id % 7 = 1 THEN 'not-found' WHEN doc_id % 7 = 2 THEN 'protocol' WHEN doc_id % 7 = 3 THEN 'fingerprint-mismatch' ELSE 'ok' END AS status FROM documents""")
def session_guard(spark, sf):
    doc = F.col("doc_id")
    own = table(spark, sf, "documents").select(F.concat(F.lit("s"), doc.cast("string")).alias("session"), F.col("source").alias("dataset"), (doc % 5).alias("generation"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), doc.alias("doc"))
    sent = own.where("doc % 7 <> 1").select("session", "dataset", F.when(F.col("doc") % 7 == 2, 9).otherwise(F.col("generation")).alias("generation"), F.when(F.col("doc") % 7 == 3, "other").otherwise(F.col("digest")).alias("digest"))
    return snapshot.session_guard(sent, own.drop("doc"))


@query(f"WITH {_REFS} SELECT count(*) AS n, 100.0::DOUBLE * count(*) FILTER (WHERE length = {SIZE}) / count(*) AS forced_pct FROM r0")
def forced_cuts(spark, sf):
    return snapshot.size_distribution(refs(generation(spark, sf, 0)), high=SIZE).select("n", "forced_pct")


@query(f"WITH {_REFS}, r AS (SELECT path, chunk_no + 1000 * (left(path, 4) = 'copy')::INT AS seq, fp FROM r1) SELECT left(fp, 2) AS shard, count(DISTINCT fp) AS chunks, count(*) AS refs FROM r GROUP BY 1")
def shard_load(spark, sf):
    own = refs(generation(spark, sf, 1)).withColumn("shard", c.shard(F.col("fp")))
    once = store_of(own).withColumn("shard", c.shard(F.col("fp"))).groupBy("shard").agg(F.count("*").alias("chunks"))
    all_ = own.groupBy("shard").agg(F.count("*").alias("refs"))
    return once.join(all_, "shard").select(F.lower(F.lpad(F.hex("shard"), 2, "0")).alias("shard"), "chunks", "refs")


@query()
def campaign_run(spark, sf):
    """Eight generations of a synthetic corpus: what each holds and sends (no table; SQL cannot compress)."""
    return campaign(spark)


@query("SELECT 'content' AS cut, true AS kept_most, false AS lost_most UNION ALL SELECT 'size', false, true")
def shift_control(spark, sf):
    found = shifted_boundaries(spark)
    return found.select("cut", (F.col("share") > 0.98).alias("kept_most"), (F.col("share") < 0.02).alias("lost_most"))
