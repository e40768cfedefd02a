"""A replication job: scan, set difference, transfer of what is missing, commit; and again after a failure.

Nothing is kept between attempts but the store: the set difference against it is the resume.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshot
from ..schema import EngineError
from ..sources.tree import CHUNK_COLUMNS, chunk_rows, parts_of
from .store import Store

#: Errors after which another attempt may succeed.
RETRIED = {"io", "closed", "reset", "timeout", "fault-injected", "short-read"}


def attempt(store: Store, dataset: str, generation: int, files: DataFrame, refs: DataFrame) -> dict:
    """One pass over a scanned tree; its statistics. Payloads are read only of chunks that the store lacks, each from its first place."""
    own = snapshot.canonical(refs)
    missing = snapshot.need(own, store.fingerprints()).persist()
    try:
        total = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
        sent = missing.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
        if sent.n:
            places = missing.select("path", "chunk_no")
            store.put(refs.join(places, ["path", "chunk_no"], "left_semi").select("fp", "payload"))
    finally:
        missing.unpersist()
    unchanged = None
    if generation and store._marker(dataset, generation - 1):
        same = snapshot.files_unchanged(store.manifest(dataset, generation - 1)[0], files)
        unchanged = same.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    logical = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    digest = store.commit(dataset, generation, files, refs)
    # a file takes a path's length, its path, mode, size, time, digest and chunk count; a reference a name and a length
    manifest = files.agg(F.coalesce(F.sum(F.octet_length("path") + 56), F.lit(0)).alias("b")).first().b + 36 * refs.count()
    return {
        "dataset": dataset, "generation": generation, "digest": digest, "files": logical.n, "files_unchanged": unchanged.n if unchanged else 0,
        "bytes_in_unchanged": unchanged.b if unchanged else 0, "logical_bytes": logical.b, "chunks_total": total.n, "chunks_sent": sent.n, "chunks_skipped": total.n - sent.n,
        "payload_bytes": sent.b, "skipped_bytes": total.b - sent.b, "manifest_bytes": manifest, "reduction_pct": 100 - 100 * sent.b / logical.b if logical.b else 0.0,
    }


def replicate(spark: SparkSession, root: str, store: Store, dataset: str, generation: int, most_attempts: int = 6) -> dict:
    """Scan once, then try until the generation is visible; errors that a repeat cannot mend are raised at once.

    The scan is written below the store before anything is taken from it, so every step sees the same files, however they change
    meanwhile, and none reads the tree again; it goes when the job ends.
    """
    at = f"{store.root}/scans/{uuid.uuid4().hex}"
    try:
        chunk_rows(spark, root, store.params).write.parquet(at)
        files, refs = parts_of(spark.read.schema(CHUNK_COLUMNS).parquet(at))
        for k in range(1, most_attempts + 1):
            try:
                return attempt(store, dataset, generation, files, refs) | {"attempts": k}
            except EngineError as e:
                if e.code not in RETRIED or k == most_attempts:
                    raise
    finally:
        store.remove(at.removeprefix(store.root + "/"))
    raise AssertionError
