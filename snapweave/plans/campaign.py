"""A campaign: a corpus replicated generation after generation, and what that sends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import udfs
from ..operators import chunking, snapshot
from ..shared import shared_dir
from ..sources.corpus import corpus

REPORT = "part string, generation long, logical_bytes long, chunks_total long, chunks_sent long, payload_bytes long, compressed_bytes long, manifest_bytes long, wire_bytes long, reduction_pct double"


def generation_cost(files: DataFrame, before: DataFrame | None, params: chunking.Params) -> DataFrame:
    """One row: what a generation holds and sends when `before` (fp) is in the store. Wire bytes are the manifest's and the sent chunks',
    each chunk compressed where that makes it smaller."""
    refs = chunking.cdc_chunks(files, params)
    own = refs.groupBy("fp").agg(F.min(F.struct("path", "offset", "length")).alias("f"))
    missing = own.join(before, "fp", "left_anti") if before is not None else own
    payload = missing.select("f.*").join(files.select("path", "content"), "path").select(F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length")).alias("raw"))
    best = payload.select("raw", c.smaller(F.col("raw"), udfs.lz_compress_col("raw")).alias("s"))
    size = lambda x: F.coalesce(F.sum(F.octet_length(x)), F.lit(0)).cast("long")
    sent = best.agg(F.count("*").alias("chunks_sent"), size("raw").alias("payload_bytes"), size("s.payload").alias("compressed_bytes"))
    held = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum(F.octet_length("path") + 56), F.lit(0)).alias("entries"))
    all_ = refs.agg(F.count("*").alias("n_refs"), F.count_distinct("fp").alias("chunks_total"))
    row = held.crossJoin(all_).crossJoin(sent).withColumn("manifest_bytes", F.col("entries") + 36 * F.col("n_refs"))  # one row each
    return row.withColumn("wire_bytes", F.col("manifest_bytes") + F.col("compressed_bytes")).drop("entries", "n_refs")


def campaign(spark: SparkSession, generations: int = 8, files: int = 300, seed: int = 1, params: chunking.Params = chunking.Params()) -> DataFrame:
    """REPORT of every generation, of the first (`seed`), of those after it, and of all. A generation's chunks are looked up in all before it."""
    at, rows = f"{shared_dir(spark)}/campaign", []
    for g in range(generations):
        own = corpus(spark, g, files, seed)
        rows.append((g, generation_cost(own, spark.read.parquet(at).select("fp").distinct() if g else None, params).first().asDict()))
        chunking.cdc_chunks(own, params).select("fp").distinct().write.mode("append").parquet(at)
    names = [x.split()[0] for x in REPORT.split(", ")][2:-1]

    def line(part, generation, some):
        sums = {n: sum(r[n] for r in some) for n in names}
        return (part, generation, *(sums[n] for n in names), 100 - 100 * sums["wire_bytes"] / max(1, sums["logical_bytes"]))

    out = [line("seed" if g == 0 else "incremental", g, [r]) for g, r in rows]
    out += [line(part, -1, [r for g, r in rows if g in some]) for part, some in (("seed", range(1)), ("incremental", range(1, generations)), ("campaign", range(generations)))]
    return spark.createDataFrame(out, REPORT)


def controls(spark: SparkSession, size: int = 4_000_000, seed: int = 1, params: chunking.Params = chunking.Params()) -> DataFrame:
    """What one file of noise costs, and what a change of one byte in it costs afterwards: control, chunks_sent, wire_bytes, reduction_pct."""
    from ..sources.corpus import FILES, content

    data = content(2, size, seed, 0)
    edited = data[: size // 2] + bytes([data[size // 2] ^ 1]) + data[size // 2 + 1 :]
    frame = lambda x: spark.createDataFrame([("noise.bin", 420, len(x), 0, x)], FILES)
    first = generation_cost(frame(data), None, params)
    second = generation_cost(frame(edited), chunking.cdc_chunks(frame(data), params).select("fp").distinct(), params)
    rows = first.withColumn("control", F.lit("incompressible")).unionByName(second.withColumn("control", F.lit("one byte")))
    return rows.select("control", "chunks_sent", "wire_bytes", (100 - 100 * F.col("wire_bytes") / F.col("logical_bytes")).alias("reduction_pct"))


def shifted_boundaries(spark: SparkSession, size: int = 4 << 20, at: int = 1_000, seed: int = 1, params: chunking.Params = chunking.Params()) -> DataFrame:
    """The share of chunks that survive a byte put in at a place, cut by content and by size."""
    from ..sources.corpus import content

    data = content(2, size, seed, 0)
    one, two = (spark.createDataFrame([("f", x)], "path string, content binary") for x in (data, data[:at] + b"!" + data[at:]))
    cut = {"content": lambda d: chunking.cdc_chunks(d, params), "size": lambda d: chunking.fixed_chunks(d, params.avg)}
    parts = [snapshot.boundary_preservation(f(one), f(two)).withColumn("cut", F.lit(k)) for k, f in cut.items()]
    return parts[0].unionByName(parts[1]).select("cut", "fps", "kept", "share")
