"""The relational core: which chunks are new, how they are numbered, packed, sent and checked.

Tables: files (path, mode, size, mtime_ns, digest), refs (path, chunk_no, offset, length, fp), store (fp, ...).
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fingerprint, varint_size
from ..schema import BATCH_BYTES, CHECKPOINT_BYTES, CONTAINER_BYTES, RECORD_HEAD, REORDER_WINDOW

#: Rows of a range of a dense numbering, about, and the most ranges (their bounds are literals of a plan).
RANGE_ROWS, MOST_RANGES = 1_000_000, 4_096
#: Indices per block when runs are formed block by block.
RUN_BLOCK = 1 << 16


def dense_number(rows: DataFrame, order: list[str], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`rows` (distinct in `order`) with their rank from 0 in that order.

    The rows are cut into ranges of about `range_rows` at boundaries from a bounded sample; ranks within a range plus
    the counts of the ranges before it (a table of a row a range) number them without one task seeing all. A row finds its
    range by a search through halves, so their number may grow with the data.
    """
    total = rows.count()
    ranges = min(MOST_RANGES, -(-total // range_rows))
    key, types, bounds = F.struct(*order), dict(rows.dtypes), []
    if ranges > 1:
        picked = sorted(r.k for r in rows.where(F.pmod(F.xxhash64(*order), F.lit(max(1, total // (64 * ranges)))) == 0).select(key.alias("k")).collect())
        bounds = sorted({picked[len(picked) * i // ranges] for i in range(1, ranges)}) if picked else []
    literal = lambda r: F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in order])

    def range_of(low: int, high: int) -> Column:
        """The number of bounds, of those from low to high, that are at most the key; low if none."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < literal(bounds[middle]), range_of(low, middle)).otherwise(range_of(middle + 1, high))

    cut = rows.withColumn("_part", range_of(0, len(bounds)))
    counts = cut.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own").cast("long") - 1 + F.col("_before")).drop("_part", "_own", "_before")


def canonical(refs: DataFrame) -> DataFrame:
    """Every distinct fingerprint once, numbered by its first place: (idx, fp, length, path, chunk_no)."""
    first = refs.groupBy("fp").agg(F.min(F.struct("path", "chunk_no", "length")).alias("f"))
    return dense_number(first.select("fp", "f.path", "f.chunk_no", "f.length"), ["path", "chunk_no"], "idx").select("idx", "fp", "length", "path", "chunk_no")


def need(canonical_: DataFrame, store: DataFrame) -> DataFrame:
    """The set difference: canonical chunks whose fingerprint the store does not hold."""
    return canonical_.join(store.select("fp"), "fp", "left_anti")


def present(canonical_: DataFrame, store: DataFrame) -> DataFrame:
    """Canonical chunks that need not be sent."""
    return canonical_.join(store.select("fp"), "fp", "left_semi")


def files_unchanged(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Files equal in path, size, mode, time and digest. For attribution only: their chunks are still compared."""
    return current.join(previous, ["path", "size", "mode", "mtime_ns", "digest"], "left_semi")


def negotiation_summary(current: DataFrame, refs: DataFrame, needed: DataFrame, canonical_: DataFrame, unchanged: DataFrame) -> DataFrame:
    """One row: chunks, bytes and files in all, needed and unchanged. Chunks are counted once, with a mark on those that are needed;
    so are files, with a mark on those that are unchanged."""
    size = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("long")
    marked = canonical_.select("idx", "length").join(needed.select("idx", F.lit(1).alias("need")), "idx", "left")
    chunks = marked.agg(
        F.count("*").alias("chunks_total"), size("length").alias("bytes_total"), F.count("need").alias("chunks_needed"), size(F.when(F.col("need") == 1, F.col("length"))).alias("bytes_needed")
    )
    files = current.agg(F.count("*").alias("files_total"), size("size").alias("logical_bytes"))
    same = unchanged.agg(F.count("*").alias("files_unchanged"), size("size").alias("bytes_in_unchanged"))
    return chunks.crossJoin(files).crossJoin(same).crossJoin(refs.agg(F.count("*").alias("chunk_refs")))  # one row each


def need_runs(indices: DataFrame, block: int = RUN_BLOCK) -> DataFrame:
    """Maximal runs (start, last) of distinct indices `idx`: islands within blocks, then joined across block borders."""
    own = Window.partitionBy("b").orderBy("idx")
    rows = indices.select(F.col("idx").cast("long")).distinct().withColumn("b", F.floor(F.col("idx") / block))
    runs = rows.withColumn("k", F.col("idx") - F.row_number().over(own)).groupBy("b", "k").agg(F.min("idx").alias("start"), F.max("idx").alias("last"))
    return _across_blocks(runs, block)


def _across_blocks(runs: DataFrame, block: int) -> DataFrame:
    """Runs within blocks, with those that touch at a border made one."""
    touches = (F.pmod("start", F.lit(block)) == 0) | (F.pmod(F.col("last") + 1, F.lit(block)) == 0)
    all_ = Window.orderBy("start")  # at most two runs of a block
    edge = runs.where(touches).withColumn("new", F.when(F.col("start") == F.lag("last").over(all_) + 1, 0).otherwise(1)).withColumn("k", F.sum("new").over(all_))
    return edge.groupBy("k").agg(F.min("start").alias("start"), F.max("last").alias("last")).select("start", "last").unionByName(runs.where(~touches).select("start", "last"))


def run_deltas(runs: DataFrame, block: int = RUN_BLOCK) -> DataFrame:
    """What a run list encodes: gap to the run before, and length less one. Blocks of indices are walked side by side."""
    rows = runs.select("start", "last", F.floor(F.col("start") / block).alias("b"))
    ends = rows.groupBy("b").agg(F.max("last").alias("end"))  # a row a block
    ends = ends.select("b", F.lag("end").over(Window.orderBy("b")).alias("end"))
    before = F.coalesce(F.lag("last").over(Window.partitionBy("b").orderBy("start")), "end")
    found = rows.join(ends, "b").withColumn("before", before)
    return found.select("start", "last", (F.col("start") - F.coalesce(F.col("before") + 1, F.lit(0))).alias("gap"), (F.col("last") - F.col("start")).alias("extra"))


def union_runs(a: DataFrame, b: DataFrame, block: int = RUN_BLOCK) -> DataFrame:
    """The maximal runs that cover what either run list covers: overlapping and touching runs become one.

    Runs are cut at block borders and merged within blocks by the largest end so far, then across borders.
    """
    both = a.select("start", "last").unionByName(b.select("start", "last"))
    blocks = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("last") / block)))
    cut = both.select("start", "last", blocks.alias("b")).select("b", F.greatest("start", F.col("b") * block).alias("start"), F.least("last", (F.col("b") + 1) * block - 1).alias("last"))
    own = Window.partitionBy("b").orderBy("start", "last")
    opens = F.when(F.col("start") <= F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1)
    runs = cut.withColumn("new", opens).withColumn("k", F.sum("new").over(own)).groupBy("b", "k").agg(F.min("start").alias("start"), F.max("last").alias("last"))
    return _across_blocks(runs, block)


def encoded_size(runs: DataFrame) -> DataFrame:
    """Bytes of the encoded run list."""
    return run_deltas(runs).agg(F.coalesce(F.sum(varint_size(F.col("gap")) + varint_size(F.col("extra"))), F.lit(0)).cast("long").alias("encoded_bytes"))


def expand_runs(runs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Every index of every run. Long runs are expanded piece by piece, so no array grows with a run."""
    pieces = F.explode(F.sequence("start", "last", F.lit(most).cast("long")))
    part = runs.select("last", pieces.alias("s"))
    return part.select(F.explode(F.sequence("s", F.least(F.col("last"), F.col("s") + most - 1))).alias("idx"))


def in_runs(indices: DataFrame, runs: DataFrame, block: int = RUN_BLOCK) -> DataFrame:
    """The indices that lie in a run: runs are cut at block borders and joined by block, so the join is an equi-join."""
    blocks = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("last") / block)))
    cut = runs.select("start", "last", blocks.alias("b"))
    rows = indices.withColumn("b", F.floor(F.col("idx") / block))
    return rows.join(cut, "b").where(F.col("idx").between(F.col("start"), F.col("last"))).select(*indices.columns)


def send_plan(needed: DataFrame) -> DataFrame:
    """Needed chunks in canonical order, numbered from 0: (seq, idx, fp, length, path, chunk_no)."""
    return dense_number(needed, ["idx"], "seq").select("seq", "idx", "fp", "length", "path", "chunk_no")


def chunk_locations(refs: DataFrame) -> DataFrame:
    """The first place of every fingerprint, with its offset in the file as a running sum of lengths."""
    before = Window.partitionBy("path").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = refs.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return placed.groupBy("fp").agg(F.min(F.struct("path", "chunk_no", "offset", "length")).alias("f")).select("fp", "f.*")


def read_chunks(plan: DataFrame, locations: DataFrame, files: DataFrame) -> DataFrame:
    """Chunk bytes by their location, hashed again: (seq, fp, payload, status); `corrupt` if a file changed since its scan."""
    at = plan.select("seq", "fp").join(locations, "fp").join(files.select("path", "content"), "path")
    payload = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length"))
    read = at.select("seq", "fp", payload.alias("payload"))
    return read.withColumn("status", F.when(fingerprint(F.col("payload")) == F.col("fp"), "ok").otherwise("corrupt"))


def greedy_batches(sizes: Iterable[int], limit: int):
    """The batch of each item: a batch closes when it has reached `limit`."""
    batch, held = 0, 0
    for n in sizes:
        if held >= limit:
            batch, held = batch + 1, 0
        held += n
        yield batch


def _leaps(sizes: np.ndarray, limit: int) -> np.ndarray:
    """For every item the first one after the batch that it opens (as many as there are, if that batch stays open)."""
    upto = np.cumsum(sizes)
    return np.minimum(np.searchsorted(upto, upto - sizes + limit, side="left") + 1, len(sizes))


def _openings(sizes: np.ndarray, limit: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(first, count, held) of a block of items: its items up to the first that may open a batch at the latest; for each of
    them, opening a batch there, how many batches open in the block, and how many bytes the last of them holds."""
    n, leap, upto = len(sizes), _leaps(sizes, limit), np.cumsum(sizes)
    count, held = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = int(leap[i])
        closed = upto[j - 1] - upto[i] + sizes[i] >= limit
        count[i], held[i] = (1 + count[j], held[j]) if closed and j < n else (1, upto[n - 1] - upto[i] + sizes[i])
    return list(range(min(n, int(leap[0])) + (n > int(leap[0])))), count, held


def pack_batches(plan: DataFrame, limit: int = BATCH_BYTES, block: int = 1 << 16) -> DataFrame:
    """`plan` (seq dense from 0, length) as batches of consecutive chunks, each with its length in front, until `limit` is reached.

    The running size restarts with every batch, so no window sum gives it. Blocks of positions are walked side by side: since a
    batch ends where `limit` is reached, a block knows for each place where its first batch may open how many batches it opens and what
    the last one holds. One pass over these short lists, a row a block, tells every block its state, and each block numbers its own.
    """
    sized = plan.select("seq", (varint_size(F.col("length")) + F.col("length")).cast("long").alias("n"), F.floor(F.col("seq") / block).alias("b"))

    def summarise(key, rows):
        sizes = rows.sort_by("seq").column("n").to_numpy()
        first, count, held = _openings(sizes, limit)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return pa.table({"b": [key[0].as_py()], "total": [int(upto[-1])], "upto": [upto[first].tolist()], "count": [count[first].tolist()], "held": [held[first].tolist()]})

    lists = "b long, total long, upto array<long>, count array<long>, held array<long>"
    states = sized.groupBy("b").applyInArrow(summarise, lists)

    def chain(batches):
        batch_no, carried = -1, limit  # the first item opens a batch
        for batch in batches:
            out = []
            for b, total, upto, count, held in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                out.append((b, batch_no, carried))
                # the items until the carried batch is full belong to it; the next opens a batch
                k = next((i for i, u in enumerate(upto) if carried + u >= limit), None)
                if k is None or k >= len(count) or count[k] == 0:
                    carried += total
                else:
                    batch_no, carried = batch_no + count[k], held[k]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names=["b", "batch_no", "carried"])

    begun = states.coalesce(1).sortWithinPartitions("b").mapInArrow(chain, "b long, batch_no long, carried long")

    def number(key, rows):
        rows = rows.sort_by("seq")
        sizes = rows.column("n").to_numpy()
        batch_no, held, leap = rows.column("batch_no")[0].as_py(), rows.column("carried")[0].as_py(), _leaps(sizes, limit)
        before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        i = int(np.searchsorted(held + before, limit, side="left"))  # up to here the carried batch goes on
        own = np.zeros(len(sizes), np.int64)
        while i < len(sizes):
            own[i] = 1
            i = int(leap[i])
        return pa.table({"seq": rows.column("seq"), "n": rows.column("n"), "batch": batch_no + np.cumsum(own)})

    return sized.join(begun, "b").groupBy("b").applyInArrow(number, "seq long, n long, batch long")


def checkpoint_marks(plan: DataFrame, every: int = CHECKPOINT_BYTES, block: int = 1 << 16) -> DataFrame:
    """(seq, bytes) of the arrivals after which progress is saved: each time `every` bytes have come since the last time."""
    groups = pack_batches(plan, every, block)
    return groups.groupBy("batch").agg(F.max("seq").alias("seq"), F.sum("n").cast("long").alias("bytes")).where(F.col("bytes") >= every).select("seq", "bytes")


def expected_arrivals(arrivals: DataFrame, plan: DataFrame) -> DataFrame:
    """Arrivals (seq, payload) against the plan (seq, fp): status `ok`, `fingerprint-mismatch`, or `protocol` beyond the plan."""
    found = arrivals.join(plan.select("seq", "fp"), "seq", "left")
    status = F.when(F.col("fp").isNull(), "protocol").when(fingerprint(F.col("payload")) != F.col("fp"), "fingerprint-mismatch").otherwise("ok")
    return found.withColumn("status", status).drop("fp")


def session_guard(manifest: DataFrame, session: DataFrame) -> DataFrame:
    """Per session whether the manifest it was sent (dataset, generation, digest) is the one it asked for."""
    both = session.join(manifest.select("session", *[F.col(k).alias(f"sent_{k}") for k in ("dataset", "generation", "digest")]), "session", "left")
    same = F.col("sent_dataset").eqNullSafe(F.col("dataset")) & F.col("sent_generation").eqNullSafe(F.col("generation"))
    status = F.when(F.col("sent_digest").isNull(), "not-found").when(~same, "protocol").when(F.col("sent_digest") != F.col("digest"), "fingerprint-mismatch").otherwise("ok")
    return both.select("session", status.alias("status"))


def roll_containers(records: DataFrame, limit: int = CONTAINER_BYTES, block: int = 1 << 16) -> DataFrame:
    """`records` (seq, length) dealt to containers: one is closed when it has reached `limit` bytes with its records' heads."""
    plan = records.select("seq", (F.col("length") + RECORD_HEAD).alias("length"))
    return pack_batches(plan, limit, block).select("seq", F.col("batch").alias("container"))


def put_guard(length: Column, claimed: Column, actual: Column, high: int) -> Column:
    """What a store says to a chunk before it takes it."""
    return F.when(length == 0, "invalid-argument").when(length > high, "too-large").when(claimed != actual, "fingerprint-mismatch").otherwise("ok")


def raw_length_ok(compressed: Column, raw: Column, wire: Column) -> Column:
    """A frame's raw length: at least the wire's if compressed, else that or none."""
    return F.when(compressed, raw >= wire).otherwise((raw == 0) | (raw == wire))


def high_water(arrivals: DataFrame, key: str = "session") -> DataFrame:
    """Per session the largest h with every position below h seen, and how many distinct positions there are."""
    own = Window.partitionBy(key).orderBy("seq")
    rows = arrivals.select(key, "seq").distinct().withColumn("rank", F.row_number().over(own) - 1)
    return rows.groupBy(key).agg(F.count_if(F.col("seq") == F.col("rank")).alias("high_water"), F.count("*").alias("seen"))


def out_of_window(arrivals: DataFrame, base: Column, window: int = REORDER_WINDOW) -> DataFrame:
    """Arrivals so far ahead of the contiguous prefix that the protocol refuses them."""
    return arrivals.where(F.col("seq") - base >= window)


def prefix_consistent(commits: DataFrame) -> DataFrame:
    """Per dataset whether its generations are 0..k without a hole."""
    g = F.col("generation")
    ok = (F.min(g) == 0) & (F.max(g) == F.count_distinct(g) - 1)
    return commits.groupBy("dataset").agg(ok.alias("consistent"), F.max(g).alias("latest"), F.count_distinct(g).alias("generations"))


def commit_conflicts(commits: DataFrame) -> DataFrame:
    """(dataset, generation) published with more than one digest."""
    return commits.groupBy("dataset", "generation").agg(F.count_distinct("digest").alias("digests")).where("digests > 1")


def orphans(manifests: DataFrame, commits: DataFrame) -> DataFrame:
    """Manifests that no commit made visible."""
    return manifests.join(commits.select("dataset", "generation"), ["dataset", "generation"], "left_anti")


def size_distribution(lengths: DataFrame, column: str = "length", high: int | None = None) -> DataFrame:
    """Mean, largest and the values at n*p div 100 of the ascending sizes (no interpolation), and with `high` the per cent of sizes that
    were forced to it: value counts, then running sums."""
    counts = lengths.groupBy(F.col(column).alias("v")).count()
    upto = F.sum("count").over(Window.orderBy("v"))
    total = counts.agg(F.sum("count").alias("n"))
    placed = counts.withColumn("upto", upto).crossJoin(F.broadcast(total))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p / 100), F.col("v")))
    forced = [(F.sum(F.when(F.col("v") == high, F.col("count")).otherwise(0)) * 100 / F.max("n")).alias("forced_pct")] if high is not None else []
    return placed.agg(F.max("n").alias("n"), (F.sum(F.col("v") * F.col("count")) / F.max("n")).alias("mean"), at(1).alias("p1"), at(50).alias("p50"), at(99).alias("p99"), F.max("v").alias("most"), *forced)


def boundary_preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """The share of distinct fingerprints that an edit kept."""
    a, kept = before.select("fp").distinct(), before.select("fp").intersect(after.select("fp"))
    return a.agg(F.count("*").alias("fps")).crossJoin(kept.agg(F.count("*").alias("kept"))).withColumn("share", F.col("kept") / F.col("fps"))


def geometric_mean(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.exp(F.avg(F.ln(column))).alias("geomean"))


def assemble(refs: DataFrame, store: DataFrame) -> DataFrame:
    """Files from their chunks: (path, content, missing). `missing` counts references the store cannot serve."""
    full = refs.select("path", "chunk_no", "fp", "length").join(store.select("fp", "payload"), "fp", "left")
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "payload")))
    bad = F.count_if(F.col("payload").isNull() | (F.octet_length("payload") != F.col("length")))
    # joined as hexadecimal digits: appending bytes one by one would cost the square of the file
    content = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["payload"])), ""))
    return full.groupBy("path").agg(content.alias("content"), bad.alias("missing"))
