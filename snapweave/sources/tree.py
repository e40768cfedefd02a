"""Directory trees as a data source.

Spark's own binary files drop empty files and names that begin with a dot or underscore, follow links, and know neither
mode bits nor nanoseconds; this source keeps all regular files and none else. The driver lists, tasks read: files are
grouped into partitions by size, and a file of any size is chunked while it is read, in memory of a few blocks.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import valid_path
from ..operators.chunking import Params, cuts
from ..schema import EngineError

FILE_COLUMNS = "path string, mode int, size long, mtime_ns long, content binary"
CHUNK_COLUMNS = "path string, mode int, size long, mtime_ns long, digest binary, chunk_no int, offset long, length int, fp binary, payload binary"
BLOCK = 8 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def listed(root: str) -> tuple[list[tuple[str, int]], int]:
    """(relative path, size) of all regular files below a root, in order, and how many other entries were skipped."""
    found, skipped, todo = [], 0, [root]
    while todo:
        try:
            entries = list(os.scandir(todo.pop()))
        except PermissionError:
            skipped += 1
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                todo.append(e.path)
            elif e.is_file(follow_symlinks=False):
                found.append((os.path.relpath(e.path, root), e.stat(follow_symlinks=False).st_size))
            else:
                skipped += 1
    return sorted(found, key=lambda x: os.fsencode(x[0])), skipped


def grouped(files: list[tuple[str, int]], most: int) -> list[Files]:
    groups, held = [[]], 0
    for path, size in files:
        if groups[-1] and held + size > most:
            groups.append([])
            held = 0
        groups[-1].append(path)
        held += size + 4096
    return [Files(g) for g in groups if g]


def stream_chunks(f, params: Params) -> Iterator[bytes]:
    """The chunks of an open file; the same as cutting it whole."""
    held = b""
    while True:
        block = f.read(BLOCK)
        held += block
        ends = cuts(held, params)
        # with more to come, the last cuts may lie where the buffer ends, not where the file would be cut
        sure = ends if not block else [e for e in ends if e + params.high <= len(held)]
        start = 0
        for end in sure:
            yield held[start:end]
            start = end
        held = held[start:]
        if not block:
            return


class TreeReader(DataSourceReader):
    def __init__(self, options, chunks: bool):
        self.root, self.chunks = options["path"], chunks
        self.most = int(options.get("partitionbytes", 128 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.params = Params(int(options.get("low", Params.low)), int(options.get("avg", Params.avg)), int(options.get("high", Params.high)))

    def partitions(self):
        return grouped(listed(self.root)[0], self.most) or [Files([])]

    def read(self, partition: Files):
        for path in partition.paths:
            full = os.path.join(self.root, path)
            with open(full, "rb") as f:
                s = os.fstat(f.fileno())
                head = (path, stat.S_IMODE(s.st_mode), s.st_size, s.st_mtime_ns)
                if not self.chunks:
                    yield (*head, f.read())
                    continue
                # the digest is known only after the last chunk: a first pass hashes, a second one cuts
                digest = hashlib.file_digest(f, "sha256").digest()
                f.seek(0)
                offset, k = 0, -1
                for k, data in enumerate(stream_chunks(f, self.params)):
                    yield (*head, digest, k, offset, len(data), hashlib.sha256(data).digest(), data if self.payload else None)
                    offset += len(data)
                if k < 0:
                    yield (*head, digest, None, None, None, None, None)


class TreeSource(DataSource):
    """format("tree"): one row per file. Options: path, partitionBytes."""

    chunks = False

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return FILE_COLUMNS

    def reader(self, schema):
        return TreeReader(self.options, self.chunks)


class TreeChunks(TreeSource):
    """format("tree_chunks"): one row per chunk (an empty file has one without a chunk). Options: also low, avg, high, payload."""

    chunks = True

    @classmethod
    def name(cls):
        return "tree_chunks"

    def schema(self):
        return CHUNK_COLUMNS


def register(spark: SparkSession) -> None:
    from .container import ChunkContainers, CommitJournal

    for source in (TreeSource, TreeChunks, ChunkContainers, CommitJournal):
        spark.dataSource.register(source)


def chunk_rows(spark: SparkSession, root: str, params: Params = Params(), payload: bool = True) -> DataFrame:
    """A tree as rows of chunks; see CHUNK_COLUMNS."""
    register(spark)
    return spark.read.format("tree_chunks").options(low=params.low, avg=params.avg, high=params.high, payload=str(payload).lower()).load(root)


def parts_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, refs) of rows of chunks."""
    files = rows.where("chunk_no IS NULL OR chunk_no = 0").select("path", "mode", "size", "mtime_ns", "digest")
    return files, rows.where("chunk_no IS NOT NULL").select("path", "chunk_no", "offset", "length", "fp", "payload")


def scan(spark: SparkSession, root: str, params: Params = Params(), payload: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, refs) of a tree: path, mode, size, mtime_ns, digest; and path, chunk_no, offset, length, fp, payload."""
    return parts_of(chunk_rows(spark, root, params, payload))


def write_files(rows: DataFrame, out: str) -> None:
    """Write files (path, content, mode, and mtime_ns if there) below `out`, a folder all executors share. Each is made under another
    name and renamed into place, so a repeated task does no harm; a path that leaves `out` fails the job."""
    timed = "mtime_ns" in rows.columns
    checked = rows.select(F.when(valid_path(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("malformed path: "), "path"))).alias("path"), "mode", "content", *["mtime_ns"] * timed)

    def write(part):
        for r in part:
            target = os.path.join(out, r.path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            tmp = f"{target}.{os.getpid()}.tmp"
            with open(tmp, "wb") as f:
                f.write(r.content)
                f.flush()
                os.fsync(f.fileno())
            os.chmod(tmp, r.mode)
            if timed:
                os.utime(tmp, ns=(r.mtime_ns, r.mtime_ns))
            os.replace(tmp, target)

    checked.foreachPartition(write)


def write_in_order(rows, out: str) -> None:
    """Rows (path, chunk_no, payload, mode, size, digest) in order, each file's head (chunk_no -1, with its mode, size and digest) before its
    chunks: files below `out`, made under another name and renamed into place when size and digest are right."""
    from itertools import groupby

    for path, own in groupby(rows, key=lambda r: r.path):
        head, target, size, seen = next(own), os.path.join(out, path), 0, hashlib.sha256()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        tmp = f"{target}.{os.getpid()}.tmp"
        with open(tmp, "wb") as f:
            for r in own:
                f.write(r.payload)
                seen.update(r.payload)
                size += len(r.payload)
            f.flush()
            os.fsync(f.fileno())
        if size != head.size or seen.digest() != bytes(head.digest):
            os.remove(tmp)
            raise EngineError("corrupt", path)
        os.chmod(tmp, head.mode)
        os.replace(tmp, target)


def scan_stats(files: DataFrame, refs: DataFrame, root: str | None = None) -> DataFrame:
    """One row: files, logical_bytes, chunk_refs, and how many entries of `root` were skipped (links, devices, unreadable folders)."""
    a = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"))
    b = a.crossJoin(refs.agg(F.count("*").alias("chunk_refs")))  # one row each
    return b.withColumn("skipped", F.lit(listed(root)[1] if root else None).cast("long"))
