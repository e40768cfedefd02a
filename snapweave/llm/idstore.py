"""Token ids in binary files: one shared zstandard dictionary, each document a frame of its own.

A store is a folder: `dictionary` (raw zstandard dictionary, may be empty) and `.ids` files. A file is

    magic "IDZ1" | bytes per id (1 byte, 2 or 4) | SHA-256 of the dictionary (32 bytes)
    one zstandard frame per document, compressed on its own with the dictionary
    index: n+1 frame offsets (u64), n doc_ids (i64), n null marks (u8), n id counts (u64)
    place of the index (u64) | n (u64) | magic "IDZ1"

(all little-endian), so one short document is read by two small reads, without its neighbours.

Scale: documents are range-partitioned and sorted by (doc_id, place in the table), so ids or whole rows repeated in a third
of the rows still spread; a task streams its documents into files of about `file_bytes`. Files are
named by task attempt; the manifest of the attempts that succeeded says which files count, so lost or
repeated tasks leave at worst unused files. The dictionary's sample is about `sample` documents.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, bounded_batches, hashed_share, shared_dir, table, tokenizer_file
from .tokens import encoder

MAGIC = b"IDZ1"
HEAD, TAIL = struct.Struct("<4sB32s"), struct.Struct("<QQ4s")
MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long, n_bytes long"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary from serialized id arrays; empty where there is too little to train on."""
    import zstandard

    if len(samples) < 16 or sum(map(len, samples)) < 4 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def codecs(dictionary: bytes, level: int = 3):
    import zstandard

    d = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=level, write_checksum=False, **d), zstandard.ZstdDecompressor(**d)


class Writer:
    """One file: frames as they come, the index at the end."""

    def __init__(self, store, path: str, width: int, digest: bytes, press):
        self.path, self.kind, self.press, self.out = path, np.dtype(f"<u{width}"), press, store.open_output_stream(path)
        self.at, self.tokens, self.offsets, self.docs, self.nulls, self.counts = HEAD.size, 0, [HEAD.size], [], [], []
        self.out.write(HEAD.pack(MAGIC, width, digest))

    def add(self, doc: int | None, ids: bytes) -> None:
        frame = self.press.compress(np.frombuffer(ids, "<u4").astype(self.kind).tobytes())
        self.out.write(frame)
        self.at += len(frame)
        self.offsets.append(self.at)
        self.docs.append(doc or 0)
        self.nulls.append(doc is None)
        self.counts.append(len(ids) // 4)
        self.tokens += len(ids) // 4

    def close(self) -> tuple[int, int, int]:
        for values, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.nulls, "u1"), (self.counts, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(TAIL.pack(self.at, len(self.docs), MAGIC))
        self.out.close()
        return len(self.docs), self.tokens, self.at


class Reader:
    """Random access to one file's documents."""

    def __init__(self, store, path: str, dictionary: bytes):
        self.f = store.open_input_file(path)
        size = self.f.size()
        magic, self.width, digest = HEAD.unpack(self.f.read_at(HEAD.size, 0))
        at, n, end = TAIL.unpack(self.f.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} is not an id file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        index, self.n = self.f.read_at(size - TAIL.size - at, at), n
        self.offsets = np.frombuffer(index, "<u8", n + 1)
        self.docs = np.frombuffer(index, "<i8", n, 8 * (n + 1))
        self.nulls = np.frombuffer(index, "u1", n, 8 * (n + 1) + 8 * n)
        self.counts = np.frombuffer(index, "<u8", n, 8 * (n + 1) + 9 * n)
        self.unpress = codecs(dictionary)[1]

    def document(self, k: int) -> tuple[int | None, np.ndarray]:
        """(doc_id, ids) of the k-th document of the file."""
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        ids = np.frombuffer(self.unpress.decompress(self.f.read_at(b - a, a)), f"<u{self.width}")
        if len(ids) != self.counts[k]:
            raise ValueError("a frame does not hold as many ids as its index says")
        return None if self.nulls[k] else int(self.docs[k]), ids

    def find(self, doc: int) -> list[np.ndarray]:
        """The ids of every document with this id (none, one, or the repeats); ids ascend within a file, nulls first."""
        skip = int(self.nulls.sum())
        a, b = (skip + int(np.searchsorted(self.docs[skip:], doc, side)) for side in ("left", "right"))
        return [self.document(k)[1] for k in range(a, b)]


def read_dictionary(folder: str) -> bytes:
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/dictionary") as f:
        return f.read()


def write_ids(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, sample: int = 500, sample_bytes: int = 32 << 10, dictionary_bytes: int = 64 << 10, file_bytes: int = 64 << 20) -> DataFrame:
    """Encode `docs` (`doc_id`, `text`), each followed by `end_id`, into a new store; returns its manifest.

    Documents ascend by doc_id over the files in order of (part, seq), nulls first; rows with one id are
    in the table's order. A null or empty text holds the end id alone. Without documents there are
    no files. The dictionary is trained on about `sample` documents of up to `sample_bytes` bytes, chosen by a
    hash of the row; nothing else depends on the sample.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    picked = hashed_share(docs, sample, "doc_id", "text", only=F.octet_length("text") <= sample_bytes).collect()
    enc = encoder(tokenizer_file(tokenizer))
    width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    dictionary = train([np.frombuffer(enc.encode(r.text), "<u4").astype(f"<u{width}").tobytes() for r in picked], dictionary_bytes)
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/dictionary") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches):
        store, path = _store(folder)
        task, press = TaskContext.get(), codecs(shared.value)[0]
        digest, end, own = hashlib.sha256(shared.value).digest(), np.array([end_id], "<u4").tobytes(), encoder(tokenizer_file(tokenizer))
        made, out = [], None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out and out.at >= file_bytes:
                    made.append((out.path, *out.close()))
                    out = None
                out = out or Writer(store, f"{path}/{task.partitionId():06d}-{len(made):05d}-{task.taskAttemptId()}.ids", width, digest, press)
                out.add(doc, own.encode(text) + end)
        if out:
            made.append((out.path, *out.close()))
        rows = [(task.partitionId(), k, f.rpartition("/")[2], *counts) for k, (f, *counts) in enumerate(made)]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    # with the row's number, rows that agree in id, or in everything, are dealt out too; bounds come from a scan of ids alone
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    return Shelf(spark).put(ranged.mapInArrow(write, MANIFEST), "manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of a store, from its files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    dictionary = spark.sparkContext.broadcast(read_dictionary(folder))
    before = (F.sum("n_tokens").over(Window.orderBy("part", "seq")) - F.col("n_tokens")).alias("before")
    files = manifest.select("file", before)  # a few numbers per file of `file_bytes`
    n = max(1, manifest.count())

    def read(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = _store(folder)
                src = Reader(store, f"{path}/{file}", dictionary.value)
                for low in range(0, src.n, 1000):
                    rows = []
                    for k in range(low, min(src.n, low + 1000)):
                        doc, ids = src.document(k)
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartitionByRange(n, "before", "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_id_files(spark, sf_dir: str) -> DataFrame:
    """All documents written as id files and read back."""
    folder = shared_dir(spark)
    return read_ids(write_ids(table(spark, sf_dir, "documents"), folder), folder)
