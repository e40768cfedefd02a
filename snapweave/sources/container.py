"""Append-only containers and commit journals as data sources, with what is damaged in them.

A container is a row of records. Where one is unsound the reader looks for the next sound one: if there is none, the
file's tail was torn off while it was written; else the bytes between are damage.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.codecs import RECORD_MAGIC, decode_commits, decode_record
from ..schema import EngineError

MAGIC = RECORD_MAGIC.to_bytes(4, "little")


def parse_container(data: bytes):
    """("record", offset, length, fp, payload), ("damage", offset, length, ..) and ("torn", offset, length, ..) rows."""
    at = 0
    while at < len(data):
        found = decode_record(data, at)
        if found:
            fp, payload = found
            yield "record", at, 48 + len(payload), fp, payload
            at += 48 + len(payload)
            continue
        nxt = data.find(MAGIC, at + 1)
        while nxt >= 0 and not decode_record(data, nxt):
            nxt = data.find(MAGIC, nxt + 1)
        yield ("torn", at, len(data) - at, None, None) if nxt < 0 else ("damage", at, nxt - at, None, None)
        if nxt < 0:
            return
        at = nxt


def read_whole(path: str, most: int = 1 << 30) -> bytes:
    """A file of at most `most` bytes; a larger one is refused before it is read."""
    with open(path, "rb") as f:
        if os.fstat(f.fileno()).st_size > most:
            raise EngineError("too-large", path)
        return f.read()


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options, pattern: str, rows):
        self.root, self.pattern, self.rows = options["path"], pattern, rows
        self.most = int(options.get("maxbytes", 1 << 30))  # a container is closed at 128 MiB

    def partitions(self):
        found = [self.root] if os.path.isfile(self.root) else sorted(glob.glob(os.path.join(self.root, self.pattern)))
        return [File(p) for p in found] or [File("")]

    def read(self, partition: File):
        if not partition.path:
            return
        for row in self.rows(read_whole(partition.path, self.most)):
            yield (os.path.basename(partition.path), *row)


def _journal_rows(data: bytes):
    found, sound = decode_commits(data)
    for dataset, generation, digest in found:
        yield dataset, generation, digest, sound


class ChunkContainers(DataSource):
    """format("chunk_container"): a row per record, damaged range or torn tail; one partition per container."""

    @classmethod
    def name(cls):
        return "chunk_container"

    def schema(self):
        return "container string, kind string, offset long, length long, fp binary, payload binary"

    def reader(self, schema):
        return _Reader(self.options, "c*.dat", parse_container)


class CommitJournal(DataSource):
    """format("commit_journal"): a row per commit record up to the first unsound one, and how many bytes are sound."""

    @classmethod
    def name(cls):
        return "commit_journal"

    def schema(self):
        return "journal string, dataset string, generation long, digest binary, sound_bytes long"

    def reader(self, schema):
        return _Reader(self.options, "GENERATIONS", _journal_rows)
