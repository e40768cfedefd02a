"""Synthetic trees in generations, for campaigns: every file of every generation is made by itself, from hashes of its number.

A file is prose, a table of fixed records, or noise (45, 35 and 20 %). Generation 0 has `files` of them; from one generation to the
next about 3 % are edited in place, lengthened or halved, 1 % are new and 1 % go. Which, and how, is drawn from (seed, file, generation), so
tasks need to know nothing of each other and any generation can be made without those before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = (("docs", ".txt", 0.45), ("db", ".rec", 0.35), ("blobs", ".bin", 0.20))
EDITED, NEW, GONE = 0.03, 0.01, 0.01
LEAST, SPREAD = 2_000, 120_000
WORDS = "snapshot of a tree is kept in small parts and each part has its own name so that what stays need not travel again".split()
FILES = "path string, mode int, size long, mtime_ns long, content binary"


def draws(seed: int, *key: int, n: int = 1) -> np.ndarray:
    """n numbers of 64 bits from a counter that the key begins."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed)
        for k in key:
            x = _mixed(np.array([x + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)]))[0]
        return _mixed(x + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _unit(seed: int, *key: int) -> float:
    return int(draws(seed, *key)[0] >> np.uint64(11)) / (1 << 53)


def _below(most: int, seed: int, *key: int) -> int:
    return int(draws(seed, *key)[0]) % most


def content(kind: int, size: int, seed: int, *key: int) -> bytes:
    """Bytes of a kind: words and line breaks, records of 64 bytes with a few fields that vary, or noise."""
    if kind == 0:
        picks = draws(seed, *key, 1, n=size // 2 + 1)
        ends = (picks >> np.uint64(32)) % np.uint64(9) == 0
        return "".join(WORDS[p] + ("\n" if e else " ") for p, e in zip((picks % np.uint64(len(WORDS))).tolist(), ends.tolist(), strict=True)).encode()[:size]
    noise = draws(seed, *key, 2, n=size // 8 + 8).view(np.uint8)
    if kind == 2:
        return noise[:size].tobytes()
    rows = np.zeros((size // 64 + 1, 64), np.uint8)
    rows[:, :4] = np.frombuffer(b"row:", np.uint8)
    fields = draws(seed, *key, 3, n=2 * len(rows)).view(np.uint8).reshape(len(rows), 16)
    rows[:, 8:16], rows[:, 32:40] = fields[:, :8], 48 + fields[:, 8:] % 10
    return rows.tobytes()[:size]


def born(files: int, generation: int) -> int:
    """How many numbers there are up to a generation."""
    return files + generation * max(1, round(files * NEW))


def file_at(number: int, generation: int, files: int, seed: int) -> tuple[str, bytes, int] | None:
    """(path, content, generation of its last change) of a file; None before it is made and after it went."""
    first = 0 if number < files else 1 + (number - files) // max(1, round(files * NEW))
    if first > generation or any(_unit(seed, number, g, 4) < GONE for g in range(first + 1, generation + 1)):
        return None
    draw = _unit(seed, number, 5)
    kind = 0 if draw < KINDS[0][2] else 1 if draw < KINDS[0][2] + KINDS[1][2] else 2
    data, changed = content(kind, LEAST + _below(SPREAD, seed, number, 6), seed, number, 0), first
    for g in range(first + 1, generation + 1):
        if _unit(seed, number, g, 7) >= EDITED:
            continue
        how, changed = _below(3, seed, number, g, 8), g
        if how == 0:
            at = _below(len(data), seed, number, g, 9)
            patch = content(kind, min(len(data) - at, 1 + _below(2_000, seed, number, g, 10)), seed, number, g)
            data = data[:at] + patch + data[at + len(patch) :]
        elif how == 1:
            data += content(kind, 1 + _below(20_000, seed, number, g, 11), seed, number, g)
        else:
            data = data[: len(data) // 2 + 1]
    folder, ending, _ = KINDS[kind]
    return f"{folder}/part{number % 16:02d}/f{number:08d}{ending}", data, changed


def corpus(spark: SparkSession, generation: int = 0, files: int = 300, seed: int = 1) -> DataFrame:
    """The files of a generation: path, mode, size, mtime_ns (which tells the generation of the last change), content."""

    def make(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                if found := file_at(number, generation, files, seed):
                    path, data, changed = found
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([420], pa.int32()), pa.array([len(data)], pa.int64()), pa.array([changed * 1_000_000_000], pa.int64()), pa.array([data], pa.binary())], names=[x.split()[0] for x in FILES.split(", ")])

    return spark.range(born(files, generation)).select(F.col("id")).mapInArrow(make, FILES)
