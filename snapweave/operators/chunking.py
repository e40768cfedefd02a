"""Cutting contents into chunks: fixed sizes in SQL, content-defined ones as an Arrow table function.

The content-defined cut rolls h = 2h + gear[byte] from `low` bytes after the chunk's start and cuts where the bits of a
mask are all zero: a strict mask before the average size, a loose one after it, at the latest at `high`. Because h
forgets a byte after 64 steps, hashes of a whole buffer come from six shifted additions; what remains is to pick
candidates, with the first 63 positions after a chunk's start corrected for the bytes that h has not seen.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fingerprint
from ..schema import AVG_CHUNK, MAX_CHUNK, MIN_CHUNK

#: Bits of the two masks (fixed values).
STRICT, LOOSE = 0x0003_5907_0353_0000, 0x0000_D900_0353_0000
SEED = 0x9E37_79B9_7F4A_7C15
_BLOCK = 1 << 16
CHUNKS = "path string, chunk_no int, offset long, length int, fp binary"


def gear_table() -> np.ndarray:
    """256 numbers of the splitmix64 sequence that starts at SEED."""
    out, x, all64 = [], SEED, (1 << 64) - 1
    for _ in range(256):
        x = (x + SEED) & all64
        z = ((x ^ (x >> 30)) * 0xBF58_476D_1CE4_E5B9) & all64
        z = ((z ^ (z >> 27)) * 0x94D0_49BB_1331_11EB) & all64
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


GEAR = gear_table()


@dataclass(frozen=True)
class Params:
    """Sizes of chunks: least, average, most."""

    low: int = MIN_CHUNK
    avg: int = AVG_CHUNK
    high: int = MAX_CHUNK

    def __post_init__(self):
        if not 0 < self.low <= self.avg <= self.high <= 16 * MAX_CHUNK:
            raise ValueError(f"chunk sizes {self.low}/{self.avg}/{self.high}")


def _hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, over as many as 64 bytes back."""
    f = GEAR[data]
    for w in (1, 2, 4, 8, 16, 32):
        shifted = np.zeros_like(f)
        shifted[w:] = f[:-w] if w < len(f) else 0
        f = f + (shifted << np.uint64(w))
    return f


def cuts(data: bytes, params: Params = Params()) -> list[int]:
    """The ends of the chunks of a whole buffer."""
    buf, n = np.frombuffer(data, np.uint8), len(data)
    if n <= params.low:
        return [n] if n else []
    strict, loose = np.uint64(STRICT), np.uint64(LOOSE)
    parts: tuple[list, list] = ([], [])
    for at in range(0, n, _BLOCK):
        begin = max(0, at - 63)
        h = _hashes(buf[begin : at + _BLOCK])[at - begin :]
        for own, mask in zip(parts, (strict, loose), strict=True):
            own.append(np.flatnonzero((h & mask) == 0) + at)
    strict_place, place = map(np.concatenate, parts)
    ends, start = [], 0
    while start < n:
        if n - start <= params.low:
            ends.append(n)
            break
        first, middle, last = start + params.low, min(start + params.avg, n), min(start + params.high, n)
        settled = first + 63  # from here on the hash has forgotten what lies before `first`
        early = _hashes(buf[first : min(settled, last)])
        edge = min(middle, first + len(early)) - first
        hit = np.flatnonzero((early[:edge] & strict) == 0)
        cut = first + int(hit[0]) + 1 if len(hit) else None
        if cut is None:
            k = np.searchsorted(strict_place, settled)
            if k < len(strict_place) and strict_place[k] < middle:
                cut = int(strict_place[k]) + 1
        if cut is None and len(early) > edge:
            hit = np.flatnonzero((early[edge:] & loose) == 0)
            cut = first + edge + int(hit[0]) + 1 if len(hit) else None
        if cut is None:
            k = np.searchsorted(place, max(middle, settled))
            cut = int(place[k]) + 1 if k < len(place) and place[k] < last else last
        ends.append(cut)
        start = cut
    return ends


def cdc_chunks(files: DataFrame, params: Params = Params()) -> DataFrame:
    """`files` (path, content) as content-defined chunks: path, chunk_no, offset, length, fp. A narrow map.

    A null or empty content has no chunks. Contents are whole values (up to 2 GB); the tree source chunks larger files
    while it reads them.
    """

    def cut(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = 0
                for k, end in enumerate(cuts(content, params) if content else []):
                    rows.append((path, k, start, end - start, hashlib.sha256(content[start:end]).digest()))
                    start = end
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["path", "chunk_no", "offset", "length", "fp"])

    return files.select("path", "content").mapInArrow(cut, CHUNKS)


def fixed_chunks(files: DataFrame, size: int, *keys: str, keep_data: bool = False) -> DataFrame:
    """`files` (path, content, and `keys`) in chunks of `size` bytes, the last shorter; all in codegen."""
    n = F.octet_length("content")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    parts = F.transform(starts, lambda s: F.substring(F.col("content"), s + 1, F.lit(size)))
    rows = files.select(*keys, "path", F.posexplode(parts).alias("chunk_no", "data"))
    out = [*keys, "path", "chunk_no", (F.col("chunk_no").cast("long") * size).alias("offset"), F.octet_length("data").alias("length"), fingerprint(F.col("data")).alias("fp")]
    return rows.select(*out, *["data"] * keep_data)


def slices(total: Column, size: int) -> Column:
    """(start, length, last) of the slices that send `total` bytes; no bytes make one empty slice."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(total - 1, F.lit(0)), F.lit(size).cast("long"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(size).cast("long"), total - s).alias("length"), (s + size >= total).alias("last")))
