"""What the operators of this subpackage share: word splitting, shared storage, bounded batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: Bytes to words for `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: letters and digits
#: stay, every other ASCII byte becomes a blank, bytes of non-ASCII characters stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: The same as a Java regex, for texts that are lower-cased already.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of text that one Arrow batch may hold on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


def ascii_lower(col):
    """A-Z to a-z and nothing else (`lower` would change other alphabets too)."""
    return F.translate(col, UPPER, LOWER)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows and bytes, so long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Return what a worker has freed to the system: workers live on, and the next job's would come on top."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Shelf:
    """Intermediate tables in the shared folder: they cut lineage, and outlive any executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.dir = spark, shared_dir(spark)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.dir}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self) -> None:
        """Let the driver drop shuffles that nothing refers to any more, so phases don't pile up on the disks."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Free tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(docs: DataFrame, *names: str) -> DataFrame:
    """`docs` without the columns that an operator adds under these names, in any case, and without reserved ones (`__w_`)."""
    taken = {n.lower() for n in names}
    return docs.drop(*[c for c in docs.columns if c.lower() in taken or c.lower().startswith("__w_")])


def row_key(*cols) -> F.col:
    """A 64-bit key of a row's content: rows that agree in all of `cols` are one document."""
    return F.xxhash64(*cols)


def hashed_share(rows: DataFrame, sample: int, *cols: str, only: Column | None = None) -> DataFrame:
    """Between `sample` and twice as many of the rows, about (all, if fewer): those whose hash of `cols` falls into a share, and of them
    those that `only` holds for.

    Of rows that agree in `cols` one is taken, so however often one repeats there are no more of them; where rows
    repeat, there may be fewer than `sample`. Unlike an ordered limit, tasks send no more than what is kept.
    """
    some = rows.where(F.pmod(F.xxhash64(*cols), F.lit(max(1, rows.count() // sample))) == 0)
    return (some if only is None else some.where(only)).dropDuplicates([*cols])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Stafford's variant 13): every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: What a byte counts for in a word's hash: A-Z as a-z, else each its own 64-bit number; and the bytes that part words.
_BYTE = mix64(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE, _PIECE = 0xD6E8FEB86659FD93, 1 << 16
_ODD64 = 1 << 64


def _byte_powers(known: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first _PIECE powers of the base and of its inverse, modulo 2^64."""
    if not known:
        known["of"] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(_PIECE - 1, np.uint64(b))]) for b in (_BASE, pow(_BASE, -1, _ODD64)))
    return known["of"]


@dataclass(frozen=True)
class Hashed:
    """Words of some texts, one text after the other: their 64-bit hashes, words of each text, first word and words of each line that has any."""

    hashes: np.ndarray
    counts: np.ndarray
    line_starts: np.ndarray
    line_counts: np.ndarray


def hashed_words(texts: list[bytes | None]) -> Hashed:
    """Words are runs of anything but the ASCII blanks \\x20 and \\x09-\\x0D, A-Z lower-cased; lines end at \\n; null has no words.

    A word's hash comes from sums over its bytes, each times a power of the base, so that no word is made an object; a text of any
    length is read piece by piece.
    """
    data = np.frombuffer(b"\n".join([t or b"" for t in texts] + [b""]), np.uint8)
    power, inverse = _byte_powers()
    found: list[list] = [[], [], [], [], []]
    total, base, back, blank_before = np.uint64(0), 1, 1, True
    with np.errstate(over="ignore"):
        for at in range(0, len(data), _PIECE):
            own = data[at : at + _PIECE]
            blank = _BLANK.take(own)
            edge = np.flatnonzero(blank != np.r_[blank_before, blank[:-1]])
            terms = _BYTE.take(own) * power[: len(own)]
            upto = np.cumsum(terms)
            before = total + np.uint64(base) * (upto[edge] - terms[edge])
            opens = ~blank[edge]
            first = edge[opens]
            for part, x in zip(found, (first + at, before[opens], np.uint64(back) * inverse[first], edge[~opens] + at, before[~opens]), strict=True):
                part.append(x)
            total, blank_before = total + np.uint64(base) * upto[-1], bool(blank[-1])
            base, back = base * pow(_BASE, len(own), _ODD64) % _ODD64, back * pow(_BASE, -len(own), _ODD64) % _ODD64
        first, low, unit, last, high = (np.concatenate(x) for x in found) if len(data) else (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64), np.zeros(0, np.uint64))
        hashes = mix64((high - low) * unit ^ mix64((last - first).astype(np.uint64)))
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    upto = np.searchsorted(first, ends)
    starts = np.unique(np.r_[0, np.searchsorted(first, np.flatnonzero(data == 10))])
    starts = starts[starts < len(first)]
    return Hashed(hashes, np.diff(upto, prepend=0), starts, np.diff(np.r_[starts, len(first)]))


def grouped(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes | None]]]:
    """(number of the first, texts) in groups of about `most` bytes, a longer text alone: what is worked on at a time stays small."""
    low, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text or b"") > most:
            yield low, texts[low:k]
            low, size = k, 0
        size += len(text or b"")
    yield low, texts[low:]


def word_edges(text: bytes) -> np.ndarray:
    """Where each word of a text begins and ends, one after the other."""
    blank = _BLANK.take(np.frombuffer(text + b"\n", np.uint8))
    return np.flatnonzero(blank != np.r_[True, blank[:-1]])


def word_counts(texts: list[bytes | None]) -> np.ndarray:
    """How many words each text has."""
    out = []
    for _, some in grouped(texts):
        blank = _BLANK.take(np.frombuffer(b"\n".join([t or b"" for t in some] + [b""]), np.uint8))
        opens = np.flatnonzero(~blank[1:] & blank[:-1]) + 1 if len(blank) else np.zeros(0, np.int64)
        if len(blank) and not blank[0]:
            opens = np.r_[0, opens]
        out.append(np.diff(np.searchsorted(opens, np.cumsum([len(t or b"") + 1 for t in some])), prepend=0))
    return np.concatenate(out).astype(np.int64)


def pieces_of(batch, columns: Iterable[str]) -> Iterator[tuple]:
    """Rows of an Arrow batch as Python tuples."""
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


