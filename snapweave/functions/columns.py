"""Column functions that Catalyst evaluates itself: predicates, hashes, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_PATH

BAD_PATH = r"(?s)^/|/$|//|(^|/)[.]{1,2}(/|$)|[\x00-\x1f\\]"
DATASET = r"\A[A-Za-z0-9_-][A-Za-z0-9._-]{0,127}\z"
SESSION = r"\A[a-f0-9-]{1,64}\z"


def valid_path(path: Column) -> Column:
    """A relative path that stays below its root and has no control characters or backslashes."""
    return F.octet_length(path).between(1, MAX_PATH) & ~path.rlike(BAD_PATH)


def valid_dataset(name: Column) -> Column:
    return name.rlike(DATASET)


def valid_session(name: Column) -> Column:
    return name.rlike(SESSION)


def fingerprint(data: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """32 bytes from exactly 64 hexadecimal digits, else null."""
    return F.when(text.rlike(r"\A[0-9a-fA-F]{64}\z"), F.unhex(text))


def varint_size(value: Column) -> Column:
    """Bytes of a little-endian base-128 number (of a non-negative long)."""
    size = F.lit(1)
    for n in range(1, 9):
        size = size + (value >= F.lit(1 << (7 * n))).cast("int")
    return size


def varint(value: Column) -> Column:
    """A non-negative long in little-endian base 128, the high bit set on all bytes but the last."""
    value = value.cast("long")
    digits = [F.shiftrightunsigned(value, 7 * n).bitwiseAND(F.lit(127)) for n in range(9)]
    more = [F.when(value >= F.lit(1 << (7 * (n + 1))), 128).otherwise(0) if n < 8 else F.lit(0) for n in range(9)]
    bytes_ = F.concat(*[F.when(value >= F.lit(1 << (7 * n)) if n else F.lit(True), F.lpad(F.hex(d + m), 2, "0")).otherwise("") for n, (d, m) in enumerate(zip(digits, more, strict=True))])
    return F.when(value >= 0, F.unhex(bytes_))


def shard(fp: Column) -> Column:
    """The first byte of a fingerprint: 256 shards."""
    return F.conv(F.substring(F.hex(fp), 1, 2), 16, 10).cast("smallint")


def lz_bound(n: Column) -> Column:
    """The most bytes that compressing n bytes can take."""
    return n + F.floor(n / 255).cast("long") + 16


def le64(value: Column) -> Column:
    """A long as eight bytes, the lowest first."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def session_id(dataset: Column, generation: Column, digest: Column) -> Column:
    """32 hexadecimal digits that name a job by what it publishes."""
    return F.substring(F.sha2(F.concat(F.encode(dataset, "UTF-8"), le64(generation), digest), 256), 1, 32)


def manifest_file(generation: Column) -> Column:
    return F.format_string("g%010d.man", generation)


def container_file(number: Column) -> Column:
    return F.format_string("c%08d.dat", number)


def dirname(path: Column) -> Column:
    """What stands before the last slash; a dot for a bare name."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"(?s)/[^/]*\z", "")).otherwise(".")


def reduction_pct(wire: Column, logical: Column) -> Column:
    """Per cent of the logical bytes that did not have to be sent; null without bytes."""
    return F.when(logical > 0, 100 - 100 * wire / logical)


def smaller(raw: Column, packed: Column) -> Column:
    """The packed bytes if they are fewer, else the raw ones: struct(payload, compressed)."""
    use = packed.isNotNull() & (F.octet_length(packed) > 0) & (F.octet_length(packed) < F.octet_length(raw))
    return F.struct(F.when(use, packed).otherwise(raw).alias("payload"), use.alias("compressed"))


def clamped(value: Column, low: float, high: float) -> Column:
    """A parameter held within its bounds; not-a-number counts as the lower one."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.nanvl(value.cast("double"), F.lit(low))))


def round_trip_cost(round_trips: Column, rtt_ms: Column, n_bytes: Column, mbit: Column) -> Column:
    """Seconds a link needs: its round trips, and its bytes at its bandwidth (none if zero)."""
    return round_trips * rtt_ms / 1000 + F.when(mbit > 0, n_bytes * 8 / (mbit * 1e6)).otherwise(0.0)
