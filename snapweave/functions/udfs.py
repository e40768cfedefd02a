"""The binary formats as column functions: Arrow batches through pandas, within a batch value by value.

What Catalyst can say is in `columns` (`varint`). Decoders return the error's code (or `ok`) beside their value, so one bad row fails no job.
"""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from ..schema import EngineError
from .codecs import Frame, crc32c_many, decode_frame, decode_manifest, decode_need, encode_frame, encode_need, get_varint, lz_compress, lz_decompress, put_varint


def column(kind: str):
    """A pandas UDF made when first called, since types are parsed by a session."""

    def wrap(f):
        def call(*cols):
            return F.pandas_udf(f, kind)(*cols)

        call.__doc__, call.__name__ = f.__doc__, f.__name__
        return call

    return wrap


@column("long")
def crc32c_col(data: pd.Series) -> pd.Series:
    some = data.notna()
    out = pd.Series(pd.NA, index=data.index, dtype="Int64")
    out[some] = crc32c_many(data[some].tolist())
    return out


@column("binary")
def varint_col(value: pd.Series) -> pd.Series:
    return value.map(lambda x: None if pd.isna(x) else put_varint(int(x)))


def _coded(f, data, empty):
    """f's result as a tuple behind the code `ok`, or the code of its error."""
    if data is None:
        return ("invalid-argument", *empty)
    try:
        return ("ok", *f(data))
    except EngineError as e:
        return (e.code, *empty)


@column("code string, value decimal(20,0), consumed int")
def decode_varint_col(data: pd.Series) -> pd.DataFrame:
    rows = [_coded(lambda x: (lambda v: (Decimal(v[0]), v[1]))(get_varint(x)), x, (None, None)) for x in data]
    return pd.DataFrame(rows, columns=["code", "value", "consumed"]).astype({"consumed": "Int32"})


@column("binary")
def lz_compress_col(data: pd.Series) -> pd.Series:
    """Empty where compression would not make the bytes fewer."""
    return data.map(lambda x: None if x is None else lz_compress(x))


@column("code string, data binary")
def lz_decompress_col(block: pd.Series, most: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_coded(lambda x, m=m: (lz_decompress(x, int(m)),), b, (None,)) for b, m in zip(block, most, strict=True)], columns=["code", "data"])


@column("binary")
def encode_frame_col(kind: pd.Series, flags: pd.Series, seq: pd.Series, raw_len: pd.Series, payload: pd.Series) -> pd.Series:
    return pd.Series([encode_frame(Frame(int(k), p, int(f), int(s), int(r))) for k, f, s, r, p in zip(kind, flags, seq, raw_len, payload, strict=True)])


@column("code string, type int, flags int, seq long, raw_len int, payload binary")
def decode_frame_col(data: pd.Series) -> pd.DataFrame:
    def one(x):
        f, end = decode_frame(x)
        if end != len(x):
            raise EngineError("malformed", "bytes after the frame")
        return f.type, f.flags, f.seq, f.raw_len, f.payload

    rows = [_coded(one, x, (None,) * 5) for x in data]
    return pd.DataFrame(rows, columns=["code", "type", "flags", "seq", "raw_len", "payload"]).astype({"type": "Int32", "flags": "Int32", "seq": "Int64", "raw_len": "Int32"})


@column("code string, runs array<struct<start:decimal(20,0),last:decimal(20,0)>>")
def decode_need_col(data: pd.Series) -> pd.DataFrame:
    rows = [_coded(lambda x: ([{"start": Decimal(a), "last": Decimal(b)} for a, b in decode_need(x)],), x, (None,)) for x in data]
    return pd.DataFrame(rows, columns=["code", "runs"])


@column("binary")
def encode_need_col(starts: pd.Series, lasts: pd.Series) -> pd.Series:
    """Sorted arrays of run starts and ends to their encoding."""
    return pd.Series([encode_need(list(zip(map(int, a), map(int, b), strict=True))) for a, b in zip(starts, lasts, strict=True)])


MANIFEST_FILES = "array<struct<path:string,mode:int,size:bigint,mtime_ns:bigint,digest:binary,chunks:array<struct<fp:binary,length:int>>>>"


@column(f"code string, generation long, dataset string, files {MANIFEST_FILES}")
def decode_manifest_col(data: pd.Series) -> pd.DataFrame:
    def one(x):
        m = decode_manifest(x)
        return m.generation, m.dataset, [{"path": f.path, "mode": f.mode, "size": f.size, "mtime_ns": f.mtime_ns, "digest": f.digest, "chunks": [{"fp": a, "length": n} for a, n in f.chunks]} for f in m.files]

    return pd.DataFrame([_coded(one, x, (None, None, None)) for x in data], columns=["code", "generation", "dataset", "files"]).astype({"generation": "Int64"})
