"""Data model of the engine: limits, row types, error codes.

A tree is a table of files; a manifest is one generation's full list of files with their chunks; a store
holds every distinct chunk once, under the SHA-256 of its bytes.
"""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: limits and chunk sizes
MIN_CHUNK, AVG_CHUNK, MAX_CHUNK = 2_048, 8_192, 65_536
MAX_PATH, MAX_FILES, MAX_CHUNKS_PER_FILE, MAX_REFS = 4_096, 1 << 22, 1 << 24, 1 << 26
MAX_FRAME, MAX_MANIFEST, MAX_NEED, MAX_BATCH, BATCH_BYTES = 1 << 20, 64 << 20, 16 << 20, 1 << 20, 256 << 10
MAX_NEED_INDICES, REORDER_WINDOW, CHECKPOINT_BYTES, DETAIL_LIMIT = 1 << 24, 65_536, 8 << 20, 32
CONTAINER_BYTES, RECORD_HEAD = 128 << 20, 48
PROTOCOL_VERSION = STORE_VERSION = MANIFEST_VERSION = 1

CHUNK_REF = T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("length", T.IntegerType())])
FILES = "path string, mode int, size long, mtime_ns long, digest binary"
CHUNK_REFS = "path string, chunk_no int, offset long, length int, fp binary"

#: Error codes and their names (fixed values).
ERRORS = (
    "ok", "io", "closed", "reset", "timeout", "short-read", "bad-magic", "bad-header-crc", "bad-payload-crc", "too-large",
    "malformed", "unsupported", "not-found", "exists", "corrupt", "fingerprint-mismatch", "locked", "unsafe-filesystem",
    "protocol", "fault-injected", "cancelled", "invalid-argument",
)


class EngineError(Exception):
    """A failed job: a code of ERRORS and what happened."""

    def __init__(self, code: str, detail: str = ""):
        if code not in ERRORS:
            raise ValueError(code)
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail
