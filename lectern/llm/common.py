"""Shared pieces of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import written  # noqa: F401  (used by the operators)

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FITTED: dict[tuple, object] = {}


def once_fitted(name: str, tables: list[DataFrame], fit):
    """A model fitted once a session to the same files, so that the queries that use it share it."""
    key = (name, tables[0].sparkSession.sparkContext.applicationId, *(f for t in tables for f in sorted(t.inputFiles())))
    if key not in _FITTED:
        for old in [k for k in _FITTED if k[:2] == key[:2]]:  # one model of a kind is kept
            del _FITTED[old]
        _FITTED[key] = fit()
    return _FITTED[key]


def string_parts(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings end to end (uint32) and the n+1 offsets; a null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    import pyarrow.compute as pc

    lens = pc.fill_null(pc.utf8_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = arr.buffers()[2]
    raw = b"" if data is None else data.slice(int(off[0]), int(off[-1] - off[0])).to_pybytes()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
        off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
        data = arr.buffers()[2]
        raw = b"" if data is None else data.slice(int(off[0]), int(off[-1] - off[0])).to_pybytes()
    cps = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    return cps, np.concatenate([[0], np.cumsum(lens)])


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def int_lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


_TABLES: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """For every code point its lower-case form, or 0 unless that is a Unicode letter or number; built once per process."""
    if "t" not in _TABLES:
        import unicodedata

        out = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if unicodedata.category(c)[0] in "LN":
                out[i] = ord(c.lower()[0])
        out[0x130] = ord("i")
        _TABLES["t"] = out
    return _TABLES["t"]


def joined_letters(*columns: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per row the columns' texts joined, lower-cased and with letters and numbers only: code points and offsets; null as empty."""
    table = letter_table()
    if len(columns) > 1:
        import pyarrow.compute as pc

        filled = [pc.fill_null(c, "") for c in columns]
        col = pc.binary_join_element_wise(*filled, "\n")
    else:
        col = columns[0]
    cp, off = string_parts(col)
    low = table[np.minimum(cp, 0x10FFFF)]
    kept = np.concatenate([[0], np.cumsum(low > 0)])
    return low[low > 0], kept[off]


def text_hashes(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every text, as int64."""
    if len(off) < 2:
        return np.zeros(0, np.int64)
    pos = np.arange(len(cp), dtype=np.uint64) - np.repeat(off[:-1], np.diff(off)).astype(np.uint64)
    x = mix64((cp.astype(np.uint64) << np.uint64(32)) ^ (pos * np.uint64(0x9E3779B97F4A7C15)))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return mix64((run[off[1:]] - run[off[:-1]]) ^ (np.diff(off).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))).view(np.int64)


def strings(cp: np.ndarray, off: np.ndarray) -> pa.Array:
    """The texts as an Arrow string column."""
    width = np.where(cp < 0x80, 1, np.where(cp < 0x800, 2, np.where(cp < 0x10000, 3, 4)))
    at = np.concatenate([[0], np.cumsum(width)])[off]
    data = cp.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data)).cast(pa.string())


def slices(batch: pa.RecordBatch, rows: int = 4096):
    for i in range(0, len(batch), rows):
        yield batch.slice(i, rows)


def given_back() -> None:
    """Gives freed memory back to the system, since a worker is kept while others work beside it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def pack_cells(x: np.ndarray) -> bytes:
    import zlib

    return zlib.compress(x.tobytes(), 1)


def unpack_cells(x: bytes, kind) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(x), kind)
