"""Problem 6: token ids of a whole corpus by content-defined chunk reuse.

1. A rolling hash over code points cuts every text into chunks at content-defined places, so equal passages give equal
   chunks wherever they stand. One row per chunk (a 128-bit digest) is counted; digests that occur again are *shared*.
2. Each shared chunk is encoded once, at its first place. Of its ids only the *core* is kept, between the first and the
   last position where the pre-tokeniser must break whatever stands around it.
3. A text takes the ids of its shared cores and encodes the rest. A join (tail of one chunk and head of the next) is
   re-encoded over the span between the two nearest such positions, widening over whole chunks until there is one, so the
   result equals the encoding of the whole text. Texts without shared chunks are encoded directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import int_lists, mix64, read_table, string_parts, written
from .tokenizers import TOKENIZER_DIR, byte_bpe

WINDOW, MEAN_CHUNK, MIN_CHUNK = 16, 256, 32


def chunk_ends(cp: np.ndarray, off: np.ndarray, mean: int = MEAN_CHUNK, least: int = MIN_CHUNK) -> list[np.ndarray]:
    """Per text the ends of its chunks: places where the hash of the last 16 code points falls in one of ``mean`` classes, and the end."""
    n = len(cp)
    h = cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < WINDOW and n > width:
        # the hash of 2w code points from those of w: rolling by doubling
        h[width:] = h[width:] + h[:-width] * np.uint64(pow(0x100000001B3, width, 1 << 64))
        width *= 2
    hit = np.flatnonzero((mix64(h) >> np.uint64(40)) % np.uint64(mean) == 0) + 1
    out = []
    bounds = np.searchsorted(hit, off, side="right")
    for i in range(len(off) - 1):
        lo, hi = int(off[i]), int(off[i + 1])
        if hi == lo:
            out.append(np.zeros(0, np.int64))
            continue
        own = hit[bounds[i] : bounds[i + 1]]
        own = own[(own >= lo + WINDOW) & (own < hi)] - lo
        kept, last = [], 0
        for x in own.tolist():
            if x - last >= least:
                kept.append(x)
                last = x
        out.append(np.array([*kept, hi - lo], np.int64))
    return out


def _kind(c: str) -> int:
    if c.isalpha():
        return 1
    if c.isspace():
        return 0
    return 2 if c.isnumeric() else 3


def firm(text: str, i: int) -> bool:
    """Whether the pre-tokeniser breaks between text[i-1] and text[i] whatever stands around.

    True between two visible characters of plainly different kinds (ASCII or CJK ideographs; never next to an apostrophe)
    and before a blank that follows a visible character.
    """
    a, b = text[i - 1], text[i]
    if a == "'" or b == "'":
        return False
    if not (_plain(a) and (_plain(b) or b in " \n")):
        return False
    ka, kb = _kind(a), _kind(b)
    return ka != kb and ka != 0


def _plain(c: str) -> bool:
    return "!" <= c <= "~" or "一" <= c <= "龥"


def firm_from(text: str, lo: int, hi: int) -> int:
    for i in range(max(1, lo), hi):
        if firm(text, i):
            return i
    return -1


def firm_before(text: str, hi: int, lo: int) -> int:
    for i in range(min(hi, len(text) - 1), lo, -1):
        if firm(text, i):
            return i
    return -1


def core_of(chunk: str) -> tuple[int, int]:
    """First and last firm break inside a chunk; (-1, -1) where there are not two."""
    a = firm_from(chunk, 1, len(chunk))
    b = firm_before(chunk, len(chunk) - 1, 0)
    return (a, b) if 0 < a < b else (-1, -1)


def digest(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode("utf-8", "replace"))


def encode_with(text: str, ends: np.ndarray, known: dict[int, tuple[int, int, np.ndarray]], encode) -> np.ndarray:
    """Ids of a text from the cores known for some of its chunks, everything between re-encoded."""
    parts, at, lo = [], 0, 0
    for k, hi in enumerate(ends.tolist()):
        core = known.get(k)
        if core is not None and core[0] > 0:
            a, b, ids = core
            if lo + a > at:
                parts.append(encode(text[at : lo + a]))
            parts.append(ids)
            at = lo + b
        lo = hi
    if at < len(text):
        parts.append(encode(text[at:]))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _texts(batch: pa.RecordBatch, column: int) -> tuple[list[str], list[np.ndarray]]:
    col = batch.column(column)
    cp, off = string_parts(col)
    return [t or "" for t in col.to_pylist()], chunk_ends(cp, off)


def encode_corpus(df: DataFrame, key: str, text: str, *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids) of every row; null and empty texts give an empty list. ``key`` must be unique and is a long."""
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ends = _texts(batch, 1)
            keys = batch.column(0).to_pylist()
            ks, nos, hs = [], [], []
            for k, t, e in zip(keys, texts, ends):
                lo = 0
                for no, hi in enumerate(e.tolist()):
                    ks.append(k)
                    nos.append(no)
                    hs.append(digest(t[lo:hi]))
                    lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(nos, pa.int32()), pa.array(hs, pa.binary())], names=["k", "no", "h"])

    places = written(docs.where(F.length("t") > 0).mapInArrow(chunks, "k long, no int, h binary"), "p6-chunks")
    shared = places.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("k", "no")).alias("at")).where("n > 1")
    first = shared.groupBy(F.col("at.k").alias("k")).agg(F.sort_array(F.collect_list(F.struct(F.col("at.no").alias("no"), "h"))).alias("todo"))

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer, folder).encode_ordinary
        for batch in batches:
            texts, ends = _texts(batch, 0)
            hs, aa, bb, ids = [], [], [], []
            for t, e, todo in zip(texts, ends, batch.column(1).to_pylist()):
                starts = np.concatenate([[0], e[:-1]])
                for x in todo:
                    chunk = t[starts[x["no"]] : e[x["no"]]]
                    a, b = core_of(chunk)
                    if a > 0:
                        hs.append(x["h"])
                        aa.append(a)
                        bb.append(b)
                        ids.append(np.array(encode(chunk[a:b]), np.int32))
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(aa, pa.int32()), pa.array(bb, pa.int32()), int_lists(np.concatenate(ids) if ids else np.zeros(0, np.int32), off)], names=["h", "a", "b", "ids"])

    encoded = docs.join(first, "k").select("t", "todo").mapInArrow(cores, "h binary, a int, b int, ids array<int>")
    known = places.join(encoded, "h").groupBy("k").agg(F.collect_list(F.struct("no", "a", "b", "ids")).alias("known"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer, folder).encode_ordinary
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                texts, cores_of = part.column(1).to_pylist(), part.column(2)
                some = [j for j in range(len(part)) if cores_of[j].is_valid]
                ends = dict(zip(some, chunk_ends(*string_parts(part.column(1).take(pa.array(some, pa.int64())))))) if some else {}
                out = []
                for j, t in enumerate(texts):
                    if not t:
                        out.append(np.zeros(0, np.int32))
                    elif j in ends:
                        got = {x["no"].as_py(): (x["a"].as_py(), x["b"].as_py(), x["ids"].values.to_numpy()) for x in cores_of[j]}
                        out.append(encode_with(t, ends[j], got, encode))
                    else:
                        out.append(np.array(encode(t), np.int32))
                off = np.concatenate([[0], np.cumsum([len(x) for x in out])])
                yield pa.RecordBatch.from_arrays([part.column(0), int_lists(np.concatenate(out) if out else np.zeros(0, np.int32), off)], names=["k", "ids"])

    return docs.join(known, "k", "left").select("k", "t", "known").mapInArrow(whole, "k long, ids array<int>").withColumnRenamed("k", key)


def p6_ids(spark, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k without special tokens."""
    return encode_corpus(read_table(spark, sf_dir, "documents"), "doc_id", "text")
