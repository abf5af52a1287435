"""Problem 5: pieces under a size limit, cut at natural boundaries, by pointer doubling.

Every position of a text is joined to its farthest legal successor (the end of the piece that would follow a cut there,
overlap included); squaring that successor table doubles the jump, so the cuts of all texts of a batch come out in
log2(pieces) array steps instead of a scan. The kernel works on whole texts, many at a time, inside ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, string_parts

LIMIT, OVERLAP = 2000, 200
#: Characters worked on at once in one task, and the fewest texts a step takes.
CHUNK_CHARS = 400_000

_WIDE_STOPS, _ASCII_STOPS = "。！？…；", ".!?;"
_WIDE_PAUSES, _ASCII_PAUSES = "，、：", ",:"
_CLOSERS = "”’」』》）)]】\"'"


def _codes(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], np.uint32)


def _white(cp: np.ndarray) -> np.ndarray:
    return (cp == 32) | ((cp >= 9) & (cp <= 13)) | (cp == 0x3000) | (cp == 0xA0) | ((cp >= 0x2000) & (cp <= 0x200A)) | (cp == 0x2028) | (cp == 0x2029) | (cp == 0x85)


def boundary_levels(cp: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For every position the strength of the pause just before it: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 blank, 0 none, -1 inside a cluster.

    ``start`` marks the first position of each text; marks, joiners, variation selectors and the inside of CR LF give -1.
    """
    n = len(cp)
    level = np.zeros(n, np.int8)
    if n < 2:
        return level
    prev, here = cp[:-1], cp[1:]
    white = _white(cp)
    wp, wh = white[:-1], white[1:]
    newline = ((prev == 10) | ((prev == 13) & (here != 10)) | (prev == 0x2028) | (prev == 0x2029)) & ~((here == 10) | (here == 13))
    closed = np.isin(cp, _codes(_CLOSERS))
    stop = np.isin(cp, _codes(_WIDE_STOPS))
    ascii_stop = np.isin(cp, _codes(_ASCII_STOPS))
    pause = np.isin(cp, _codes(_WIDE_PAUSES))
    ascii_pause = np.isin(cp, _codes(_ASCII_PAUSES))
    after_stop = stop | ascii_stop
    after_stop[1:] |= closed[1:] & (stop | ascii_stop)[:-1]
    wide_end = stop.copy()
    wide_end[1:] |= closed[1:] & stop[:-1]
    level[1:][wp & ~wh] = 1
    level[1:][(pause[:-1]) | (ascii_pause[:-1] & wh)] = 2
    level[1:][(wide_end[:-1] & ~(closed | stop)[1:]) | (after_stop[:-1] & wh)] = 3
    # a blank run after a stop keeps the pause of the stop
    spaced = np.zeros(n, bool)
    spaced[2:] = after_stop[:-2] & white[1:-1] & ~white[2:]
    level[spaced & (level < 3)] = 3
    level[1:][newline] = 4
    run = np.where(~((cp == 10) | (cp == 13) | (cp == 32) | (cp == 9)), np.arange(n), -1)
    last_ink = np.maximum.accumulate(run)
    breaks = np.cumsum((cp == 10) | ((cp == 13) & (np.append(cp[1:], 0) != 10)))
    double = np.zeros(n, bool)
    ink = last_ink[:-1]
    double[1:] = newline & (breaks[:-1] - np.where(ink >= 0, breaks[np.maximum(ink, 0)], 0) >= 2)
    level[double] = 5
    mark = ((here >= 0x300) & (here <= 0x36F)) | (here == 0x200D) | ((here >= 0xFE00) & (here <= 0xFE0F)) | ((here >= 0x1F3FB) & (here <= 0x1F3FF)) | ((here >= 0x20D0) & (here <= 0x20FF))
    level[1:][mark | (prev == 0x200D) | ((prev == 13) & (here == 10))] = -1
    level[start] = 0
    return level


def cuts(cp: np.ndarray, off: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of many texts: (text index, begin, end) with begin and end relative to the text.

    A text of at most ``limit`` characters is one piece; an empty text gives none. Each later piece begins at the earliest
    natural pause among the last ``overlap`` characters of the piece before, or exactly ``overlap`` back where there is none.
    A piece ends at the farthest pause of the strongest kind in the upper half of what fits, else at the farthest pause
    that fits, else (no pause at all) at the limit, never inside a CR LF or a combined character unless one alone is longer.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    n = int(off[-1])
    size = np.diff(off)
    filled = np.flatnonzero(size > 0)
    if not len(filled):
        return (np.zeros(0, np.int64),) * 3
    first = np.zeros(n + 1, bool)
    first[off[filled]] = True
    level = np.append(boundary_levels(cp, off[filled]), np.int8(0))
    pos = np.arange(n + 1)
    owner = np.searchsorted(off, pos, side="right") - 1
    owner[n] = filled[-1]
    # Node b is a cut before position b; a cut at a text's start is its first node. A text's end is its own fixpoint, held
    # apart from the next text's start by working on nodes b = position + text index.
    node_text = np.repeat(filled, size[filled] + 1)
    base = np.concatenate([[0], np.cumsum(size[filled] + 1)])
    rel = np.arange(base[-1]) - np.repeat(base[:-1], size[filled] + 1)
    lo, hi = off[node_text], off[node_text + 1]
    at = lo + rel
    # overlap start of every node
    pause = np.where(level > 0, pos, n + 1)
    nxt = np.minimum.accumulate(pause[::-1])[::-1]
    back = np.maximum(at - overlap, lo)
    over = np.where(nxt[back] < at, nxt[back], back)
    legal = np.maximum.accumulate(np.where(level >= 0, pos, -1))
    shifted = legal[back]
    over = np.where((nxt[back] >= at) & (shifted > lo) & (at - shifted <= overlap), shifted, over)
    over = np.where(rel == 0, lo, over)
    far = np.minimum(over + limit, hi)
    half = np.maximum(over + limit // 2, at)
    end = np.where(far == hi, hi, -1)
    for k in (5, 4, 3, 2, 1):
        last = np.maximum.accumulate(np.where(level >= k, pos, -1))[far]
        end = np.where((end < 0) & (last > half), last, end)
    last = np.maximum.accumulate(np.where(level >= 1, pos, -1))[far]
    end = np.where((end < 0) & (last > at), last, end)
    end = np.where((end < 0) & (legal[far] > at), legal[far], end)
    end = np.where(end < 0, far, end)
    succ = (np.repeat(base[:-1], size[filled] + 1) + (end - lo)).astype(np.int64)
    # Squaring: after round k the marked nodes are those within 2^k jumps of a text's start.
    seen = np.zeros(base[-1], bool)
    seen[base[:-1]] = True
    table = succ
    while True:
        more = seen.copy()
        more[table[np.flatnonzero(seen)]] = True
        if (more == seen).all():
            break
        seen, table = more, table[table]
    begin = np.flatnonzero(seen & (rel < hi - lo))
    return node_text[begin], over[begin] - lo[begin], end[begin] - lo[begin]


def split_texts(df: DataFrame, key: str, text: str, *, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(key, piece_no from 1, begin, end[, piece]) of every row; null and empty texts give no row."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, piece_no int, begin int, end int" + (", piece string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            cp, off = string_parts(texts)
            i = 0
            while i < len(keys):
                j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_CHARS, side="right")) - 1)
                j = min(j, len(keys))
                part = off[i : j + 1] - off[i]
                codes = cp[off[i] : off[j]]
                who, b, e = cuts(codes, part, limit, overlap)
                if len(who):
                    fresh = np.r_[True, who[1:] != who[:-1]]
                    begin_at = np.maximum.accumulate(np.where(fresh, np.arange(len(who)), 0))
                    no = (np.arange(len(who)) - begin_at + 1).astype(np.int32)
                    cols = [keys.take(pa.array(who + i)), pa.array(no), pa.array(b.astype(np.int32)), pa.array(e.astype(np.int32))]
                    if with_text:
                        whole = codes.tobytes().decode("utf-32-le", "replace")
                        cols.append(pa.array([whole[x:y] for x, y in zip((part[who] + b).tolist(), (part[who] + e).tolist())], pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=[x.split(" ")[0] for x in schema.split(", ")])
                i = j

    return df.select(key, text).mapInArrow(run, schema)


def _long_messages(spark, sf_dir: str, limit: int) -> DataFrame:
    m = read_table(spark, sf_dir, "chat_messages").select("message_id", "content")
    return m.where((F.length("content") > limit) & F.col("message_id").isNotNull()).dropDuplicates(["message_id"])


def p5_pieces(spark, sf_dir: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(message_id, piece_no, begin, end, piece) of each message over the limit; every message counts once however often delivered."""
    return split_texts(_long_messages(spark, sf_dir, limit), "message_id", "content", limit=limit, overlap=overlap)


def p5_found(spark, sf_dir: str) -> DataFrame:
    """(message_id): messages that had to be cut, i.e. those of which a second piece came out."""
    pieces = split_texts(_long_messages(spark, sf_dir, LIMIT), "message_id", "content", with_text=False)
    return pieces.where("piece_no = 2").select("message_id")
