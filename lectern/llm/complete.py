"""All pairs of texts that reach a similarity, without loss (problems 1 and 3).

Every text has a sketch, the parities of its trigrams' hashed places, and counts of its trigrams in Han script and others. Texts of
similarity t differ in at most (1 - t) / (1 + t) of their trigrams together, and so do their sketches and counts. Texts are dealt
into blocks of like counts; pairs of blocks, and of runs inside them, whose counts lie too far apart are left out, in the others
every sketch is compared with every other. What remains is verified by the texts. The work grows with the square of the number
of different texts.

In a large table that is left to texts of frequent trigrams. Of the others, a text of a trigrams loses at most
a - t / (1 + t) * (a + b) of them to a similar text of b. Trigrams stand in one order, rare ones first; with so many and
``s`` more at the beginning of each of two similar texts, they share ``s`` of these: all that come before the earlier end are in both.
Dealt into ``s - 1`` cells by their hashes, two fall into one of them. Texts with no two trigrams in common in any cell are left
out, without loss; the sketches of the others are compared. The order is taken from a part of the texts and
changes the time only.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, mix64, pack_cells, slices, string_parts, unpack_cells, written
from .near_duplicates import THRESHOLD

#: Smallest and largest bits of a sketch, and bits per trigram at least.
LEAST_BITS, MOST_BITS, BITS_EACH = 128, 4096, 2
#: Texts of a block, least and most, and blocks of a table of middle size; every block is written once for every block it meets.
BLOCK, BLOCKS = (2000, 250_000), 6
#: Bytes of sketches of a block, about: a task holds two blocks several times over.
BLOCK_BYTES = 24 << 20
#: Sketches compared at once: these of one side with these of the other.
STRIP, RUN = 32, 1024
#: Texts from which on those of rare trigrams are found by what they share, the share of texts that hold a rare trigram at most, and the part of a text's trigrams that are rare at least.
MANY, RARE_SHARE, RARE_PART = 20_000, 0.006, 0.25
#: Texts of a block of those, and tasks that its cells are dealt to.
RARE_BLOCK, SHARDS = 500_000, 6
#: Least trigrams of a class of sizes; smaller texts are compared by sketches alone.
CLASSES = [round(24 * 1.25**i) for i in range(28)]
#: Bits of a trigram's slot in the table of frequencies, and texts it is taken from, about.
SLOTS, COUNTED = 1 << 20, 30_000
#: Pairs of sketches compared at once.
AT_ONCE = 200_000


def keys(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Distinct trigrams of every text, sorted: text in the high 20 bits, 1 bit for those that don't begin in Han script, 43 of hash."""
    n = len(off) - 1
    if len(cp) < 3:
        return np.zeros(0, np.uint64)
    c = cp.astype(np.uint64)
    h = mix64((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(off))
    other = (c[:-2] < 0x2E80).astype(np.uint64)
    key = ((owner[:-2] << np.uint64(44)) | (other << np.uint64(43)) | (h >> np.uint64(21)))[owner[:-2] == owner[2:]]
    key.sort()
    return key[np.r_[True, key[1:] != key[:-1]][: len(key)]]


def drawn(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams, those that don't begin in Han script, bits of the sketch, sketch as a row of ``MOST_BITS`` / 8 bytes) of every text."""
    return _drawn(keys(cp, off), len(off) - 1)


def _drawn(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    text = (key >> np.uint64(44)).astype(np.int64)
    count = np.bincount(text, minlength=n)
    others = np.bincount(text[key >> np.uint64(43) & np.uint64(1) == 1], minlength=n)
    bits = np.clip(2 ** np.ceil(np.log2(np.maximum(count * BITS_EACH, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    at = (key & np.uint64((1 << 43) - 1)).astype(np.int64) & (bits[text] - 1)
    odd = np.bincount(text * MOST_BITS + at, minlength=n * MOST_BITS).astype(np.uint8) & 1
    return count, others, bits, np.packbits(odd.reshape(n, MOST_BITS), axis=1)


def frequencies(some: DataFrame) -> np.ndarray:
    """Share of these texts that hold a trigram of each slot; it orders trigrams and has no part in results, so a part of the texts is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            seen += len(batch)
            for part in slices(batch, 2048):
                total += np.bincount(_slot(keys(*string_parts(part.column(0)))), minlength=SLOTS)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([pack_cells(total.astype(np.int32))], pa.binary())], names=["n", "counts"])

    total, seen = np.zeros(SLOTS, np.int64), 0
    for r in some.select("norm").coalesce(8).mapInArrow(run, "n long, counts binary").toLocalIterator():  # one of a task
        total, seen = total + unpack_cells(bytes(r["counts"]), np.int32), seen + r["n"]
    return (total / max(1, seen)).astype(np.float32)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(SLOTS - 1)).astype(np.int64)


def cells_of(k: int) -> int:
    """Cells that the trigrams of a class of sizes are dealt into, a multiple of ``SHARDS``."""
    return SHARDS * max(1, round(0.12 * CLASSES[k] / SHARDS))


def beginning(count: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """Trigrams at the beginning of texts of so many that take part in class k, pairs whose smaller text is in it."""
    least = CLASSES[k]
    lost = np.minimum((1 - threshold) * count, (count - threshold * least) / (1 + threshold))
    return np.ceil(lost + 1e-6).astype(np.int64) + 2 + cells_of(k)


def classes(count: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Every class of sizes, and the texts that may have a pair in it."""
    for k, (least, beyond) in enumerate(zip(CLASSES, [*CLASSES[1:], np.inf])):
        at = np.flatnonzero((count >= least) & (threshold * count - 1 < beyond))
        if len(at):
            yield k, at


def frequent(key: np.ndarray, n: int, share: np.ndarray) -> np.ndarray:
    """Which of n texts are left to the comparison of sketches: those of few trigrams that few texts have, very short and very long ones."""
    text = (key >> np.uint64(44)).astype(np.int64)
    count = np.bincount(text, minlength=n)
    rare = np.bincount(text[share[_slot(key)] < RARE_SHARE], minlength=n)
    return (rare < RARE_PART * count) | (count < CLASSES[0]) | (count > 2 * CLASSES[-1])


def beginnings(key: np.ndarray, n: int, share: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, place) of the trigrams that begin up to 1,024 texts in the order of frequency, as many as any class takes."""
    count = np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=n)
    level = (np.sqrt(share) * 1023).astype(np.uint64)
    # 10 bits of the text, 10 of the frequency, 43 of the trigram
    word = (key >> np.uint64(44) << np.uint64(53)) | (level[_slot(key)] << np.uint64(43)) | (key & np.uint64((1 << 43) - 1))
    word.sort()
    text = np.repeat(np.arange(n), count)
    place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    most = np.zeros(n, np.int64)
    for k, at in classes(count, threshold):
        most[at] = np.maximum(most[at], beginning(count[at], k, threshold))
    keep = place < most[text]
    return text[keep], mix64(word[keep] & np.uint64((1 << 43) - 1)), place[keep]


def sketched(texts: DataFrame, share: np.ndarray | None = None) -> DataFrame:
    """(cls, held, count, other, sketch, plain) of texts (cls, held, norm): plain ones are left to the comparison of sketches, without ``share`` all."""
    shared = None if share is None else texts.sparkSession.sparkContext.broadcast(pack_cells(share))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if shared is None else unpack_cells(shared.value, np.float32)
        for batch in batches:
            for part in slices(batch, 512):
                cp, off = string_parts(part.column(2))
                key = keys(cp, off)
                count, others, bits, sketch = _drawn(key, len(part))
                rows = pa.array([s[: b // 8].tobytes() for s, b in zip(sketch, bits)], pa.binary())
                plain = np.ones(len(part), bool) if table is None else frequent(key, len(part), table)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count.astype(np.int32)), pa.array(others.astype(np.int32)), rows, pa.array(plain)], names=["cls", "held", "count", "other", "sketch", "plain"])
        given_back()

    return texts.select("cls", "held", "norm").mapInArrow(run, "cls long, held boolean, count int, other int, sketch binary, plain boolean")


def dealt_beginnings(texts: DataFrame, share: np.ndarray, cuts: list[int], threshold: float) -> DataFrame:
    """(x, y, g, cls, held, count, sketch, tokens, places): the texts that are not plain, once for every two blocks of sizes and share of the cells.

    ``cuts`` are the least trigrams of the second and further blocks.
    """
    shared = texts.sparkSession.sparkContext.broadcast(pack_cells(share))
    ends = [0, *cuts, 1 << 30]
    meets = {x: [y for y in range(len(ends) - 1) if min(ends[x + 1], ends[y + 1]) >= threshold * max(ends[x], ends[y]) - 1] for x in range(len(ends) - 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unpack_cells(shared.value, np.float32)
        for batch in batches:
            for part in slices(batch, 512):
                again = pd.DataFrame({"cls": part.column(0).to_numpy(), "held": part.column(1).to_numpy(zero_copy_only=False)}).duplicated()
                part = part.filter(pa.array(~again.to_numpy()))  # other copies are dropped by the task
                key = keys(*string_parts(part.column(2)))
                rare = np.flatnonzero(~frequent(key, len(part), table))
                if not len(rare):
                    continue
                part = part.take(pa.array(rare))
                n, key = len(part), keys(*string_parts(part.column(2)))
                count, _, bits, sketch = _drawn(key, n)
                text, h, place = beginnings(key, n, table, threshold)
                share_ = text * SHARDS + (h % np.uint64(SHARDS)).astype(np.int64)
                order = np.argsort(share_, kind="stable")
                end = np.concatenate([[0], np.cumsum(np.bincount(share_, minlength=n * SHARDS))])
                # places as steps from the one before; a step cut at 255 puts trigrams nearer the beginning, which leaves nothing out
                steps = np.diff(place[order], prepend=0)
                opening = end[:-1][end[1:] > end[:-1]]
                steps[opening] = place[order][opening]
                tokens, places = (pa.Array.from_buffers(pa.binary(), n * SHARDS, [None, pa.py_buffer((end * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())]) for x in ((h[order] >> np.uint64(32)).astype(np.uint32), np.minimum(steps, 255).astype(np.uint8)))
                drawn_ = pa.array([x[: b // 8].tobytes() for x, b in zip(sketch, bits)], pa.binary())
                block = np.searchsorted(cuts, count, side="right")
                for x in np.unique(block).tolist():
                    at = (np.flatnonzero(block == x)[:, None] * SHARDS + np.arange(SHARDS)).reshape(-1)
                    i, row = pa.array(at // SHARDS), pa.array(at)
                    for y in meets[x]:
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(np.full(len(at), v, np.int32)) for v in (min(x, y), max(x, y))), pa.array((at % SHARDS).astype(np.int32)), part.column(0).take(i), part.column(1).take(i)]
                            + [pa.array(count.astype(np.int32)).take(i), drawn_.take(i), tokens.take(row), places.take(row)],
                            names=["x", "y", "g", "cls", "held", "count", "sketch", "tokens", "places"],
                        )
        given_back()

    return texts.select("cls", "held", "norm").mapInArrow(run, "x int, y int, g int, cls long, held boolean, count int, sketch binary, tokens binary, places binary")


def _twos(owner: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Words of all two trigrams of an owner, sorted: 40 bits of their hash, 24 of the owner. An owner's trigrams stand together and in one order."""
    places, b, d = [], np.arange(len(owner), dtype=np.int32), 1
    while len(b):
        b = b[b >= d]
        b = b[owner[b - d] == owner[b]]
        places.append(b)
        d += 1
    out, at = np.empty(sum(map(len, places)), np.uint64), 0
    for d, b in enumerate(places, 1):
        word = mix64(token[b] * np.uint64(0x9E3779B97F4A7C15) + token[b - d])
        word >>= np.uint64(24)
        word <<= np.uint64(24)
        word |= owner[b].astype(np.uint64)
        out[at : at + len(b)] = word
        at += len(b)
    out.sort()
    return out


def _flat(column: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of bytes end to end, and the number of each row's."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.zeros(0, kind) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind)
    return flat, np.diff(off).astype(np.int64) // np.dtype(kind).itemsize


def sharing(texts: pa.Table, cuts: list[int], threshold: float, sides: bool) -> pa.Table:
    """(a, b): pairs of the texts of two blocks with two trigrams of a cell in common and sketches that allow the threshold, for one share of the cells."""
    across = texts["x"][0] != texts["y"][0]
    cls, held, count = (texts[c].to_numpy() for c in ("cls", "held", "count"))
    order = np.lexsort((held, cls, count))
    new = np.r_[True, (cls[order][1:] != cls[order][:-1]) | (held[order][1:] != held[order][:-1])]
    order = order[new]
    cls, held, count, n = cls[order], held[order].astype(bool), count[order].astype(np.int64), len(order)
    at = pa.array(order)
    token, size = _flat(texts["tokens"].take(at), np.uint32)
    steps, _ = _flat(texts["places"].take(at), np.uint8)
    sketch = texts["sketch"].take(at).combine_chunks()
    del texts
    first = np.cumsum(size) - size
    # the arrays over all trigrams are the most that a task holds, so they are narrow
    place = np.cumsum(steps, dtype=np.int32)
    place -= np.repeat(np.r_[np.int32(0), place][first], size)
    del steps, order
    bits = _flat(sketch, np.uint8)[1] * 8
    # sketches of one size stand in one table; larger ones are folded to it
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in np.unique(bits).tolist():
        at = np.flatnonzero(bits >= b)
        rows = np.empty((len(at), b // 64), np.uint64)
        for w in np.unique(bits[at]).tolist():
            own = np.flatnonzero(bits[at] == w)
            r = _flat(sketch.take(pa.array(at[own])), np.uint64)[0].reshape(len(own), -1)
            while r.shape[1] * 64 > b:
                r = r[:, : r.shape[1] // 2] ^ r[:, r.shape[1] // 2 :]
            rows[own] = r
        index = np.full(n, -1, np.int32)
        index[at] = np.arange(len(at))
        tables[b] = (rows, index)
    del sketch
    small, part = count.astype(np.float32), np.float32((1 - threshold) / (1 + threshold))
    block = np.searchsorted(cuts, count, side="right")
    found = [np.zeros(0, np.int64)]

    def near(i: np.ndarray, j: np.ndarray) -> None:
        """Pairs i < j, so that j has no fewer trigrams."""
        a, b = small[i], small[j]
        most = part * (a + b) + np.float32(1.001)
        ok = a >= np.float32(threshold) * b - 1
        if sides:
            ok &= held[i] != held[j]
        if across:
            ok &= block[i] != block[j]
        i, j, most = i[ok], j[ok], most[ok]
        least = np.minimum(bits[i], bits[j])
        for w, (rows, index) in tables.items():
            at = np.flatnonzero(least == w)
            if not len(at):
                continue
            p, q = i[at], j[at]
            apart = rows.take(index[p], axis=0)
            apart ^= rows.take(index[q], axis=0)
            ones = np.bitwise_count(apart)
            if w % 512:
                total = ones.sum(axis=1, dtype=np.int32)
            else:  # eight counts of a byte are added at once
                eight = ones.view(np.uint64)
                eight = (eight & np.uint64(0x00FF00FF00FF00FF)) + (eight >> np.uint64(8) & np.uint64(0x00FF00FF00FF00FF))
                eight = (eight * np.uint64(0x0001000100010001)) >> np.uint64(48)
                total = eight[:, 0] if w == 512 else eight.sum(axis=1)
            good = total <= most[at]
            p, q = p[good], q[good]
            found.append(p.astype(np.int64) * n + q)

    for k, at in classes(count, threshold):
        own_class = int(np.searchsorted(count, CLASSES[k + 1])) if k + 1 < len(CLASSES) else n
        # texts stand by their numbers of trigrams, so those of a class stand together
        lo, hi = int(at[0]), int(at[-1]) + 1
        begin, end = int(first[lo]), int(first[hi - 1] + size[hi - 1])
        keep = place[begin:end] < np.repeat(beginning(count[lo:hi], k, threshold).astype(np.int32), size[lo:hi])
        own, tok = np.repeat(np.arange(lo, hi, dtype=np.int32), size[lo:hi])[keep], token[begin:end][keep]
        del keep
        cell = (tok % np.uint32(cells_of(k) // SHARDS)).astype(np.uint16)
        for c in range(cells_of(k) // SHARDS):
            mine = cell == c
            word = _twos(own[mine], tok[mine].astype(np.uint64))
            text = (word & np.uint64((1 << 24) - 1)).astype(np.int32)
            word >>= np.uint64(24)
            # pairs of a smaller text, which is of this class, with all that follow in its run
            end = np.flatnonzero(np.r_[word[1:] != word[:-1], True][: len(word)]).astype(np.int32)
            later = np.repeat(end, np.diff(np.r_[np.int32(-1), end])) - np.arange(len(word), dtype=np.int32)
            del word, end
            of = np.flatnonzero((later > 0) & (text < own_class))
            later = later[of]
            pairs, begin = np.cumsum(later, dtype=np.int64), 0
            while begin < len(of):
                past = max(begin + 1, int(np.searchsorted(pairs, (pairs[begin - 1] if begin else 0) + AT_ONCE, side="right")))
                i, at_ = of[begin:past], later[begin:past]
                one = np.repeat(i, at_)
                near(text[one], text[one + np.arange(len(one)) - np.repeat(np.cumsum(at_) - at_, at_) + 1])
                begin = past
        found = [np.unique(np.concatenate(found))]
        del own, tok, cell
        given_back()
    i, j = found[0] // max(1, n), found[0] % max(1, n)
    a, b = cls[i], cls[j]
    turn = held[i] if sides else a > b
    good = a != b
    return pa.table({"a": np.where(turn, b, a)[good], "b": np.where(turn, a, b)[good]})


def _most(a, b, threshold: float):
    """Trigrams in which texts of so many may differ; one more for hashes that fall together."""
    return (1 - threshold) / (1 + threshold) * (a + b) + 1.000001


@functools.lru_cache(1 << 16)
def _begin(a: int, b: int, most: int, bits: int) -> tuple[int, int]:
    """(bits of the folded sketch, words of it) that are compared first, the fewest that most pairs of so many trigrams exceed ``most`` in.

    It changes the time and no result.
    """
    for words in range(1, bits // 64):
        for level in (x for x in (LEAST_BITS << i for i in range(16)) if words * 64 <= x <= bits):
            odd = (1 - np.exp(-1.6 * (a + b) / level)) / 2
            if words * 64 * odd - most > 2 * np.sqrt(words * 64 * odd * (1 - odd)):
                return level, words
    return bits, bits // 64


class _Side:
    """Texts of one size of sketch in an order that puts like counts together."""

    def __init__(self, cls: np.ndarray, count: np.ndarray, other: np.ndarray, sketch: list[bytes]):
        order = np.lexsort((count, other // 16))
        self.cls, self.count, self.other = cls[order], count[order], other[order]
        rows = np.frombuffer(b"".join(sketch[i] for i in order.tolist()), np.uint8).reshape(len(order), -1)
        self.bits, self.rows, self.folded = rows.shape[1] * 8, {}, {}
        bits = self.bits
        while True:
            self.rows[bits] = np.ascontiguousarray(rows).view(np.uint64)
            self.folded[bits] = np.ascontiguousarray(self.rows[bits].T)
            if bits == LEAST_BITS:
                break
            half = bits // 16
            bits, rows = bits // 2, rows[:, :half] ^ rows[:, half:]
        self.bounds: dict[int, tuple[np.ndarray, ...]] = {}

    def runs(self, size: int) -> tuple[np.ndarray, ...]:
        """Begin of every run of ``size`` texts, and its least and largest number of Han, other and all trigrams."""
        if size not in self.bounds:
            at = np.arange(0, len(self.cls), size)
            self.bounds[size] = (at, *(f.reduceat(x, at) for x in (self.count - self.other, self.other, self.count) for f in (np.minimum, np.maximum)))
        return self.bounds[size]


_SCRATCH = [np.empty(STRIP * RUN, t) for t in (np.uint64, np.uint8, np.uint8, np.uint16)]


def _apart(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """In how many bits the words of x (each repeated along a run) and y differ, pair by pair; four words that differ in all bits may count as none."""
    n, m = x[0].shape
    word, ones, some, out = (s[: n * m].reshape(n, m) for s in _SCRATCH)
    for w, mine in enumerate(x):
        np.bitwise_xor(mine, y[w], out=word)
        np.bitwise_count(word, out=ones if w % 4 else some)
        if w % 4:
            some += ones
        if len(x) > 4 and (w % 4 == 3 or w == len(x) - 1):
            if w == 3:
                out[:] = some
            else:
                out += some
    return out if len(x) > 4 else some


def _near(left: _Side, right: _Side, threshold: float, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): pairs that the sketches and counts allow; with ``once`` both sides are one set's texts, and every pair comes in one order."""
    bits = min(left.bits, right.bits)
    at, *box = left.runs(STRIP)
    begin, *far = right.runs(RUN)
    gap = lambda i, k: np.maximum(0, np.maximum(far[k] - box[k + 1][i], box[k][i] - far[k + 1]))
    ends = np.r_[begin[1:], len(right.cls)]
    for i, lo in enumerate(at.tolist()):
        most = _most(box[5][i], far[5], threshold)
        ok = (gap(i, 0) + gap(i, 2) <= most) & (far[5] >= threshold * box[4][i] - 1) & (box[5][i] >= threshold * far[4] - 1)
        if once:
            ok &= ends > lo
        repeated: dict[int, list[np.ndarray]] = {}
        met: list[tuple[np.ndarray, np.ndarray]] = []
        for j in np.flatnonzero(ok).tolist():
            u, v = int(begin[j]), int(ends[j])
            level, words = _begin(int(box[4][i] + box[5][i]) // 16 * 8, int(far[4][j] + far[5][j]) // 16 * 8, int(most[j]), bits)
            # comparing rows with rows is faster than with one value
            mine = repeated.setdefault(level, [])
            for w in range(len(mine), words):
                mine.append(np.repeat(left.folded[level][w, lo : lo + STRIP, None], min(RUN, len(right.cls)), axis=1))
            apart = _apart([x[:, : v - u] for x in mine[:words]], right.folded[level][:, u:v]).reshape(-1)
            hit = np.flatnonzero(apart <= min(int(most[j]), 255 if words <= 4 else 65535))
            if len(hit):
                met.append((hit // (v - u) + lo, hit % (v - u) + u))
        if met:
            p, q = (np.concatenate(x) for x in zip(*met))
            if once:
                p, q = p[p < q], q[p < q]
            a, b = left.count[p], right.count[q]
            apart = np.bitwise_count(left.rows[bits][p] ^ right.rows[bits][q]).sum(axis=1, dtype=np.int64)
            good = (apart <= _most(a, b, threshold)) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1)
            a, b = left.cls[p[good]], right.cls[q[good]]
            yield a[a != b], b[a != b]


def blocks_met(pdf: pd.DataFrame, threshold: float, sides: bool) -> pd.DataFrame:
    """(a, b) of two blocks of texts (x, y; block, cls, held, count, other, sketch), each pair once."""
    same = pdf["x"].iloc[0] == pdf["y"].iloc[0]
    cls, count, other = pdf["cls"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64), pdf["other"].to_numpy(np.int64)
    sketch, held, first = pdf["sketch"].tolist(), pdf["held"].to_numpy(bool), (pdf["block"] == pdf["x"]).to_numpy(bool)
    size = np.array([len(s) for s in sketch])

    def side(some: np.ndarray) -> list[_Side]:
        out = []
        for n in np.unique(size[some]).tolist():
            at = np.flatnonzero(some & (size == n))
            out.append(_Side(cls[at], count[at], other[at], [sketch[i] for i in at.tolist()]))
        return out

    second = first if same else ~first
    meets = [(first & ~held, second & held, False)] + ([] if same else [(second & ~held, first & held, False)]) if sides else [(first, second, same)]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for mine, theirs, once in meets:
        # the texts of one block against each other: sides of different sketches in one order only
        lefts = side(mine)
        rights = lefts if once else side(theirs)
        for i, left in enumerate(lefts):
            for right in rights[i:] if once else rights:
                for p, q in _near(left, right, threshold, left is right):
                    a.append(p if sides else np.minimum(p, q))
                    b.append(q if sides else np.maximum(p, q))
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def met_blocks(rows: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """Sketched texts dealt into blocks, each once for every two blocks (x, y) that may hold a pair with a plain text, and the number of those."""
    spark = rows.sparkSession
    rows = rows if "plain" in rows.columns else rows.withColumn("plain", F.lit(True))
    n, size = rows.where("plain").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("sketch")), F.lit(0))).first()
    each = int(np.clip(-(-rows.count() // BLOCKS), BLOCK[0], max(BLOCK[0], min(BLOCK[1], BLOCK_BYTES * n // max(1, size)))))
    wanted = max(1, -(-n // each))

    # by numbers of trigrams that are not Han first, then by numbers of all; where the cuts lie changes no result
    def cut(some: DataFrame, by: list[str], column: str, out: str, cuts: int) -> DataFrame:
        if cuts == 1:
            return some.withColumn(out, F.lit(0))
        parts = F.array(*[F.lit(i / cuts) for i in range(1, cuts)]).cast("array<double>")
        at = some.groupBy(*by).agg(F.percentile_approx(column, parts, 1000).alias("__q"))
        met = some.join(F.broadcast(at), by) if by else some.crossJoin(F.broadcast(at))
        return met.withColumn(out, F.size(F.filter("__q", lambda v: v < F.col(column)))).drop("__q")

    first = max(1, int(np.sqrt(wanted)))
    dealt = cut(cut(rows, ["plain"], "other", "o", first), ["plain", "o"], "count", "s", -(-wanted // first))
    sizes = dealt.groupBy("plain", "o", "s").agg(F.ceil(F.count("*") / (2 * each)).cast("int").alias("__n"))
    dealt = dealt.join(F.broadcast(sizes), ["plain", "o", "s"]).withColumn("block", F.concat_ws(".", F.col("plain").cast("string"), "o", "s", F.pmod(F.xxhash64("cls"), F.col("__n")).cast("string"))).drop("o", "s", "__n")
    han = F.col("count") - F.col("other")
    boxes = dealt.groupBy("block").agg(*[f(c).alias(f"c{k}") for k, (c, f) in enumerate((c, f) for c in (han, F.col("other"), F.col("count")) for f in (F.min, F.max))]).collect()
    gap = lambda u, v, k: max(0, v[f"c{k}"] - u[f"c{k + 1}"], u[f"c{k}"] - v[f"c{k + 1}"])
    plain = lambda u: u["block"].startswith("true")
    met = [(u["block"], v["block"]) for u in boxes for v in boxes if u["block"] <= v["block"] and (plain(u) or plain(v)) and gap(u, v, 0) + gap(u, v, 2) <= _most(u["c5"], v["c5"], threshold) and min(u["c5"], v["c5"]) >= threshold * max(u["c4"], v["c4"]) - 1]
    pairs = spark.createDataFrame(met, "x string, y string")
    roles = pairs.select(F.col("x").alias("block"), "x", "y").unionByName(pairs.where("x <> y").select(F.col("y").alias("block"), "x", "y"))
    return dealt.join(F.broadcast(roles), "block"), len(met)


def all_candidates(texts: DataFrame, threshold: float = THRESHOLD, *, sides: bool = False, share: np.ndarray | None = None) -> DataFrame:
    """(a, b): pairs of classes, among them all that reach the threshold; with ``sides`` a from one and b, held, from the other.

    ``texts`` holds (cls, held, norm). With ``share``, the frequencies of trigrams, texts of rare ones are found by what they
    share, which gives the same pairs and is cheaper for many texts.
    """
    spark = texts.sparkSession
    rows = written(sketched(texts, share).where("count > 0").dropDuplicates(["cls", "held"]), "complete-sketches")
    to, met = met_blocks(rows, threshold)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        out = blocks_met(pdf, threshold, sides)
        given_back()
        return out

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = to.repartition(max(1, min(met, 8 * partitions)), "x", "y").groupBy("x", "y").applyInPandas(product, "a long, b long")
    if share is None:
        return found

    def shares(dealt: pa.Table) -> pa.Table:
        return sharing(dealt, cuts, threshold, sides)

    rare = rows.where("NOT plain")
    blocks = -(-rare.count() // RARE_BLOCK)
    cuts = sorted({c for c in rare.select(F.percentile_approx("count", [i / blocks for i in range(1, blocks)], 1000)).first()[0]}) if blocks > 1 else []
    dealt = dealt_beginnings(texts, share, cuts, threshold)
    more = dealt.repartition(max(1, min((len(cuts) + 1) ** 2 * SHARDS, 8 * partitions)), "x", "y", "g").groupBy("x", "y", "g").applyInArrow(shares, "a long, b long")
    return found.unionByName(more).distinct()
