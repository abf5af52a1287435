"""Problem 3: records of held-out splits that also stand in train, by a compressed full-text index.

1. Questions are normalised; exact copies form classes (hash of the text), and each class takes part once a side.
2. At content-defined places (a hash of the last six characters, so the same passage is marked in every text) a text yields
   a window: the characters before the place. Windows go to the shard their last characters name; shards of held-out windows
   are of bounded size; windows of a hot passage are dealt into parts by their classes.
3. Each shard is turned into an FM-index (Burrows-Wheeler transform of the windows as a wavelet matrix, sampled suffixes). The
   shard's train windows stream through it by backward search, many at a time: a window gives all held-out windows that agree with its
   last ``LEAST_MATCH`` symbols, whether or not others agree further. Where these are more than ``FULL``, the window meets the
   about ``FULL`` whose classes share a cell with its own, in two crossing ways of dealing classes into cells.
4. Windows carry a sketch of their text: the parities of its trigrams' hashed places. Two sketches differ in no more bits than
   the texts have trigrams of their own, so pairs that differ in too many can't reach the threshold and are dropped without
   loss; the others are verified exactly.
5. Groups linked by a pair that met in a cell are compared whole, block against block, so a family of any size gives all its
   pairs, while a passage that many texts share and no more gives each of them a bounded number of others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_letters, mix64, pack_cells, read_table, slices, string_parts, strings, text_hashes, unpack_cells, written
from .near_duplicates import FULL, THRESHOLD, group_pairs, jaccard, trigrams, unfinished, verified

WIDTH = 20
#: Mean distance of marked places (half of it up to DENSE characters), least match, and length up to which texts are marked everywhere.
SPACING, DENSE, LEAST_MATCH, SHORT_MATCH, SHORT = 8, 80, 8, 3, 42
#: Held-out windows of an index, and train windows that one task streams through it, at most; bits of a slot of window keys.
SHARD_WINDOWS, SHARD_QUERIES, SLOT_BITS = 150_000, 1_500_000, 16
#: Smallest and largest bits of a text's sketch, bits per trigram at least (up to the largest), and pairs compared at once.
LEAST_BITS, MOST_BITS, BITS_EACH, AT_ONCE = 64, 1024, 1.5, 500_000


class Ranked:
    """A vector of bits with its counts of ones sampled at every 64th place: 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)]).astype(np.uint32)

    def ones(self, upto: np.ndarray) -> np.ndarray:
        word = upto >> 6
        below = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & below)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class BackwardIndex:
    """FM-index over windows given as rows of ``WIDTH`` symbols (2 to 255, left-padded by 0), each closed by a separator.

    The Burrows-Wheeler transform is kept as a wavelet matrix, i.e. eight bit vectors with sampled ranks (12 bits a symbol), and
    the windows' numbers at sampled suffixes only, from which other rows are reached by walking back through the transform.
    """

    def __init__(self, rows: np.ndarray):
        n, w = rows.shape
        self.n, self.width, self.size = n, w, n * (w + 1)
        wide = np.zeros((n, w + 9), np.uint8)
        wide[:, :w] = rows
        key = np.zeros((n, w + 1), np.uint64)
        for d in range(8):
            key = (key << np.uint64(8)) | wide[:, d : d + w + 1]
        rank, depth = self._ranks(key), 8
        while depth < w:
            beyond = np.zeros_like(rank)
            beyond[:, : w + 1 - depth] = rank[:, depth:]
            rank, depth = self._ranks((rank << np.uint64(32)) | beyond), depth * 2
        # ties, i.e. equal rest of the window, stand in the order of the windows
        order = np.argsort((rank.reshape(-1) << np.uint64(32)) | np.repeat(np.arange(n, dtype=np.uint64), w + 1))
        window, at = (order // (w + 1)).astype(np.int32), order % (w + 1)
        last = np.where(at > 0, rows[window, np.maximum(at - 1, 0)], 0)
        # suffixes of the shortest matches and those at which a window's text begins; walks go from right to left
        kept = (at == w - LEAST_MATCH) | (at == w - SHORT_MATCH) | ((last == 0) & (wide[window, at] > 0))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=256))])
        self.levels, self.zeros, begin = [], [], np.zeros(256, np.int64)
        symbols = np.arange(256)
        for k in range(7, -1, -1):
            bit = last >> k & 1
            level = Ranked(bit)
            one = symbols >> k & 1 == 1
            ones = level.ones(begin)
            self.levels.append(level)
            self.zeros.append(int(len(last) - bit.sum()))
            begin = np.where(one, self.zeros[-1] + ones, begin - ones)
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.begin = begin
        self.sampled, self.window = Ranked(kept), window[kept]

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        flat = key.reshape(-1)
        order = np.argsort(flat)
        ordered = flat[order]
        out = np.empty(len(flat), np.uint64)
        out[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]]).astype(np.uint64)
        return out.reshape(key.shape)

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The row before which all suffixes stand that put the symbol before a suffix ahead of the given row."""
        symbol = symbol.astype(np.int64)
        at = row
        for k, level, zeros in zip(range(7, -1, -1), self.levels, self.zeros):
            ones = level.ones(at)
            at = np.where(symbol >> k & 1 == 1, zeros + ones, at - ones)
        return self.first[symbol] + at - self.begin[symbol]

    def before(self, row: np.ndarray) -> np.ndarray:
        """The row of each row's suffix with one more symbol in front."""
        at, symbol = row, np.zeros(len(row), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            bit, ones = level.bit(at), level.ones(at)
            at, symbol = np.where(bit == 1, zeros + ones, at - ones), symbol << 1 | bit
        return self.first[symbol] + at - self.begin[symbol]

    def located(self, row: np.ndarray) -> np.ndarray:
        """The window of every row."""
        row, open_ = row.copy(), np.arange(len(row))
        while len(open_ := open_[self.sampled.bit(row[open_]) == 0]):
            row[open_] = self.before(row[open_])
        return self.window[self.sampled.ones(row)]

    def matches(self, rows: np.ndarray, least: np.ndarray, *, maximal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per query row that matches ``least`` symbols or more from its end: row number, interval and length of the maximal match.

        Otherwise that of the least match, whose interval holds those of all longer ones.
        """
        m, w = rows.shape
        best_lo, best_hi, best = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.zeros(m, np.int64)
        live, lo, hi = np.arange(m), np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for length in range(1, (w if maximal else int(least.max(initial=0))) + 1):
            if not maximal:
                more = least[live] >= length
                live, lo, hi = live[more], lo[more], hi[more]
            symbol = rows[live, w - length]
            a, b = self.step(symbol, lo), self.step(symbol, hi)
            keep = (b > a) & (symbol > 0)
            live, lo, hi = live[keep], a[keep], b[keep]
            if not len(live):
                break
            best_lo[live], best_hi[live], best[live] = lo, hi, length
        hit = np.flatnonzero(best >= least)
        return hit, best_lo[hit], best_hi[hit], best[hit]


def windows(cp: np.ndarray, off: np.ndarray, *, symbols: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """(text, key, symbols, least match) of every marked place of some texts."""
    n = len(cp)
    size = np.diff(off)
    owner = np.repeat(np.arange(len(size)), size)
    local = np.arange(n) - off[:-1][owner] + 1  # characters up to and with this one
    c = mix64(cp.astype(np.uint64) + np.uint64(0x51))
    h3 = c.copy()
    for d in (1, 2):
        h3[d:] += mix64(c[:-d] + np.uint64(d))
    h6 = h3.copy()
    for d in (3, 4, 5):
        h6[d:] += mix64(c[:-d] + np.uint64(d))
    length = size[owner]
    # places of a dense text contain those that a longer text would have
    marked = (local >= LEAST_MATCH) & ((mix64(h6) >> np.uint64(33)) % np.where(length <= DENSE, SPACING // 2, SPACING).astype(np.uint64) == 0)
    short = (length <= SHORT) & (local >= SHORT_MATCH)
    ends, brief = np.flatnonzero(marked), np.flatnonzero(short)
    at = np.concatenate([ends, brief])
    key = np.concatenate([mix64(h6[ends]), mix64(h3[brief] ^ np.uint64(0xABCDEF))])
    least = np.concatenate([np.full(len(ends), LEAST_MATCH), np.full(len(brief), SHORT_MATCH)])
    if not symbols:
        return owner[at], key, None, least
    code = (2 + c % np.uint64(254)).astype(np.uint8)
    grid = at[:, None] - np.arange(WIDTH - 1, -1, -1)[None, :]
    inside = grid >= off[:-1][owner[at]][:, None]
    return owner[at], key, np.where(inside, code[np.maximum(grid, 0)], 0).astype(np.uint8), least


def sketches(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of distinct trigrams, bits of the sketch, sketch as a row of ``MOST_BITS`` / 8 bytes) of every text."""
    n, key = len(off) - 1, trigrams(cp, off)
    text = (key >> np.uint64(44)).astype(np.int64)
    count = np.bincount(text, minlength=n)
    bits = np.clip(2 ** np.ceil(np.log2(np.maximum(count * BITS_EACH, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    at = (key & np.uint64((1 << 44) - 1)).astype(np.int64) & (bits[text] - 1)
    odd = np.bincount(text * MOST_BITS + at, minlength=n * MOST_BITS) & 1
    return count, bits, np.packbits(odd.astype(np.uint8).reshape(n, MOST_BITS), axis=1)


class Sketched:
    """Sketches with their classes and trigram counts, folded to every size."""

    def __init__(self, cls: np.ndarray, count: np.ndarray, col: pa.Array):
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        size = np.diff(off)
        rows = np.zeros((len(col), MOST_BITS // 8), np.uint8)
        i, at = _ranges(off[:-1], off[1:])
        rows[i, at - off[:-1][i]] = data[at]
        self.cls, self.count, self.bits = cls, count, size * 8
        self.folded, bits = {MOST_BITS: rows}, MOST_BITS
        while bits > LEAST_BITS:
            half = bits // 16
            bits, rows = bits // 2, rows[:, :half] ^ rows[:, half:]
            self.folded[bits] = rows
        self.folded = {b: np.ascontiguousarray(r).view(np.uint64) for b, r in self.folded.items()}

    def near(self, i: np.ndarray, other: Sketched, j: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs of an own row i and another's row j may reach the threshold: never false for one that does."""
        a, b = self.count[i], other.count[j]
        ok = (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-6) & (self.cls[i] != other.cls[j])
        bits = np.minimum(self.bits[i], other.bits[j])
        most = (1 - threshold) / (1 + threshold) * (a + b) + 1e-6
        for size in self.folded:
            at = np.flatnonzero(ok & (bits == size))
            apart = np.bitwise_count(self.folded[size][i[at]] ^ other.folded[size][j[at]]).sum(axis=1, dtype=np.int64)
            ok[at] = apart <= most[at]
        return ok


def compared(pdf: pd.DataFrame, threshold: float, sides: bool) -> pd.DataFrame:
    """(a, b, sim) of two blocks of texts (x, y; own, node, held, norm), each pair once: sketches first, then the texts themselves."""
    x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
    norm = pa.array(pdf["norm"], pa.string())
    count, bits, drawn = sketches(*string_parts(norm))
    cls, own, held = pdf["node"].to_numpy(np.int64), pdf["own"].to_numpy(), pdf["held"].to_numpy(bool)
    packed = pa.array([d[: n // 8].tobytes() for d, n in zip(drawn, bits)], pa.binary())
    rows = Sketched(cls, count, packed)
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    out: list[tuple] = []
    for begin in range(0, len(left), max(1, AT_ONCE // max(1, len(right)))):
        part = left[begin : begin + max(1, AT_ONCE // max(1, len(right)))]
        i, j = np.repeat(part, len(right)), np.tile(right, len(part))
        ok = (held[i] != held[j]) if sides else np.ones(len(i), bool)
        if x == y:
            ok &= i < j
        i, j = i[ok], j[ok]
        ok = rows.near(i, rows, j, threshold)
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 4096):
            u, v = i[k : k + 4096], j[k : k + 4096]
            sim = jaccard(norm.take(pa.array(u)), norm.take(pa.array(v)))
            u, v, sim = u[sim >= threshold], v[sim >= threshold], sim[sim >= threshold]
            turn = held[u] if sides else cls[u] > cls[v]
            out.append((np.where(turn, cls[v], cls[u]), np.where(turn, cls[u], cls[v]), sim))
    a, b, sim = (np.concatenate(z) if out else np.zeros(0, t) for z, t in zip(zip(*out) if out else [()] * 3, (np.int64, np.int64, float)))
    return pd.DataFrame({"a": a, "b": b, "sim": sim})


def side_texts(rows: DataFrame) -> DataFrame:
    """(cls, held, norm): the distinct normalised questions of each side, from (held, question)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cp, off = joined_letters(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(text_hashes(cp, off)), part.column(0), strings(cp, off)], names=["cls", "held", "norm"])

    return rows.mapInArrow(run, "cls long, held boolean, norm string").where(F.length("norm") >= 3).dropDuplicates(["cls", "held"])


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def shard_sizes(texts: DataFrame, slot_bits: int = SLOT_BITS) -> tuple[np.ndarray, int]:
    """Parts of each slot of window keys, and the number of all tasks' held-out windows.

    A slot of more windows than a task should have is one of a hot passage. Its windows, of both sides, are dealt into parts as
    classes are dealt into cells, once each way, so neither side of it meets in one task and nothing is copied more than twice.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << slot_bits), np.int64)
        for batch in batches:
            for part in slices(batch):
                text, key, _, _ = windows(*string_parts(part.column(1)), symbols=False)
                side = (~part.column(0).to_numpy(zero_copy_only=False)).astype(np.int64)[text]
                total += np.bincount(side << slot_bits | _slot(key, slot_bits), minlength=2 << slot_bits).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([pack_cells(total)], pa.binary())], names=["part", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [0], "counts": [pack_cells(sum(unpack_cells(x, np.int64) for x in pdf["counts"]))]})

    schema = "part int, counts binary"
    got = texts.select("held", "norm").mapInArrow(count, schema).groupBy("part").applyInPandas(add, schema).collect()
    held, train = unpack_cells(got[0]["counts"], np.int64).reshape(2, -1) if got else np.zeros((2, 1 << slot_bits), np.int64)
    parts = np.maximum(1, np.maximum(-(-held // SHARD_WINDOWS), -(-train // SHARD_QUERIES)))
    return parts, int((held * np.where(parts > 1, 2, 1)).sum())


def routed_windows(texts: DataFrame, parts: np.ndarray) -> DataFrame:
    """(route, what, cls, symbols, sketch): a window goes to its slot, in a hot slot to the part of its class by either dealing.

    ``what`` packs side (train after held-out), kind of place and number of trigrams of the text in one long.
    """
    shared = texts.sparkSession.sparkContext.broadcast(pack_cells(parts))  # a number a slot, at most 2^20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = unpack_cells(shared.value, np.int64)
        slot_bits = len(split).bit_length() - 1
        for batch in batches:
            for part in slices(batch, 1024):
                cp, off = string_parts(part.column(2))
                text, key, symbols, least = windows(cp, off)
                count, bits, sketch = sketches(cp, off)
                cls = part.column(0).to_numpy()[text]
                held = part.column(1).to_numpy(zero_copy_only=False)[text]
                slot = _slot(key, slot_bits)
                i = np.repeat(np.arange(len(key)), np.where(split[slot] > 1, 2, 1))
                second = np.r_[False, i[1:] == i[:-1]][: len(i)]
                one, two = (((k >> np.uint64(32)) * split[slot].astype(np.uint64)) >> np.uint64(32) for k in dealings(cls))
                nth = np.where(second, two[i].astype(np.int64) << 1 | 1, one[i].astype(np.int64) << 1)
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(i), [None, pa.py_buffer(symbols[i].tobytes())])
                what = ((~held[i]).astype(np.int64) << 62) | ((least[i] < LEAST_MATCH).astype(np.int64) << 60) | count[text[i]]
                size = bits[text[i]] // 8
                t, at = _ranges(np.zeros(len(i), np.int64), size)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                drawn = pa.BinaryArray.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(sketch[text[i][t], at].tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot[i] << 40 | nth), pa.array(what), pa.array(cls[i]), data.cast(pa.binary()), drawn],
                    names=["route", "what", "cls", "symbols", "sketch"],
                )

    return texts.select("cls", "held", "norm").mapInArrow(run, "route long, what long, cls long, symbols binary, sketch binary")


def _symbols(col: pa.Array) -> np.ndarray:
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(-1, WIDTH) if len(col) else np.zeros((0, WIDTH), np.uint8)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of half-open ranges: number of the range, member."""
    n = hi - lo
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]


class HeldShard:
    """An index with its windows' sketches; large intervals are dealt into cells once."""

    def __init__(self, symbols: np.ndarray, cls: np.ndarray, count: np.ndarray, drawn: pa.Array):
        self.index, self.rows = BackwardIndex(symbols), Sketched(cls, count, drawn)
        self.dealt: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def cells(self, lo: int, hi: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each dealing the sorted keys of an interval's windows, and the windows."""
        if (lo, hi) not in self.dealt:
            if sum(len(x[0][0]) for x in self.dealt.values()) > 2_000_000:
                self.dealt.clear()
            window = self.index.located(np.arange(lo, hi))
            _, once = np.unique(self.rows.cls[window], return_index=True)
            window = window[once]
            keys = dealings(self.rows.cls[window])
            orders = [np.argsort(k) for k in keys]
            self.dealt[lo, hi] = [(k[o], window[o]) for k, o in zip(keys, orders)]
        return self.dealt[lo, hi]

    def meet(self, query: np.ndarray, cls: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(query, window, whether of a large interval) in blocks: all windows of small intervals, those of the query's cells of large ones."""
        large = hi - lo > FULL
        few = np.flatnonzero(~large)
        upto = np.cumsum(hi[few] - lo[few])
        cuts = np.unique(np.r_[np.searchsorted(upto, np.arange(AT_ONCE, upto[-1], AT_ONCE)), len(few)]) if len(few) else []
        for begin, end in zip([0, *cuts[:-1]], cuts):
            i, place = _ranges(lo[few[begin:end]], hi[few[begin:end]])
            yield query[few[begin + i]], self.index.located(place), False
        many = np.flatnonzero(large)
        many = many[np.lexsort((hi[many], lo[many]))]
        turn = np.flatnonzero(np.r_[True, (lo[many][1:] != lo[many][:-1]) | (hi[many][1:] != hi[many][:-1])][: len(many)])
        for begin, end in zip(turn, [*turn[1:], len(many)]):
            q = query[many[begin:end]]
            for mine, (key, window) in zip(dealings(cls[q]), self.cells(int(lo[many[begin]]), int(hi[many[begin]]))):
                level = np.uint64(64 - max(1, int(np.ceil(np.log2(max(2, len(key) / FULL))))))
                cell = mine >> level
                first, past = np.searchsorted(key >> level, cell), np.searchsorted(key >> level, cell, side="right")
                for k in range(0, len(q), AT_ONCE // (8 * FULL)):
                    i, at = _ranges(first[k : k + AT_ONCE // (8 * FULL)], past[k : k + AT_ONCE // (8 * FULL)])
                    yield q[k + i], window[at], True


def dealings(cls: np.ndarray) -> list[np.ndarray]:
    """Two keys by which classes are dealt into cells."""
    return [mix64(cls.view(np.uint64)), mix64(cls.view(np.uint64) ^ np.uint64(0x1F83D9ABFB41BD6B))]


def candidate_pairs(routed: DataFrame, partitions: int, threshold: float) -> DataFrame:
    """(a, b, part): train and held-out classes with a common window whose sketches allow the threshold.

    A window that stands in more than FULL held-out windows meets those of its own cells only (``part``); the groups so linked
    are compared whole afterwards.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        shards: list[HeldShard] | None = None

        def close() -> list[HeldShard]:
            if not kept:
                return []
            sym, cls, count = (np.concatenate(x) for x in list(zip(*kept))[:3])
            drawn = pa.concat_arrays([x[3] for x in kept])
            kept.clear()
            step = SHARD_WINDOWS
            return [HeldShard(sym[i : i + step], cls[i : i + step], count[i : i + step], drawn.slice(i, step)) for i in range(0, len(sym), step)]

        for batch in batches:
            what, cls, sym, drawn = batch.column(1).to_numpy(), batch.column(2).to_numpy(), _symbols(batch.column(3)), batch.column(4)
            train = what >> 62 == 1
            held = ~train
            count = what & ((1 << 30) - 1)
            if held.any():
                kept.append((sym[held], cls[held], count[held], drawn.filter(pa.array(held))))
            if not train.any():
                continue
            if shards is None:
                shards = close()
            least = np.where((what[train] >> 60) & 1, SHORT_MATCH, LEAST_MATCH)
            sym, mine = sym[train], Sketched(cls[train], count[train], drawn.filter(pa.array(train)))
            for shard in shards:
                q, lo, hi, _ = shard.index.matches(sym, least, maximal=False)
                for i, w, part in shard.meet(q, mine.cls, lo, hi):
                    ok = mine.near(i, shard.rows, w, threshold)
                    a, b = mine.cls[i[ok]], shard.rows.cls[w[ok]]
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.full(int(new.sum()), part))], names=["a", "b", "part"])

    met = routed.repartition(partitions, "route").sortWithinPartitions("what").mapInArrow(search, "a long, b long, part boolean")
    return met.groupBy("a", "b").agg(F.max("part").alias("part"))


def sides(spark, sf_dir: str) -> DataFrame:
    """(k, held, split, source, question): samples of train, eval and test; other and null splits, null ids and blank questions are left out."""
    rows = read_table(spark, sf_dir, "split_rows")
    split = F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", ""))
    rows = rows.select(F.col("sample_id").alias("k"), split.alias("split"), "source", "question")
    return rows.where(F.col("split").isin("train", "eval", "test") & F.col("k").isNotNull() & F.col("question").isNotNull()).withColumn("held", F.col("split") != "train")


def indexed_links(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): train and held-out classes that reach the threshold, as far as they meet in the index."""
    spark = texts.sparkSession
    bits = int(np.clip(np.ceil(np.log2(max(1, texts.count()) / 6000)), SLOT_BITS, 20))  # few windows a slot, hot ones aside
    parts, total = shard_sizes(texts, bits)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * SHARD_WINDOWS)))
    pairs = written(candidate_pairs(routed_windows(texts, parts), partitions, threshold), "p3-pairs")
    some = written(verified(pairs, texts.groupBy("cls").agg(F.min("norm").alias("norm")), threshold), "p3-near")
    near = some.select("a", "b")
    groups = unfinished(near, some.join(pairs.where("part").select("a", "b"), ["a", "b"], "left_semi"), threshold)
    if groups is not None:
        near = near.unionByName(group_pairs(groups, texts, threshold, sides=True).select("a", "b")).distinct()
    return near


def overlaps(spark, sf_dir: str, threshold: float = THRESHOLD, *, whole: bool = True) -> DataFrame:
    """(train, held, exact): pairs of a train and a held-out sample with the same or nearly the same question.

    All pairs of the two sides are compared (:mod:`.complete`); without ``whole`` those that meet in the index, which is cheaper
    for large tables and leaves some out.
    """
    from .complete import COUNTED, MANY, all_candidates, frequencies

    rows = sides(spark, sf_dir)
    texts = written(side_texts(rows.select("held", "question")), "p3-texts")
    if whole:
        n = texts.count()
        some = texts.where(F.pmod(F.xxhash64("cls"), F.lit(max(1, n // COUNTED))) == 0)
        share = frequencies(some) if n > MANY else None
        pairs = written(all_candidates(texts, threshold, sides=True, share=share), "p3-pairs")
        near = verified(pairs, texts.groupBy("cls").agg(F.min("norm").alias("norm")), threshold).select("a", "b")
    else:
        near = indexed_links(texts, threshold)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cp, off = joined_letters(part.column(2))
                keep = pa.array(np.flatnonzero(np.diff(off) >= 3))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(text_hashes(cp, off)).take(keep)], names=["k", "held", "cls"])

    own = rows.select(F.col("k").cast("long").alias("k"), "held", "question").mapInArrow(ids, "k long, held boolean, cls long").dropDuplicates(["k", "cls"])
    train = own.where("NOT held").select(F.col("k").alias("train"), F.col("cls").alias("a"))
    held = own.where("held").select(F.col("k").alias("held"), F.col("cls").alias("b"))
    close = near.join(train, "a").join(held, "b").select("train", "held", F.lit(False).alias("exact"))
    same = train.join(held, F.col("a") == F.col("b")).select("train", "held", F.lit(True).alias("exact"))
    return close.unionByName(same)


def p3_found(spark, sf_dir: str) -> DataFrame:
    """(sample_id_a, sample_id_b): smaller id first, one in train, the other held out, similarity of questions 0.6 or more."""
    return overlaps(spark, sf_dir).select(F.least("train", "held").alias("sample_id_a"), F.greatest("train", "held").alias("sample_id_b"))


def p3_report(spark, sf_dir: str) -> DataFrame:
    """(split, source, samples, overlapping, exact_overlapping): held-out samples per split and source, and how many also stand in train."""
    hits = overlaps(spark, sf_dir).groupBy("held").agg(F.max(F.col("exact").cast("int")).alias("exact"))
    rows = read_table(spark, sf_dir, "split_rows")
    split = F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", ""))
    base = rows.select("sample_id", split.alias("split"), "source").where(F.col("split").isin("eval", "test") & F.col("sample_id").isNotNull()).dropDuplicates(["sample_id"])
    return base.join(hits, base["sample_id"] == hits["held"], "left").groupBy("split", "source").agg(F.count("*").alias("samples"), F.count("held").alias("overlapping"), F.coalesce(F.sum("exact"), F.lit(0)).cast("long").alias("exact_overlapping"))
