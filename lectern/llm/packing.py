"""Problem 7: filling containers of fixed capacity by best-two-fit.

Items are dealt by hash into groups of a bounded number of items; each group is packed on its own, so at most one container
per group is left poorly filled. Inside a group items are known by their sizes (integers up to the capacity), kept as bit
masks, so the largest item that fits and the best pair for a gap are a few word operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .tokenizers import TOKENIZER_DIR, byte_bpe

CAPACITY, GROUP_ITEMS = 2048, 20_000


class Stock:
    """Unpacked items by size."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.mask, self.mirror = capacity, {}, 0, 0

    def add(self, size: int, item) -> None:
        self.items.setdefault(size, []).append(item)
        self.mask |= 1 << size
        self.mirror |= 1 << (self.capacity - size)

    def take(self, size: int):
        item = self.items[size].pop()
        if not self.items[size]:
            self.mask &= ~(1 << size)
            self.mirror &= ~(1 << (self.capacity - size))
        return item

    def largest(self, room: int) -> int:
        """The largest size of at most ``room``; 0 if there is none."""
        return (self.mask & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 and self.mask & ((1 << (room + 1)) - 1) else 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Sizes of two different items with exactly this sum."""
        shift = self.capacity - total
        both = self.mask & (self.mirror >> shift if shift >= 0 else self.mirror << -shift)
        while both:
            a = both.bit_length() - 1
            b = total - a
            if a != b or len(self.items[a]) > 1:
                return a, b
            both &= ~(1 << a)
        return None


def best_two_fit(items: list[tuple[int, object]], capacity: int) -> list[list[tuple[int, object]]]:
    """Containers as lists of (size, item); sizes must be within 1 to ``capacity``.

    Each container takes the largest item that fits until none does. Then its smallest item is put back if two unpacked
    items fill the widened gap more tightly than it did (the tightest such pair).
    """
    stock, bins = Stock(capacity), []
    for size, item in sorted(items, key=lambda x: (x[0], repr(x[1])), reverse=True):
        stock.add(size, item)
    while stock.mask:
        bin_, room = [], capacity
        while size := stock.largest(room):
            bin_.append((size, stock.take(size)))
            room -= size
        if room and len(bin_) > 1 and stock.mask:
            least = bin_[-1][0]
            for total in range(room + least, least, -1):
                if total <= 2 * capacity and (two := stock.pair(total)):
                    old = bin_.pop()
                    bin_ += [(s, stock.take(s)) for s in two]
                    stock.add(*old)
                    break
        bins.append(bin_)
    return bins


def token_counts(df: DataFrame, key: str, text: str, *, tokenizer: str = "byte_bpe_multi_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, n_tokens) of every non-empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer, folder).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int64())], names=["k", "n_tokens"])

    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    return docs.mapInArrow(run, "k long, n_tokens long").withColumnRenamed("k", key)


def pack(sizes: DataFrame, key: str, size: str, *, capacity: int = CAPACITY, groups: int = 1) -> DataFrame:
    """(container, key, piece_no, begin, n_tokens): every item whole in one container, items over the capacity in full pieces and a rest.

    ``container`` is a string unique over the result. Sizes of 0 or null are left out.
    """
    cap = F.lit(capacity).cast("long")
    items = sizes.where(F.col(size) > 0).select(F.col(key).alias("k"), F.col(size).cast("long").alias("n"))
    full = items.where(F.col("n") >= cap).select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / cap) - 1)).alias("p"))
    full = full.select(F.concat_ws("-", F.lit("w"), "k", "p").alias("container"), "k", (F.col("p") + 1).cast("int").alias("piece_no"), (F.col("p") * cap).alias("begin"), cap.alias("n_tokens"))
    rest = items.select("k", F.floor(F.col("n") / cap).alias("p"), (F.col("n") % cap).alias("r"), F.pmod(F.xxhash64("k"), F.lit(groups)).alias("g")).where("r > 0")

    def fill(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        where = list(zip(pdf["k"].tolist(), pdf["p"].tolist()))
        bins = best_two_fit([(int(n), i) for i, n in enumerate(pdf["r"].tolist())], capacity)
        rows = [(f"g-{key_[0]}-{b}", where[i][0], where[i][1] + 1, where[i][1] * capacity, n) for b, bin_ in enumerate(bins) for n, i in bin_]
        return pd.DataFrame(rows, columns=["container", "k", "piece_no", "begin", "n_tokens"])

    packed = rest.groupBy("g").applyInPandas(fill, "container string, k long, piece_no int, begin long, n_tokens long")
    return packed.unionByName(full).withColumnRenamed("k", key)


def p7_containers(spark, sf_dir: str) -> DataFrame:
    """(container, doc_id, piece_no, begin, n_tokens) over all documents, sized by byte_bpe_multi_50k."""
    from .common import written

    docs = read_table(spark, sf_dir, "documents")
    groups = max(1, -(-docs.count() // GROUP_ITEMS))
    return pack(written(token_counts(docs, "doc_id", "text"), "p7-sizes"), "doc_id", "n_tokens", groups=groups)
