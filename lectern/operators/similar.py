"""Pairwise similarity and order-preserving greedy de-duplication."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

BLOCK = 2000
#: Rows of a group that the greedy scan takes at first, rows and kept rows that one task compares, and rows that one task scans in order.
FIRST, ROWS, KEPT, SCAN = 4000, 8000, 16_000, 40_000


def _rows(df: DataFrame, key: str, group: str, vector: str, threshold: float | str | None) -> DataFrame:
    """(g, k, v, t): rows that take part, with their group's threshold."""
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    return df.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), limit.cast("double").alias("t"))


def _blocks(df: DataFrame, key: str, group: str, vector: str, threshold: float | str | None, block: int) -> DataFrame:
    """(g, x, y, b, k, v, t): rows of a group dealt by hash into blocks; a row of block b stands at every block pair (x, y) it is part of."""
    rows = _rows(df, key, group, vector, threshold)
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("__b"))
    placed = rows.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("k"), F.col("__b")).cast("int"))
    # a row of block b takes part in the block pairs (b, c) and (c, b), named by the smaller block first
    to = placed.select("g", "k", "v", "t", "b", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)).alias("c"))
    return to.select("g", F.least("b", "c").alias("x"), F.greatest("b", "c").alias("y"), "b", "k", "v", "t")


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy())
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.where(n < 1e-10, 0.0, m / np.where(n < 1e-10, 1.0, n))


def _product(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cosines of one block pair, which of them stand for a pair of the result (each pair once), and the keys of both sides."""
    x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
    m = _units(pdf["v"])
    k, b = pdf["k"].to_numpy(), pdf["b"].to_numpy()
    left, right = np.flatnonzero(b == x), np.flatnonzero(b == y)
    s = m[left] @ m[right].T
    once = k[left][:, None] < k[right][None, :] if x == y else np.ones_like(s, bool)
    return s, once, k[left], k[right]


def similar_pairs(df: DataFrame, key: str, group: str, vector: str, threshold: float | str | None = None, *, block: int = BLOCK) -> DataFrame:
    """(group, i, j, sim), i < j in the key's order: pairs of a group whose cosine exceeds the threshold (all pairs without one).

    The threshold is one number, or the name of a column that holds its group's. Rows of a group are dealt by hash into blocks of about ``block`` rows; each pair of blocks is one task's matrix product,
    so no task holds more than two blocks and a hot group spreads over many. Null vectors are left out, zero ones have
    similarity 0. Exact: every pair of the group is compared.
    """
    kind = df.schema[group].dataType.simpleString()

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        s, ok, left, right = _product(pdf)
        i, j = np.nonzero(ok & (s > pdf["t"].iloc[0]) if threshold is not None else ok)
        a, c = left[i], right[j]
        return pd.DataFrame({"g": pdf["g"].iloc[0], "i": np.minimum(a, c), "j": np.maximum(a, c), "sim": s[i, j]})

    return _blocks(df, key, group, vector, threshold, block).groupBy("g", "x", "y").applyInPandas(pairs, f"g {kind}, i long, j long, sim double").withColumnRenamed("g", group)


def share_above(df: DataFrame, key: str, group: str, vector: str, threshold: float, *, block: int = BLOCK) -> DataFrame:
    """(group, share, pairs): the share of a group's pairs whose cosine exceeds the threshold; block pairs are counted where they are multiplied."""
    kind = df.schema[group].dataType.simpleString()

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        s, ok, _, _ = _product(pdf)
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "above": [int((ok & (s > threshold)).sum())], "pairs": [int(ok.sum())]})

    parts = _blocks(df, key, group, vector, threshold, block).groupBy("g", "x", "y").applyInPandas(counted, f"g {kind}, above long, pairs long")
    return parts.groupBy(F.col("g").alias(group)).agg(F.sum("above").alias("above"), F.sum("pairs").alias("pairs")).where("pairs > 0").select(group, (F.col("above") / F.col("pairs")).alias("share"), "pairs")


def greedy_rounds(edges: DataFrame) -> DataFrame:
    """(node, removed): the outcome of scanning nodes in order, each kept node removing its later neighbours.

    ``edges`` holds (i, j), i before j. A node with an earlier kept neighbour is removed; one whose earlier neighbours are all
    removed is kept. Each round settles every node that can be settled, by one partially aggregated shuffle over the edges,
    and is written to the shared folder. The number of rounds is the longest chain of decisions, not the number of rows.
    """
    edges = written(edges.select("i", "j").distinct(), "greedy-edges")
    nodes = edges.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    late = edges.select(F.col("j").alias("node")).distinct().withColumn("__l", F.lit(True))
    state = written(nodes.join(late, "node", "left").select("node", F.when(F.col("__l"), F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("removed")), "greedy-state")
    while not state.where("removed IS NULL").isEmpty():
        told = edges.join(state.select(F.col("node").alias("i"), "removed"), "i").groupBy(F.col("j").alias("node")).agg(F.max(F.coalesce(~F.col("removed"), F.lit(False))).alias("hit"), F.max(F.col("removed").isNull()).alias("open"))
        state = written(state.join(told, "node", "left").select("node", F.coalesce("removed", F.when(F.col("hit"), True).when(~F.col("open"), False)).alias("removed")), "greedy-state", instead_of=state)
    return state


def _against(rows: DataFrame, kept: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` of every block of rows and block of kept rows (``own``) of a group; ``blocks`` tells how many kept blocks a row meets."""
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("__n")).join(kept.groupBy("g").agg(F.ceil(F.count("*") / KEPT).cast("int").alias("blocks")), "g")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    new = rows.join(sizes, "g").select("g", "k", "v", "t", F.lit(False).alias("own"), one_of("__n").alias("x"), all_of("blocks").alias("y"), "blocks")
    old = kept.join(sizes, "g").select("g", "k", "v", "t", F.lit(True).alias("own"), all_of("__n").alias("x"), one_of("blocks").alias("y"), "blocks")
    # the rows are few and their comparison is long, so tasks are not merged by size
    spread = new.unionByName(old).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "x", "y")
    return spread.groupBy("g", "x", "y").applyInPandas(fn, schema)


def _surviving(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block that no kept row of the other block removes."""
    old = pdf["own"].to_numpy(bool)
    new, m, t = pdf[~old], _units(pdf["v"]), pdf["t"].iloc[0]
    left, right = m[~old], m[old].T
    alive = np.ones(len(left), bool)
    for i in range(0, len(left), 500):
        alive[i : i + 500] = ~(left[i : i + 500] @ right > t).any(axis=1) if right.shape[1] else True
    return new.loc[alive, ["g", "k", "v", "t", "blocks"]]


def _scanned(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a group that a scan in order keeps."""
    pdf = pdf.sort_values("k", ignore_index=True)
    m, t, n = _units(pdf["v"]), pdf["t"].iloc[0], 0
    kept, alive = np.empty_like(m), np.ones(len(m), bool)
    for i in range(0, len(m), 500):
        part = m[i : i + 500]
        own = alive[i : i + 500]
        if n:
            own &= ~(part @ kept[:n].T > t).any(axis=1)
        near = np.triu(part @ part.T > t, 1)
        for x in range(len(part)):
            if own[x]:
                own &= ~near[x]
        some = part[own]
        kept[n : n + len(some)] = some
        n += len(some)
    return pdf.loc[alive, ["g", "k", "v", "t"]]


def greedy_dedup(df: DataFrame, key: str, group: str, vector: str, threshold: float | str, *, first: int = FIRST, scan: int = SCAN) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed pairs (j, i, sim)): each removed row with the first kept neighbour that removed it.

    A group's rows are taken in order in portions, about ``first`` rows and then as many as there were before. A portion's rows
    meet the kept ones of the portions before, block by block, and what is left is scanned: in one task up to ``scan`` rows, else
    by rounds over its similar pairs. So no list of all similar pairs is made, which grows with the square of a group of
    near-duplicates; rows are compared with kept rows only. Equal to the sequential scan.
    """
    kind = df.schema[group].dataType.simpleString()
    rows = _rows(df, key, group, vector, threshold)
    # any cut in the key's order serves, so approximate quantiles (1/2, 1/4, ...) do
    halves = F.array(*[F.lit(0.5**j) for j in range(1, 21)])
    sizes = rows.groupBy("g").agg(F.least(F.lit(20), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / first)))).cast("int").alias("__j"), F.percentile_approx("k", halves, 10_000).alias("__q"))
    portion = F.col("__j") - F.size(F.filter(F.slice("__q", F.lit(1), F.col("__j")), lambda x: F.col("k") <= x))
    dealt = written(rows.join(sizes, "g").select("g", "k", "v", "t", portion.alias("portion")).sortWithinPartitions("portion"), "greedy-rows")
    shape = f"g {kind}, k long, v array<double>, t double"
    kept = None
    for p in range((dealt.agg(F.max("portion")).first()[0] or 0) + 1):
        left = dealt.where(F.col("portion") == p).select("g", "k", "v", "t")
        if kept is not None:
            alive = _against(left, kept, _surviving, shape + ", blocks int")
            left = written(alive.groupBy("g", "k").agg(F.first("v").alias("v"), F.first("t").alias("t"), F.count("*").alias("n"), F.first("blocks").alias("blocks")).where("n = blocks").select("g", "k", "v", "t"), "greedy-left")
        large = left.groupBy("g").count().where(F.col("count") > scan).select("g")
        if large.isEmpty():
            new = left.groupBy("g").applyInPandas(_scanned, shape)
        else:
            hot = left.join(large, "g", "left_semi")
            gone = greedy_rounds(similar_pairs(hot, "k", "g", "v", "t")).where("removed").select(F.col("node").alias("k"))
            new = left.join(large, "g", "left_anti").groupBy("g").applyInPandas(_scanned, shape).unionByName(hot.join(gone, "k", "left_anti").select("g", "k", "v", "t"))
        new = written(new, "greedy-kept")
        kept = new if kept is None else kept.unionByName(new)
    gone = dealt.select("g", "k", "v", "t").join(kept.select("k"), "k", "left_anti")

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        old = pdf["own"].to_numpy(bool)
        m, k, t = _units(pdf["v"]), pdf["k"].to_numpy(), pdf["t"].iloc[0]
        order = np.flatnonzero(old)[np.argsort(k[old])]
        out, new = [], np.flatnonzero(~old)
        for i in range(0, len(new), 500):
            part = new[i : i + 500]
            s = m[part] @ m[order].T
            hit = (s > t) & (k[order][None, :] < k[part][:, None])
            if not len(order):
                continue
            at, some = hit.argmax(axis=1), hit.any(axis=1)
            out.append(pd.DataFrame({"j": k[part[some]], "i": k[order[at[some]]], "sim": s[np.flatnonzero(some), at[some]]}))
        return pd.concat(out) if out else pd.DataFrame({"j": np.zeros(0, np.int64), "i": np.zeros(0, np.int64), "sim": np.zeros(0)})

    pairs = _against(gone, kept, nearest, "j long, i long, sim double").groupBy("j").agg(F.min(F.struct("i", "sim")).alias("x")).select("j", "x.i", "x.sim")
    return df.join(gone.select(F.col("k").alias(key)), key, "left_anti"), pairs


def sampled_pairs(df: DataFrame, key: str, group: str, size: int, seed: int) -> DataFrame:
    """(group, i, j): ``size`` different unordered pairs of each group's rows by their running numbers from 1, sorted; all pairs where there are no more.

    Pair numbers are drawn, not pairs listed: draws are md5 values of seed, group and number of the draw, spread over the
    n(n-1)/2 pair numbers, of which the first distinct ones are taken, so the work follows the sample, not the square of the
    group. Groups of up to twice the sample's pairs order all their pair numbers by such a value.
    """
    from pyspark.sql import Window as W

    counts = df.groupBy(group).agg(F.count("*").cast("long").alias("n"))
    total = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    drawn = lambda no: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col(no).cast("string")))
    few = counts.where((total <= 2 * size) & (total > 0)).select(group, "n", F.explode(F.sequence(F.lit(1).cast("long"), total)).alias("p")).withColumn("r", drawn("p"))
    many = counts.where(total > 2 * size).select(group, "n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3 * size + 20).cast("long"))).alias("t")).withColumn("r", drawn("t"))
    many = many.select(group, "n", (F.pmod(F.conv(F.substring("r", 1, 15), 16, 10).cast("long"), total) + 1).alias("p"), "r")
    first = few.unionByName(many).groupBy(group, "n", "p").agg(F.min("r").alias("r"))
    taken = first.withColumn("k", F.row_number().over(W.partitionBy(group).orderBy("r", "p"))).where(F.col("k") <= size)
    # pair number p (from 1) counts the pairs (i, j), i < j, by j and then i
    j = (F.floor((F.sqrt(8 * F.col("p").cast("double") - 7) + 1) / 2) + 1).cast("long")
    j = F.when((j - 1) * (j - 2) / 2 >= F.col("p"), j - 1).when(j * (j - 1) / 2 < F.col("p"), j + 1).otherwise(j)
    at = taken.withColumn("j", j)
    return at.select(group, (F.col("p") - ((F.col("j") - 1) * (F.col("j") - 2) / 2).cast("long")).cast("long").alias("i"), "j")


def rows_used(df: DataFrame, pairs: DataFrame, number: str, group: str) -> DataFrame:
    """The rows that some pair names: a semi-join ahead of an expensive function."""
    used = pairs.select(group, F.explode(F.array("i", "j")).alias(number)).distinct()
    return df.join(used, [group, number], "left_semi")
