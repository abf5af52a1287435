"""Exact-size random splits, schedules and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def cut_points(df: DataFrame, key: str, seeds: list[int], share: float) -> dict[int, str]:
    """For each seed the rank up to which rows belong to the ceiling of n * share smallest ones; ``key`` must be unique.

    Ranks are counted by their first three digits, then, in the range in which the size ends, by the next three; the few ranks
    of that last range reach the driver (one in 16 million of all rows a seed), nothing is ever ordered as a whole.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), T.hash_rank(s, F.col(key)).alias("h")) for i, s in enumerate(seeds)]))
    ranks = df.select(pairs.alias("x")).select("x.i", "x.h")
    head, left = [""] * len(seeds), [0] * len(seeds)
    for digits in (3, 6):
        inside = ranks if digits == 3 else ranks.where(F.substring("h", 1, 3) == F.element_at(F.array(*[F.lit(x) for x in head]), F.col("i") + 1))
        counts: list[list[tuple[str, int]]] = [[] for _ in seeds]
        for r in inside.groupBy("i", F.substring("h", 1, digits).alias("b")).count().collect():
            counts[r["i"]].append((r["b"], r["count"]))
        for i, got in enumerate(counts):
            if digits == 3:
                left[i] = -int(-(sum(n for _, n in got) * share) // 1)
            for b, n in sorted(got):
                head[i] = b
                if n >= left[i]:
                    break
                left[i] -= n
    last = ranks.where(F.substring("h", 1, 6) == F.element_at(F.array(*[F.lit(x) for x in head]), F.col("i") + 1))
    found: dict[int, list[str]] = {}
    for r in last.collect():
        found.setdefault(r["i"], []).append(r["h"])
    return {s: sorted(found[i])[left[i] - 1] if found.get(i) and left[i] > 0 else "" for i, s in enumerate(seeds)}


def test_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: the ceiling of n * share rows are ``test``, the rest ``train_eval``; share 0 leaves none, 1 all.

    The result is a projection: rows up to a cut point of their hashed rank.
    """
    cut = cut_points(df, key, [seed], share)[seed]
    return df.withColumn("split", F.when(T.hash_rank(seed, F.col(key)) <= cut, "test").otherwise("train_eval"))


def resplits(pool: DataFrame, key: str, eval_share: float, split_ids: list[int], seed: int = 42) -> DataFrame:
    """The pool once for each split_id, with split_id and ``part``: eval or train, drawn anew for each.

    ``eval_share`` is eval over train plus eval. All cut points come from the same passes.
    """
    cuts = cut_points(pool, key, [seed + i for i in split_ids], eval_share)
    parts = F.array(*[F.struct(F.lit(i).alias("split_id"), F.when(T.hash_rank(seed + i, F.col(key)) <= cuts[seed + i], "eval").otherwise("train").alias("part")) for i in split_ids])
    return pool.withColumn("__x", F.explode(parts)).select(*pool.columns, "__x.split_id", "__x.part")


def test_epochs(interval: Column, epochs: Column) -> Column:
    """Every interval-th epoch and the last; the last alone for interval 0."""
    steps = F.filter(F.sequence(F.lit(1), epochs), lambda e: F.pmod(e, F.greatest(interval, F.lit(1))) == 0)
    return F.when(interval == 0, F.array(epochs)).otherwise(F.array_union(steps, F.array(epochs)))


#: Rows wanted of each type from the sections together, and from the whole text.
PER_SECTION = {"定义解释类": 100, "逻辑推理类": 300, "定义关系类": 200, "实际应用类": 100}
WHOLE = {"定义解释类": 100, "逻辑推理类": 50, "定义关系类": 100, "实际应用类": 50}


def quota_plan(sections: DataFrame, file: str) -> DataFrame:
    """(file, section_no, type, n): whole parts of the totals per section; section_no -1 stands for the whole text."""
    per = sections.groupBy(file).agg(F.count("section_no").alias("k"))
    plan = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(n).alias("total"), F.lit(w).alias("whole")) for (t, n), w in zip(PER_SECTION.items(), WHOLE.values())]))
    quota = per.select(file, "k", plan.alias("x"))
    each = sections.select(file, "section_no").join(quota, file).select(file, "section_no", F.col("x.type").alias("type"), F.floor(F.col("x.total") / F.col("k")).cast("int").alias("n"))
    return each.unionByName(quota.select(file, F.lit(-1).alias("section_no"), F.col("x.type").alias("type"), F.col("x.whole").alias("n")))


def asked(sections: DataFrame, file: str) -> DataFrame:
    """(file, section_no, type, n, prompt): the quota plan without quotas of 0, each with its prompt.

    The prompt names the type and holds the section, or for section_no -1 all sections of the file in order.
    """
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "section"))), lambda x: x["section"]), "\n")
    texts = sections.select(file, "section_no", "section").unionByName(sections.groupBy(file).agg(whole.alias("section")).select(file, F.lit(-1).alias("section_no"), "section"))
    plan = quota_plan(sections.drop("section"), file).where("n > 0")
    return plan.join(texts, [file, "section_no"]).select(file, "section_no", "type", "n", F.concat_ws("\n", "type", "section").alias("prompt"))


def augmented(df: DataFrame, copies: int) -> DataFrame:
    """Each row ``copies`` times with ``copy_no``; 0 is the original, the others await a paraphrase."""
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
