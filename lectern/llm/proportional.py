"""Problem 4: a sample whose category shares match given targets.

Counts per category are aggregated first (a handful of rows), integer quotas come from the largest-remainder rule with
floors and availability caps, and the rows with the smallest random keys of each category are taken by a threshold on the
key, so no category is ever ordered as a whole in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table


@dataclass(frozen=True)
class Quota:
    category: str
    available: int
    target: float
    floor: int
    quota: int

    @property
    def shortfall(self) -> float:
        return max(0.0, self.target - self.available)


def largest_remainder(shares: dict[str, float], floors: dict[str, int], available: dict[str, int], size: int, exact_size: float | None = None) -> dict[str, Quota]:
    """Integer quotas that sum to ``size`` where availability allows.

    Every category first gets ``min(floor, available)``; what is left goes out in proportion to the unmet ideal shares by
    largest remainder, capped by availability; what caps give back is dealt again. Ties fall to the smaller name. Negative
    or null shares count as 0; size 0 gives the floors. Targets are told against ``exact_size`` where the size was rounded.
    """
    names = sorted(shares)
    ideal = {c: max(0.0, shares[c] or 0.0) * size for c in names}
    got = {c: min(max(0, floors.get(c) or 0), available.get(c, 0)) for c in names}
    while (left := size - sum(got.values())) > 0:
        room = [c for c in names if got[c] < available.get(c, 0) and ideal[c] > 0]
        if not room:
            break
        want = {c: max(0.0, ideal[c] - got[c]) for c in room}
        weight = want if sum(want.values()) > 1e-9 else {c: ideal[c] for c in room}
        total = sum(weight.values())
        exact = {c: left * weight[c] / total for c in room}
        whole = {c: int(exact[c]) for c in room}
        spare = left - sum(whole.values())
        for c in sorted(room, key=lambda c: (whole[c] - exact[c], c))[:spare]:
            whole[c] += 1
        for c in room:
            got[c] = min(available.get(c, 0), got[c] + whole[c])
    exact = size if exact_size is None else exact_size
    return {c: Quota(c, available.get(c, 0), max(0.0, shares[c] or 0.0) * exact, max(0, floors.get(c) or 0), got[c]) for c in names}


def bare(c: Column) -> Column:
    """A category name without blanks, brackets, counters and a closing suffix character of the class word."""
    c = F.regexp_replace(c, r"[（(]\s*\p{N}+\s*[)）]", "")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    return F.lower(F.regexp_replace(c, "类$", ""))


def meant_category(df: DataFrame, plan: DataFrame, category: str, *, max_edits: int = 1) -> DataFrame:
    """Adds ``category_meant``: the plan's spelling of a misspelt category, or null where none fits.

    Distinct raw spellings are matched, not rows. A spelling equal to a planned one after :func:`bare` wins; otherwise the
    one planned name within ``max_edits`` edits, if it is the only nearest. Null stays null.
    """
    names = sorted({r["type"] for r in plan.select("type").where(F.col("type").isNotNull()).collect()})  # a plan's few types
    raw = df.select(F.col(category).alias("__raw")).where(F.col("__raw").isNotNull()).groupBy("__raw").count()
    if names:
        b = bare(F.col("__raw"))
        near = []
        for n in names:
            p = bare(F.lit(n))
            d = F.levenshtein(b, p)
            near.append(F.when(d <= F.least(F.lit(max_edits), F.length(p) - 2), F.struct(d.alias("d"), F.lit(n).alias("name"))))
        fit = F.array_sort(F.array_compact(F.array(*near)))
        alone = (F.size("__fit") == 1) | (F.get("__fit", F.lit(0))["d"] < F.get("__fit", F.lit(1))["d"])
        only = raw.withColumn("__fit", fit).where((F.size("__fit") > 0) & alone).select("__raw", F.get("__fit", F.lit(0))["name"].alias("category_meant"))
    else:
        only = raw.select("__raw", F.lit(None).cast("string").alias("category_meant"))
    return df.join(only, df[category].eqNullSafe(only["__raw"]), "left").drop("__raw")


def quotas(counts: DataFrame, plan: DataFrame, size: float) -> list[Quota]:
    """Quotas from per-category counts: one row per planned category reaches the driver, no records."""
    rows = plan.select("type", "target_share", "min_rows").where(F.col("type").isNotNull()).groupBy("type").agg(F.max("target_share").alias("s"), F.max("min_rows").alias("m")).collect()
    have = {r["category_meant"]: r["n"] for r in counts.where(F.col("category_meant").isNotNull()).collect()}
    return list(largest_remainder({r["type"]: r["s"] for r in rows}, {r["type"]: r["m"] for r in rows}, have, round(size), size).values())


def draw(df: DataFrame, taken: list[Quota], key: str, *, seed: int = 42) -> DataFrame:
    """The ``quota`` rows of smallest random key in each category, exactly.

    The random key is a hash of seed and id. Keys are counted in 4,096 ranges per category (map-side partial counts); only
    the one range in which the quota ends is ranked, so a category with a third of all rows is never sorted in one task.
    """
    spark = df.sparkSession
    want = spark.createDataFrame([(q.category, q.quota) for q in taken], "category_meant string, quota long")
    keyed = df.withColumn("__k", F.xxhash64(F.lit(seed), F.col(key))).withColumn("__b", F.shiftrightunsigned("__k", 52))
    from pyspark.sql import Window as W

    per = keyed.groupBy("category_meant", "__b").agg(F.count("*").alias("__n"))
    w = W.partitionBy("category_meant").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    cut = per.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).join(F.broadcast(want), "category_meant").where("__before < quota").withColumn("__left", F.col("quota") - F.col("__before"))
    hit = keyed.join(cut.select("category_meant", "__b", "__n", "__left"), ["category_meant", "__b"])
    whole = hit.where("__n <= __left")
    split = hit.where("__n > __left").withColumn("__r", F.row_number().over(W.partitionBy("category_meant").orderBy("__k", key))).where("__r <= __left").drop("__r")
    return whole.unionByName(split).drop("__k", "__b", "__n", "__left")


def _prepared(spark, sf_dir, fraction: float):
    plan = read_table(spark, sf_dir, "type_plan")
    rows = read_table(spark, sf_dir, "qa_pairs").select("row_id", "type").where(F.col("row_id").isNotNull())
    rows = rows.groupBy("row_id").agg(F.min("type").alias("type"))
    typed = meant_category(rows, plan, "type")
    counts = typed.groupBy("category_meant").agg(F.count("*").alias("n"))
    found = counts.collect()
    size = fraction * sum(r["n"] for r in found)
    counts = spark.createDataFrame([(r["category_meant"], r["n"]) for r in found], "category_meant string, n long")
    return typed, quotas(counts, plan, size)


def p4_sample(spark, sf_dir: str, fraction: float = 0.2) -> DataFrame:
    """(row_id, type): the drawn sample. Records of null or unrecognised type are in no category; an empty table gives none."""
    typed, taken = _prepared(spark, sf_dir, fraction)
    return draw(typed, taken, "row_id").select("row_id", F.col("category_meant").alias("type"))


def p4_report(spark, sf_dir: str, fraction: float = 0.2) -> DataFrame:
    """(type, available, target, floor, quota, shortfall) for every planned type."""
    _, taken = _prepared(spark, sf_dir, fraction)
    return spark.createDataFrame([(q.category, q.available, float(q.target), q.floor, q.quota, float(q.shortfall)) for q in taken], "type string, available long, target double, floor int, quota long, shortfall double")


def p4_found(spark, sf_dir: str) -> DataFrame:
    """(type): planned types with fewer records than their target."""
    return p4_report(spark, sf_dir).where("shortfall > 0").select("type")
