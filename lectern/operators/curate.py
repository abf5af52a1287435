"""Validation, filters, thresholds, counts, histograms and summaries of question-answer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

QA_LOWER, QQ_UPPER, QUALIFIED = 0.5, 0.85, 3
CHAPTERS = [f"{i:02d}" for i in range(1, 11)]
ALL = "全部"


def once(df: DataFrame, key: str, drop: tuple[str, ...] = ("loaded_at",)) -> DataFrame:
    """One row per id: a repeated delivery differs in its load time alone."""
    return df.drop(*drop).where(F.col(key).isNotNull()).dropDuplicates([key])


def reason(question: Column, answer: Column) -> Column:
    """Why a pair is invalid, the first failure winning; null for a valid one."""
    return F.when(question.isNull(), "question is no text").when(T.is_blank(question), "question is blank").when(answer.isNull(), "answer is no text").when(T.is_blank(answer), "answer is blank")


def stripped(df: DataFrame) -> DataFrame:
    """type, question and answer without outer blanks; a null type becomes empty."""
    return df.withColumns({"type": T.strip(F.coalesce("type", F.lit(""))), "question": T.strip(F.col("question")), "answer": T.strip(F.col("answer"))})


def valid(df: DataFrame) -> DataFrame:
    return stripped(df.where(reason(F.col("question"), F.col("answer")).isNull()))


def length_filter(df: DataFrame, *, pair: int | None = None, question: int | None = None, answer: int | None = None) -> DataFrame:
    """Keeps rows within every given limit, limits included."""
    q, a = F.length("question"), F.length("answer")
    cond = F.lit(True)
    for limit, size in ((pair, F.greatest(q, a)), (question, q), (answer, a)):
        if limit is not None:
            if limit <= 0:
                raise ValueError("a limit must be positive")
            cond = cond & (size <= limit)
    return df.where(cond)


def with_thresholds(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds qa_lower and qq_upper of the row's type; defaults 0.5 and 0.85 where the type or the value is missing.

    ``thresholds`` holds one row per type and is joined as its size at run time allows.
    """
    t = thresholds.groupBy(F.col("type").alias("__type")).agg(F.max("qa_lower").alias("__lo"), F.max("qq_upper").alias("__up"))
    out = df.join(t, df["type"] == t["__type"], "left")
    return out.withColumns({"qa_lower": F.coalesce("__lo", F.lit(QA_LOWER)), "qq_upper": F.coalesce("__up", F.lit(QQ_UPPER))}).drop("__type", "__lo", "__up")


def relevant(df: DataFrame) -> DataFrame:
    return df.where(F.col("qa_sim") >= F.col("qa_lower"))


def scored(df: DataFrame) -> DataFrame:
    """Adds ``score``: 0 for a blank question or answer or an unparsable reply, else what the reply states."""
    blank = T.is_blank(F.col("question")) | T.is_blank(F.col("answer"))
    return df.withColumn("score", F.when(blank, 0).otherwise(F.coalesce(T.extract_score(F.col("reply")), F.lit(0))))


def score_split(df: DataFrame, least: int) -> DataFrame:
    """Adds ``kept``: score at least the threshold, a missing score counting as 0."""
    return df.withColumn("kept", F.coalesce("score", F.lit(0)) >= least)


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count("*").alias("n"))


def chapter_counts(df: DataFrame, chapters: list[str] | None = None) -> DataFrame:
    """(type, chapter, n) over a fixed domain of chapters, zero where there is none; other chapters are left out."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(c,) for c in (CHAPTERS if chapters is None else chapters)], "chapter string")
    grid = df.select("type").where("type <> ''").distinct().crossJoin(domain)  # types by ten chapters
    have = df.groupBy("type", F.col("_file").alias("chapter")).agg(F.count("*").alias("n"))
    return grid.join(have, ["type", "chapter"], "left").select("type", "chapter", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def bins005(value: Column) -> Column:
    """Number of the 0.05-wide bin of a value in 0 to 1, the last one closed; null outside. Bounds are the decimal literals."""
    out = F.when((value >= 0.95) & (value <= 1.0), 19)
    for i in range(19):
        out = out.when((value >= round(i * 0.05, 2)) & (value < round((i + 1) * 0.05, 2)), i)
    return out


def similarity_histogram(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, bin_no, interval, count, percentage): all 20 bins of each group; values outside count in the denominator only."""
    spark = df.sparkSession
    bounds = spark.createDataFrame([(i, f"{round(i * 0.05, 2):.2f} ~ {round((i + 1) * 0.05, 2):.2f}") for i in range(20)], "bin_no int, interval string")
    got = df.groupBy(by, bins005(F.col(value)).alias("bin_no")).agg(F.count(value).alias("n"))
    total = got.groupBy(by).agg(F.sum("n").alias("total"))
    have = got.where("bin_no IS NOT NULL")
    return total.crossJoin(bounds).join(have, [by, "bin_no"], "left").select(by, "bin_no", "interval", F.coalesce("n", F.lit(0).cast("long")).alias("count"), T.percent(F.coalesce("n", F.lit(0)), F.col("total")).alias("percentage"))


def length_histogram(df: DataFrame, length: str, by: str | None, *, width: int = 50, bins: int = 12, cap: int | None = None, overlap: bool = False) -> DataFrame:
    """(by, bin_no, interval, count, percentage) of lengths up to a cap and a tail that stands only if it is filled.

    The cap is the smaller of the largest length and ``width * bins`` (of all rows, so that groups share their bins) unless
    given. ``overlap`` keeps the last regular bin whole where the cap falls inside it, counting its rows in the tail too.
    """
    key = F.col(by) if by else F.lit(ALL)
    # rows are counted once per group and length; all else works on those counts, of which there are no more than lengths times groups
    rows = df.select(key.alias("g"), F.col(length).alias("v")).where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("n"))
    rows = rows.withColumn("cap", F.least(F.max("v").over(W.partitionBy()), F.lit(width * bins)) if cap is None else F.lit(cap))
    last = F.ceil(F.col("cap") / width).cast("int")
    inside = F.col("v") < (last * width if overlap else F.col("cap"))
    places = F.array_compact(F.array(F.when(inside, F.floor(F.col("v") / width).cast("int")), F.when(F.col("v") >= F.col("cap"), last)))
    # a row of the overlapping last bin also stands in the tail, and is told by the tail's own mark
    marked = rows.select("g", "cap", "v", "n", F.explode(places).alias("bin_no"))
    per = marked.groupBy("g", "cap", "bin_no").agg(F.sum("n").alias("n"))
    total = F.coalesce(F.sum(F.when(F.col("bin_no") < last, F.col("n"))), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("bin_no") == last, F.col("n"))), F.lit(0))
    if overlap:  # rows between cap and the last bin's end stand twice
        double = rows.groupBy("g").agg(F.sum(F.when(inside & (F.col("v") >= F.col("cap")), F.col("n")).otherwise(0)).alias("__twice"))
        per = per.join(double, "g")
        total = total - F.max("__twice")
    whole = per.groupBy("g", "cap").agg(F.map_from_entries(F.collect_list(F.struct("bin_no", "n"))).alias("m"), total.alias("total"))
    tail = F.element_at("m", last)
    numbers = F.when(F.col("cap") > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    numbers = F.when(tail.isNotNull(), F.concat(numbers, F.array(last))).otherwise(numbers)
    each = whole.select("g", "cap", "m", "total", F.explode(numbers).alias("bin_no"))
    n = F.coalesce(F.element_at("m", F.col("bin_no")), F.lit(0).cast("long"))
    label = F.when(F.col("bin_no") < last, F.concat((F.col("bin_no") * width).cast("string"), F.lit(" ~ "), (F.col("bin_no") * width + width).cast("string"))).otherwise(F.concat(F.lit(">= "), F.col("cap").cast("string")))
    return each.select(F.col("g").alias(by or "type"), "bin_no", label.alias("interval"), n.alias("count"), T.percent(n, F.col("total")).alias("percentage"))


def wide(hist: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Interval by group as columns, percentages to two places."""
    return hist.groupBy("bin_no", "interval").pivot(by, values).agg(F.round(F.first("percentage"), 2))


def largest_lengths(df: DataFrame, question: str, answer: str) -> DataFrame:
    """Largest question, answer and pair length per type and over all, in one rollup; the columns hold lengths."""
    q, a = F.col(question), F.col(answer)
    g = df.select("type", q.alias("q"), a.alias("a"), F.greatest(q, a).alias("p")).rollup("type")
    out = g.agg(F.max("q").alias("max_q"), F.max("a").alias("max_a"), F.max("p").alias("max_pair"), F.grouping_id().alias("__g"))
    return out.select(F.when(F.col("__g") == 1, ALL).otherwise(F.col("type")).alias("type"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("max_q", "max_a", "max_pair")])


def distinct_types(df: DataFrame) -> DataFrame:
    return df.select("type").where("type <> ''").distinct().orderBy("type")


def score_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("score", F.lit(0)).alias("score")).agg(F.count("*").alias("n"))


def score_table(df: DataFrame, qualified: int = QUALIFIED) -> DataFrame:
    """(score, n, percentage, qualified) by falling score; the shares come from a window over the few score rows."""
    d = score_distribution(df)
    total = F.sum("n").over(W.partitionBy())
    return d.select("score", "n", T.percent(F.col("n"), total).alias("percentage"), (F.col("score") >= qualified).alias("qualified")).orderBy(F.desc("score"))


def summary(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """mean, population deviation, min, quartiles by linear interpolation and max; zeros for no values."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.groupBy(*([by] if by else []))
    got = g.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), q.alias("__q"), F.max(value).alias("max"), F.count(value).alias("n"))
    zero = F.lit(0.0)
    return got.select(*([by] if by else []), "n", F.coalesce("mean", zero).alias("mean"), F.coalesce("std", zero).alias("std"), F.coalesce(F.col("min").cast("double"), zero).alias("min"), *[F.coalesce(F.col("__q")[i], zero).alias(c) for i, c in enumerate(("p25", "median", "p75"))], F.coalesce(F.col("max").cast("double"), zero).alias("max"))


def funnel(df: DataFrame, stages: list[tuple[str, Column]], *, distinct: tuple[str, Column] | None = None) -> DataFrame:
    """(stage_no, stage, n, retention, overall): rows left after each stage, in one pass.

    A stage is a condition that holds for the rows left after it; ``distinct`` names a last stage that counts the different
    values of a column among the rows left before.
    """
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_, c) in enumerate(stages)]
    names = [name for name, _ in stages]
    if distinct:
        counts.append(F.count_distinct(F.when(stages[-1][1], distinct[1])).alias(f"c{len(stages)}"))
        names.append(distinct[0])
    rows = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(x).alias("stage"), F.col(f"c{i}").alias("n"), F.col(f"c{max(0, i - 1)}").alias("p"), F.col("c0").alias("f")) for i, x in enumerate(names)])
    out = df.agg(*counts).select(F.explode(rows).alias("x"))
    return out.select("x.stage_no", "x.stage", "x.n", T.percent(F.col("x.n"), F.col("x.p")).alias("retention"), T.percent(F.col("x.n"), F.col("x.f")).alias("overall"))


def stage_counts(df: DataFrame, kept: Column) -> DataFrame:
    """(total, kept, removed) in one pass."""
    return df.agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(~F.coalesce(kept, F.lit(False))).alias("removed"))


def exact_duplicates(df: DataFrame, key: str, hash_: Column) -> DataFrame:
    """(hash, first key, copies) of every text that stands more than once; partial counts are made before the shuffle."""
    return df.groupBy(hash_.alias("hash")).agg(F.min(key).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
