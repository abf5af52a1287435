"""Sinks: JSONL, CSV tables with byte-order mark, scalar series, logs, snapshots and replaced folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import replace


def write_jsonl(df: DataFrame, path: str, *, by: str | None = None) -> None:
    """JSON lines in UTF-8; one folder per value of ``by``."""
    w = df.write.mode("overwrite").option("ignoreNullFields", False)
    (w.partitionBy(by) if by else w).json(path)


def write_filtered(df: DataFrame, path: str) -> None:
    """Question and answer alone, ordered by type and row, in range-partitioned files whose names keep the order."""
    df.orderBy("type", "row_id").select("question", "answer").write.mode("overwrite").json(path)


def write_scored(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV for spreadsheet programs: the first header carries the byte-order mark. For small report tables."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def scalar_series(df: DataFrame, step: str, prefix: str) -> DataFrame:
    """(step, tag, value): numeric metrics of each row as a series; flags, texts and the step itself are left out."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    cols = [c for c, k in df.dtypes if c != step and (k in kinds or k.startswith("decimal"))]
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{prefix}/{c}").alias("tag"), F.col(c).cast("double").alias("value")) for c in cols]))
    return df.select(F.col(step).cast("long").alias("step"), pairs.alias("x")).select("step", "x.tag", "x.value").where(F.col("value").isNotNull())


# The columns of the two similarity reports.
DETAIL = ["dataset", "file", "sample_no", "line_no_a", "line_no_b", "type_a", "type_b", "cosine_similarity", "question_a", "question_b"]
SUMMARY = ["dataset", "file", "valid_qa_count", "skipped_line_count", "sampled_pair_count", "mean", "std", "min", "p25", "median", "p75", "max"]


def detail_rows(pairs: DataFrame, rows: DataFrame, *, by: list[str]) -> DataFrame:
    """The detail report: each sampled pair (by, i, j, cosine_similarity) with both rows (by, no, line_no, type, question), numbered from 1 in a file."""
    from pyspark.sql import Window as W

    side = lambda n, s: rows.select(*by, F.col("no").alias(n), F.col("line_no").alias(f"line_no_{s}"), F.col("type").alias(f"type_{s}"), F.col("question").alias(f"question_{s}"))
    out = pairs.join(side("i", "a"), [*by, "i"]).join(side("j", "b"), [*by, "j"])
    return out.withColumn("sample_no", F.row_number().over(W.partitionBy(*by).orderBy("i", "j"))).select(*DETAIL)


def summary_rows(pairs: DataFrame, counts: DataFrame, *, by: list[str]) -> DataFrame:
    """The summary report: counts (by, valid, skipped) with the statistics of the sampled similarities, as texts of eight places; zeros where there are none."""
    from ..functions.text import fixed8

    q = F.percentile("cosine_similarity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = pairs.withColumn("cosine_similarity", F.col("cosine_similarity").cast("double")).groupBy(*by).agg(F.count("*").alias("n"), F.avg("cosine_similarity").alias("mean"), F.stddev_pop("cosine_similarity").alias("std"), F.min("cosine_similarity").alias("min"), q.alias("q"), F.max("cosine_similarity").alias("max"))
    value = {"p25": F.get("q", F.lit(0)), "median": F.get("q", F.lit(1)), "p75": F.get("q", F.lit(2))}
    shown = [fixed8(F.coalesce(value.get(c, F.col(c)), F.lit(0.0))).alias(c) for c in SUMMARY[5:]]
    return counts.join(stats, by, "left").select(*by, F.col("valid").alias("valid_qa_count"), F.col("skipped").alias("skipped_line_count"), F.coalesce("n", F.lit(0).cast("long")).alias("sampled_pair_count"), *shown).select(*SUMMARY)


def block_text(value: Any, title: str | None = None, depth: int = 1) -> str:
    """Nested mappings and lists as indented lines under a title; a plain value stands behind it."""
    nested = lambda x: isinstance(x, (Mapping, list, tuple)) or (isinstance(x, Sequence) and not isinstance(x, (str, bytes, bytearray)))
    if not nested(value):
        return f"{title}: {value}" if title else str(value)
    lines = [title or ("dict" if isinstance(value, Mapping) else "list")]
    pad = "  " * depth
    for head, x in ((f"{k}:", v) for k, v in value.items()) if isinstance(value, Mapping) else (("-", v) for v in value):
        lines.append(block_text(x, pad + head, depth + 1) if nested(x) else f"{pad}{head} {x}")
    return "\n".join(lines)


def append_log(path: str, value: Any, title: str | None = None) -> None:
    """Adds a value to a log of the driver."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(block_text(value, title) + "\n")


def snapshot(config: Mapping, path: str) -> None:
    """The configuration as YAML, keys in their order."""
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(dict(config), f, sort_keys=False, allow_unicode=True)


def write_replacing(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Puts a table in the place of an older one only once it is written whole; a failed write leaves the old one."""
    import uuid

    new = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.format(kind).save(new)
    replace(df.sparkSession, new, path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics of test epochs as JSON, values to six places."""
    kinds = dict(metrics.dtypes)
    metrics.select(*[F.round(c, 6).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in metrics.columns]).write.mode("append").json(path)


def bars(table: DataFrame, label: str, count: str, percentage: str) -> DataFrame:
    """(line): a console table's rows with a bar of one block for every two per cent."""
    return table.select(F.concat_ws("  ", F.rpad(F.col(label).cast("string"), 12, " "), F.lpad(F.col(count).cast("string"), 10, " "), F.format_string("%6.2f%%", F.col(percentage).cast("double")), F.repeat(F.lit("█"), F.floor(F.col(percentage) / 2).cast("int"))).alias("line"))
