"""Sources: JSONL with validation, Markdown sections, metrics, run folders, configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import exists

REASONS = ("not an object", "a key is missing", "question is no text", "answer is no text")


def _split_lines(spark: SparkSession, path: str, glob: str, recursive: bool) -> DataFrame:
    """(path, split, line_no, line): lines are read split by split, so a large file is read by many tasks.

    The rows of a split carry consecutive ids in reading order; a line's number is its place in its split plus the lines of the
    file's splits before, which are counted first (a row a split).
    """
    files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r\z", "").alias("line"))
    from pyspark.sql import Window as W

    per = rows.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begin = per.select("path", "split", (before - F.col("first")).alias("shift"))
    return rows.join(begin, ["path", "split"]).select("path", "split", (F.col("id") + F.col("shift") + 1).cast("int").alias("line_no"), "line")


def jsonl_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", *, recursive: bool = True) -> DataFrame:
    """(path, line_no from 1, line): every line of every file below ``path``, blank ones included in the count."""
    return _split_lines(spark, path, glob, recursive).drop("split")


def data_files(spark: SparkSession, path: str, glob: str = "*.jsonl") -> list[str]:
    """The path itself if it is a file, else the files below it in order of their paths; an error where there are none."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no such path: {path}")
    found = sorted(r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path").collect())
    if not found:
        raise FileNotFoundError(f"no {glob} below {path}")
    return found


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """The JSON lines of a file or folder with the schema their values show."""
    return spark.read.json(data_files(spark, path))


def read_sidecars(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(folder, and the top-level values): the JSON file of a given name of every folder below ``path``."""
    got = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(path)
    return got.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), *[F.col(f"`{c}`") for c in got.columns])


def parsed(lines: DataFrame) -> DataFrame:
    """Adds ``reason`` (null for a valid row), question, answer and type of each JSON line.

    A value counts as text only if it is a JSON string; numbers are not turned into text. Blank lines have reason ``blank``.
    """
    v = F.try_parse_json("line")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(F.col("__v"), f"$.{k}", "variant"))
    value = lambda k: F.try_variant_get(F.col("__v"), f"$.{k}", "string")
    has = lambda k: F.coalesce(F.contains(F.schema_of_variant(F.col("__v")), F.lit(f"{k}:")), F.lit(False))
    text = lambda k: F.coalesce(kind(k) == "STRING", F.lit(False)) & ~T.is_blank(value(k))
    out = lines.withColumn("__v", v)
    reason = (
        F.when(T.is_blank(F.col("line")), "blank")
        .when(~F.coalesce(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")), F.lit(False)), REASONS[0])
        .when(~(has("question") & has("answer")), REASONS[1])
        .when(~text("question"), REASONS[2])
        .when(~text("answer"), REASONS[3])
    )
    kinds = F.when(kind("type") == "STRING", value("type")).otherwise("")
    return out.select(*lines.columns, reason.alias("reason"), T.strip(kinds).alias("type"), T.strip(value("question")).alias("question"), T.strip(value("answer")).alias("answer"))


def read_pairs(spark: SparkSession, path: str, *, strict_file: bool = False) -> DataFrame:
    """(row_id, _file, line_no, type, question, answer) of the valid lines; row_id follows path and line.

    ``strict_file`` drops every row of a file that holds an invalid line.
    """
    rows = parsed(_split_lines(spark, path, "*.jsonl", True))
    if strict_file:
        bad = rows.where("reason IS NOT NULL AND reason <> 'blank'").select("path").distinct()
        rows = rows.join(bad, "path", "left_anti")
    from pyspark.sql import Window as W

    good = rows.where("reason IS NULL")
    # a row a split is summed over; the order inside a split, of bounded size, is local
    per = good.groupBy("path", "split").agg(F.count("*").alias("n"))
    before = per.withColumn("__b", F.coalesce(F.sum("n").over(W.partitionBy().orderBy("path", "split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("path", "split", "__b")
    nth = F.row_number().over(W.partitionBy("path", "split").orderBy("line_no"))
    return good.withColumn("__r", nth).join(before, ["path", "split"]).select((F.col("__b") + F.col("__r") - 1).cast("long").alias("row_id"), T.chapter_tag(F.col("path")).alias("_file"), "line_no", "type", "question", "answer")


def read_strict(spark: SparkSession, path: str, schema: str = "type string, question string, answer string") -> DataFrame:
    """Every line must parse; the first that does not fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


def read_labelled(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Several named data sets read as one, each row with its ``dataset``; folders inside a data set's folder are not read."""
    parts = [parsed(jsonl_lines(spark, p, recursive=False)).withColumn("dataset", F.lit(name)) for name, p in sorted(folders.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def skipped(rows: DataFrame) -> DataFrame:
    """(path, valid, skipped) per file."""
    return rows.groupBy("path").agg(F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "blank")).alias("skipped"))


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no from 0, section): second-level Markdown sections; what stands before the first is dropped.

    Lines lose trailing blanks before the test, so a bare ``## `` starts none; ``###`` stays inside.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\r|\n"), lambda x: F.regexp_replace(x, T.BLANKS + r"\z", ""))
    joined = F.array_join(lines, "\n")
    parts = F.filter(F.split(joined, r"(?m)(?=^## )"), lambda x: F.startswith(x, F.lit("## ")))
    return df.select(key, F.posexplode(F.transform(parts, lambda x: F.regexp_replace(x, r"\n\z", ""))).alias("section_no", "section"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, section_no, section) of the Markdown files below a folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    return sections(files, "file_name", "text")


def read_test_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, test_loss) of the metric files, by epoch."""
    return spark.read.option("multiLine", True).json(path).select(F.col("epoch").cast("int").alias("epoch"), F.col("test_loss").cast("double").alias("test_loss")).orderBy("epoch")


def logged_values(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(path, key, value): the first ``key: value`` line of each key in each log, quotes removed."""
    k = F.regexp_extract("line", r"^\s*([A-Za-z_.]+)\s*:\s*(.*?)\s*$", 1)
    v = F.regexp_replace(F.regexp_extract("line", r"^\s*([A-Za-z_.]+)\s*:\s*(.*?)\s*$", 2), "^['\"]|['\"]$", "")
    return lines.select("path", "line_no", k.alias("key"), v.alias("value")).where(F.col("key").isin(*keys)).groupBy("path", "key").agg(F.min_by("value", "line_no").alias("value"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, modified, length) of the files below a folder, hidden ones left out; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
        .select("path", F.substring_index("path", "/", -1).alias("name"), F.col("modificationTime").alias("modified"), "length")
        .where(~F.startswith("name", F.lit(".")))
    )


def checkpoints(files: DataFrame, marks: list[str]) -> DataFrame:
    """(folder) of every folder that holds one of the given files."""
    return files.where(F.col("name").isin(*marks)).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
