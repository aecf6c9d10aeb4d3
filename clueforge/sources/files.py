"""CSV and JSON-lines files with row lineage; discovery of what a folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST_BYTES = 64 * 1024 * 1024


def discover(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, format, bytes, state) of all files under folder: recognised, oversized or ignored. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
    form = F.when(F.lower("path").endswith(".csv"), "csv").when(F.lower("path").rlike(r"\.(jsonl|ndjson)$"), "jsonl").otherwise("other")
    state = F.when(F.col("format") == "other", "ignored").when(F.col("bytes") > most_bytes, "oversized").otherwise("recognised")
    return files.withColumn("format", form).withColumn("state", state)


def _numbered(df: DataFrame, first: int) -> DataFrame:
    """df with source_path and row_number: the position of each line in its file, by the reader's own order in a split."""
    path, start, at = F.input_file_name(), F.expr("_metadata.file_block_start"), F.monotonically_increasing_id()
    placed = df.select("*", path.alias("source_path"), start.alias("__start"), at.alias("__at"))
    w = Window.partitionBy("source_path").orderBy("__start", "__at")
    return placed.withColumn("row_number", F.row_number().over(w) + (first - 1)).drop("__start", "__at")


def read_csv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """All columns as text, blank rows left out, with source_path, row_number (the header is row 1) and source_sha256 of the raw row."""
    raw = spark.read.option("header", "true").option("escape", '"').option("multiLine", "false").option("encoding", "UTF-8").csv(paths)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    names = raw.columns
    out = _numbered(raw, 2)
    filled = F.exists(F.array(*[F.col(f"`{c}`") for c in names]), lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(names)])).cast("binary"), 256)
    return out.where(filled).withColumn("source_sha256", digest)


def read_jsonl(spark: SparkSession, paths: list[str] | str, schema: StructType | str, mode: str = "lenient") -> tuple[DataFrame, DataFrame]:
    """(rows, issues). lenient: bad lines become issues invalid_jsonl or invalid_jsonl_row; strict: the first one raises when read."""
    lines = _numbered(spark.read.text(paths), 1).where(F.trim("value") != "")
    wide = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).add("_corrupt_record", "string")
    if mode == "strict":
        rows = lines.withColumn("r", F.from_json("value", wide, {"mode": "FAILFAST"}))
    else:
        rows = lines.withColumn("r", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    code = F.when(F.trim("value").rlike(r"^(\[|\"|[0-9tfn-])"), "invalid_jsonl_row").otherwise("invalid_jsonl")
    issues = rows.where(bad).select(code.alias("code"), "source_path", "row_number")
    good = rows.where(~bad).select("r.*", "source_path", "row_number", F.sha2(F.col("value").cast("binary"), 256).alias("source_sha256")).drop("_corrupt_record")
    return good, issues


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The parquet table at path, or an empty one of that schema where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
