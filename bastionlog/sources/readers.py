"""Readers: raw log text, labelled lines, source trees, stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bastionlog.rules.code_rules import SOURCE_EXTENSIONS

LINES_DDL = "line_index bigint, stream_id bigint, ts timestamp_ntz, raw_message string"
HEALTH_DDL = (
    "id bigint, stream_id bigint, ts timestamp_ntz, cpu_usage double, memory_usage double, network_tx double, "
    "network_rx double, active_connections int"
)
LABELLED_COLUMNS = ["log_entry", "label"]


def text_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files as lines in file order, one stream per file; ``line_index`` is the line's number from 0.

    Two passes over the same splits: one counts the lines of each split, without their text, and adds
    the counts up along each file; the other adds a line's place in its split. Only a row per split is
    shuffled, whatever the size of splits, and compressed files are one split.
    """
    row = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("raw_message"), row.alias("row"),
    )
    splits = lines.groupBy("file", "block").agg(F.min("row").alias("first_row"), F.count("*").alias("n"))
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    return lines.join(offsets, ["file", "block"]).select(
        (F.col("before") + F.col("row") - F.col("first_row")).alias("line_index"),
        F.xxhash64("file").alias("stream_id"), "ts", "raw_message",
    )


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Log lines arriving as Parquet files."""
    return spark.readStream.schema(LINES_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def health_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(HEALTH_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def kafka_lines(messages: DataFrame) -> DataFrame:
    """Log lines from the rows of a Kafka source, batch or streaming: one stream per partition."""
    return messages.select(
        F.col("offset").alias("line_index"), F.col("partition").cast("bigint").alias("stream_id"),
        F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.col("value").cast("string").alias("raw_message"),
    )


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """CSV of ``log_entry, label``; both columns must be there."""
    rows = spark.read.csv(path, header=True)
    missing = [c for c in LABELLED_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"labelled data needs the columns {', '.join(missing)}")
    return rows.select(*LABELLED_COLUMNS)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def source_tree(spark: SparkSession, root: str, skip_names: tuple[str, ...] = ()) -> DataFrame:
    """``path, extension, content`` of the source files below a folder; version control is skipped."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    rows = files.select(path.alias("path"), extension_of(path).alias("extension"), F.col("value").alias("content"))
    name = F.element_at(F.split("path", "/"), -1)
    hidden = F.col("path").contains("/.git") | F.col("path").contains("__pycache__")
    return rows.filter(F.col("extension").isin(*SOURCE_EXTENSIONS) & ~hidden & ~name.isin(*skip_names))
