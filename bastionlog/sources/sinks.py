"""Writers for alerts, log entries, health snapshots, weaknesses and exports."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bastionlog.operators.vulnerabilities import STORED, upsert

VULNERABILITIES_DDL = "cve_id string, description string, cvss_score double, severity string, mitigation string"
#: Versions of the weakness table that stay for readers still at work on them.
KEPT_VERSIONS = 8


def append_by_day(rows: DataFrame, path: str) -> None:
    """Append rows partitioned by the day of ``ts``, so time-range reads skip other days."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def replace_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch under its own number; a repeated batch replaces itself."""
    rows.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch_id}")


def log_entries(lines: DataFrame, source: str, level: str = "INFO") -> DataFrame:
    """Raw lines as stored log entries."""
    return lines.select(
        F.col("line_index").alias("id"), "ts", F.lit(source).alias("source"), F.lit(level).alias("level"),
        F.col("raw_message").alias("message"),
    )


def store_of(spark: SparkSession, path: str):
    """The path and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions there are; a fault of the store is raised, not taken for none."""
    found = store_of(spark, f"{path}/version=*")[1].globStatus(store_of(spark, f"{path}/version=*")[0])
    return sorted(int(f.getPath().getName().removeprefix("version=")) for f in found or [])


def read_version(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Newest version of the weakness table and its number; empty and -1 before the first write."""
    found = versions(spark, path)
    if not found:
        return spark.createDataFrame([], VULNERABILITIES_DDL), -1
    return spark.read.parquet(f"{path}/version={found[-1]}").select(*STORED), found[-1]


def commit_version(spark: SparkSession, staged: str, path: str, version: int) -> bool:
    """Give a staged folder its version number by one rename that fails where the number is taken.

    False when another writer took it. The rename is atomic on HDFS and local disks; object stores that copy
    to rename need one writer at a time.
    """
    source, store = store_of(spark, staged)
    target = store.makeQualified(store_of(spark, f"{path}/version={version}")[0])
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(store.makeQualified(source), target, options)
    except Py4JJavaError as fault:
        if "FileAlreadyExistsException" not in fault.java_exception.getClass().getName():
            raise
        store.delete(source, True)
        return False
    return True


def upsert_vulnerabilities(findings: DataFrame, path: str) -> bool:
    """Write the merged table as a new version, only if something changed. True when written.

    Readers see a version when it is complete. Of two writers that read the same version one gets the next
    number; the other merges again with what the first wrote. Merging the same findings again changes
    nothing. The newest ``KEPT_VERSIONS`` stay. The table holds at most one row per catalogue entry.
    """
    spark = findings.sparkSession
    while True:
        existing, newest = read_version(spark, path)
        merged = upsert(existing, findings).persist()
        try:
            if merged.filter("change <> 'unchanged'").isEmpty():
                return False
            staged = f"{path}/_staged-{uuid.uuid4().hex}"
            merged.select(*STORED).coalesce(1).write.parquet(staged)
        finally:
            merged.unpersist()
        if commit_version(spark, staged, path, newest + 1):
            break
    for old in versions(spark, path)[:-KEPT_VERSIONS]:
        folder, store = store_of(spark, f"{path}/version={old}")
        store.delete(folder, True)
    return True


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
