"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Map state and timers of the streams need a store with column families.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app_name: str = "bastionlog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; extra settings come in as keyword pairs (dots as ``__``)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the results or the speed depend on, for sessions made elsewhere.

    Offsets in log timestamps are read as UTC instants. Wide feature projections generate methods the
    JVM refuses to compile; with the lower limit Spark evaluates them in smaller compiled pieces.
    """
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares for intermediate tables.

    ``spark.checkpoint.dir`` names it. Only a local master may fall back to a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    return os.path.join(tempfile.gettempdir(), "bastionlog-checkpoints")


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later passes scan narrow columns
    of the written table instead of repeating the work, and lost executors cost no lineage replay.

    ``by`` names a column to partition the table by; rows of a value go to few files, and a value with
    many rows to several tasks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if by is None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
