"""Give lines without an address the nearest known one: the last before them, else the next after.

A forward search is needed only for lines ahead of the first known address of their scope, and that
address is one value per scope. Scopes are cut into chunks of consecutive lines, so a scope of any
length spreads over many tasks; only one row per chunk takes part in the step across chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bastionlog.functions.columns import UNKNOWN

CHUNK_LINES = 1 << 20


def resolve_source_ip(
    lines: DataFrame, scope: list[str], chunk_lines: int = CHUNK_LINES, donors: DataFrame | None = None
) -> DataFrame:
    """Add ``resolved_ip``. Needs ``line_index`` (order) and ``source_ip``.

    ``donors`` are the lines the chunk summary is read from, ``lines`` by default. Passing the plain
    feature table lets that pass read three narrow columns when ``lines`` carries costly ones.
    """
    known = F.when(F.col("source_ip") != UNKNOWN, F.col("source_ip"))
    order = F.col("line_index")
    chunk = F.expr(f"line_index div {chunk_lines}")
    chunked = lines.withColumn("chunk", chunk)
    source = (lines if donors is None else donors).select(*scope, "line_index", "source_ip")

    per_chunk = source.withColumn("chunk", chunk).groupBy(*scope, "chunk").agg(
        F.max_by(known, F.when(known.isNotNull(), order)).alias("last_known"),
        F.min_by(known, F.when(known.isNotNull(), order)).alias("first_known"),
    )
    across = W.partitionBy(*scope).orderBy("chunk")
    whole = W.partitionBy(*scope)
    carried = per_chunk.select(
        *scope,
        "chunk",
        F.last("last_known", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias("carry"),
        F.min_by("first_known", F.when(F.col("first_known").isNotNull(), F.col("chunk"))).over(whole)
        .alias("scope_first"),
    )
    inside = W.partitionBy(*scope, "chunk").orderBy("line_index").rowsBetween(W.unboundedPreceding, -1)
    return (
        chunked.withColumn("before", F.last(known, ignorenulls=True).over(inside))
        .join(carried, [*scope, "chunk"])
        .withColumn("resolved_ip", F.coalesce(known, "before", "carry", "scope_first", F.lit(UNKNOWN)))
        .drop("chunk", "before", "carry", "scope_first")
    )
