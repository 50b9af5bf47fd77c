"""Bounded samples of labelled rows for the classifiers, and the split that holds rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids belong to no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows whose labels are never learnt; false for null ids."""
    return F.coalesce(remainder(doc_id, folds) == fold, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int, most_chars: int
) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` labelled rows of either class, in a fixed random order.

    Ids are drawn from the labels first: a bounded list, which the documents are then looked up by, so no
    text is shuffled. Texts of more than ``most_chars`` characters are not learnt from, which bounds the
    bytes that reach the driver. Ids with contradicting labels are left out.
    """
    learnt = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(
        ~held_out(F.col("doc_id"), folds, fold)
    )
    agreed = learnt.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).filter("y = z")
    drawn = None
    for value in (0, 1):
        some = agreed.filter(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = some if drawn is None else drawn.unionAll(some)
    texts = (
        docs.select("doc_id", "text")
        .filter(F.col("text").isNotNull() & (F.length("text") <= most_chars))
        .join(F.broadcast(drawn.select("doc_id", "y")), "doc_id")
    )
    # Repeated rows of an id count once, so the sample stays bounded.
    once = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return [(r["text"], r["y"]) for r in once.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
