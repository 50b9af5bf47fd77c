"""Detection and classification quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, zero when the divisor is."""
    return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0))).otherwise(F.lit(0.0))


def confusion(pairs: DataFrame) -> DataFrame:
    """Line counts per (label, prediction): everything else is computed from these few rows."""
    return pairs.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def class_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as label or prediction."""
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                         F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"),
                         F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
            )
        )
    )
    totals = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    return totals.select(
        "class", "support",
        ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"),
        "hit",
    )


def overall_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, weighted and macro averages, one row."""
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    return class_metrics(counts).agg(
        total.alias("support"),
        ratio(F.sum("hit"), total).alias("accuracy"),
        *[ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in names],
        *[F.avg(m).alias(f"macro_{m}") for m in names],
    )


def binary_metrics(flags: DataFrame) -> DataFrame:
    """Counts and rates of ``is_attack`` against ``detected``; a column ``n`` counts equal rows."""
    attack, found = F.col("is_attack"), F.col("detected")
    weight = F.col("n") if "n" in flags.columns else F.lit(1).cast("bigint")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0).cast("bigint"))

    counts = flags.agg(
        total(attack & found).alias("tp"), total(~attack & found).alias("fp"),
        total(~attack & ~found).alias("tn"), total(attack & ~found).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        "tp", "fp", "tn", "fn",
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
