"""Models of lines as tables, fitted once and applied to any lines: scores that detection takes in.

``anomaly`` is how far a line's numbers lie from those the model was fitted on, ``clf`` the share of the
fitted lines of the same format and level that any signature hits. Both are in ten-thousandths exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bastionlog.operators.anomaly import vector_columns
from bastionlog.operators.features import VECTOR_FIELDS
from bastionlog.operators.signatures import match_lines

#: Deviations from here on count as 1.
FAR = 10
GROUP = ["format", "severity"]


def fit_moments(features: DataFrame) -> DataFrame:
    """One row: mean and population deviation of each number of a line."""
    vectors = features.select(*vector_columns())
    return vectors.agg(
        *[F.avg(c).alias(f"m_{c}") for c in VECTOR_FIELDS], *[F.stddev_pop(c).alias(f"s_{c}") for c in VECTOR_FIELDS]
    )


def fit_shares(features: DataFrame) -> DataFrame:
    """Per format and level the share of lines that a signature hits, in ten-thousandths, ties up."""
    hit = F.when(F.size(F.coalesce("codes", F.array().cast("array<int>"))) > 0, 1).otherwise(0)
    counted = match_lines(features).groupBy(*GROUP).agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    return counted.select(*GROUP, F.expr("(hits * 20000 + n) div (2 * n)").alias("share"))


def score_lines(features: DataFrame, moments: DataFrame, shares: DataFrame) -> DataFrame:
    """``features`` with ``anomaly`` and ``clf``. The moments are read as constants; a format and level the
    model has not seen scores 0, as does a model fitted on no lines."""
    fitted = moments.first()
    far = [
        F.abs((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(fitted[f"m_{c}"])) / F.lit(fitted[f"s_{c}"] or 1.0))
        for c in VECTOR_FIELDS
    ]
    deviation = F.coalesce(F.round(F.greatest(*far), 4), F.lit(0.0))
    anomaly = F.floor(F.least(deviation, F.lit(float(FAR))) * (10_000 // FAR) + 0.5) / 10_000
    return (
        features.join(shares, GROUP, "left")
        .withColumn("anomaly", anomaly)
        .withColumn("clf", F.coalesce("share", F.lit(0)) / 10_000)
        .drop("share")
    )
