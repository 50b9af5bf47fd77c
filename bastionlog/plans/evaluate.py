"""Quality of the rules and of the line classifier on labelled lines (``log_entry, label``), e.g. a labelled CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bastionlog.functions.matching import pick_rule, rule_of, signature_codes
from bastionlog.operators import classify, quality
from bastionlog.rules.signatures import SIGNATURES

BENIGN = "benign"


def rule_confusion(labelled: DataFrame) -> DataFrame:
    """Counts of (label, prediction), where the prediction is the first signature a line hits."""
    hits = labelled.select("label", signature_codes(F.col("log_entry")).alias("codes"))
    first = pick_rule(rule_of(F.element_at("codes", 1)), [s.name for s in SIGNATURES])
    named = F.when(F.size("codes") > 0, first).otherwise(BENIGN)
    return quality.confusion(hits.select("label", named.alias("prediction")))


def classifier_confusion(labelled: DataFrame, model: classify.Model) -> DataFrame:
    """Counts of (label, prediction) of a line classifier."""
    lines = labelled.select("label", "log_entry", F.xxhash64("log_entry").alias("key"))
    predicted = classify.predict(lines, model, "log_entry", "key")
    return quality.confusion(predicted.select("label", F.col("ml_label").alias("prediction")))


def attack_metrics(counts: DataFrame) -> DataFrame:
    """Rates of attack against benign from counts of (label, prediction)."""
    flags = counts.select(
        (F.col("label") != BENIGN).alias("is_attack"), (F.col("prediction") != BENIGN).alias("detected"), "n"
    )
    return quality.binary_metrics(flags)
