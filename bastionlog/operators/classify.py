"""Naive Bayes line classifier and coarse indicators."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bastionlog.functions.columns import dimension
from bastionlog.functions.matching import rule_hits
from bastionlog.functions.shipping import ship_by_value
from bastionlog.rules.line_classifier import COARSE_INDICATORS, LABELS, TOKEN_PATTERN, TRAINING_LINES

ship_by_value(__name__)

#: A model of so many tokens at most goes to every task (some 30 bytes a token); a larger one stays a table.
SENT_TOKENS = 200_000
#: Log probabilities are whole billionths, so sums do not depend on the order of the shuffle.
LOG_UNITS = 10**9


def tokens(text: Column) -> Column:
    """Lower-cased word tokens of two or more characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN_PATTERN})"), F.lit(1)), lambda t: F.length(t) > 1)


def token_counts(lines: DataFrame, text: str) -> DataFrame:
    """Occurrences of each token over all lines (map-side combined)."""
    return lines.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


class Model(NamedTuple):
    """Token counts per label, class and word totals. ``counts`` has columns token, label, n."""

    counts: DataFrame
    examples: dict[str, int]
    words: dict[str, int]
    vocabulary: int

    def prior(self, label: str) -> int:
        share = (self.examples.get(label, 0) + 1) / (sum(self.examples.values()) + len(LABELS))
        return round(LOG_UNITS * math.log(share))


def built_in_examples(spark: SparkSession) -> DataFrame:
    return dimension(spark, TRAINING_LINES, ["text", "label"])


def train(examples: DataFrame) -> Model:
    """Count tokens per label. Only per-label totals reach the driver; the counts stay a table."""
    counts = (
        examples.select("label", F.explode(tokens(F.col("text"))).alias("token"))
        .groupBy("token", "label").agg(F.count("*").alias("n"))
    )
    per_label = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    words = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    return Model(counts, per_label, words, max(counts.select("token").distinct().count(), 1))


def _log_probability(model: Model, label: str, count: Column) -> Column:
    share = (count + 1) / F.lit(float(model.words.get(label, 0) + model.vocabulary))
    return F.round(F.log(share) * LOG_UNITS).cast("bigint")


def _wide(model: Model) -> DataFrame:
    """One row per token with its count under each label."""
    return model.counts.groupBy("token").pivot("label", LABELS).agg(F.sum("n")).na.fill(0)


def token_sums(names: list[str], logs: np.ndarray) -> Callable[[Column], Column]:
    """Function from a column of token lists to the sums of the columns of ``logs`` over their tokens.

    Row ``i`` of ``logs`` is that of ``names[i]``, the row after them that of all other tokens. It counts as
    non-deterministic only so that the optimiser evaluates it once per line.
    """

    def sums(bags: pa.Array) -> pa.Array:
        places = pc.index_in(bags.flatten(), value_set=pa.array(names, bags.type.value_type)).fill_null(len(names))
        # Running sums over the batch; a list's sum is the difference between its ends.
        running = np.concatenate([np.zeros((1, logs.shape[1]), dtype=np.int64), np.cumsum(logs[places.to_numpy()], axis=0)])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(bags).fill_null(0).to_numpy())])
        each = (running[ends[1:]] - running[ends[:-1]]).ravel()
        offsets = np.arange(len(bags) + 1, dtype=np.int32) * logs.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(each, pa.int64()))

    return F.arrow_udf(sums, T.ArrayType(T.LongType())).asNondeterministic()


def _with_scores(prepared: DataFrame, model: Model, key: str) -> DataFrame:
    """Add the log score of each label to lines with ``tokens``, line by line: nothing is shuffled or gathered."""
    known = _wide(model).select("token", *[_log_probability(model, x, F.col(x)).alias(x) for x in LABELS]).collect()
    unseen = dimension(prepared.sparkSession, [(0,)], ["n"]).select(
        *[_log_probability(model, x, F.col("n")).alias(x) for x in LABELS]
    ).first()
    logs = np.array([[r[x] for x in LABELS] for r in [*known, unseen]], dtype=np.int64)
    summed = prepared.withColumn("sums", token_sums([r["token"] for r in known], logs)(F.col("tokens")))
    # As by a join: a line without tokens or key has no scores.
    scored = (F.size("tokens") > 0) & F.col(key).isNotNull()
    return summed.select(
        *prepared.columns,
        *[F.when(scored, F.lit(model.prior(x)) + F.col("sums")[i]).alias(f"score_{x}") for i, x in enumerate(LABELS)],
    )


def _scores(lines: DataFrame, model: Model, key: str) -> DataFrame:
    """Log score of each label for each ``key``, from a join of tokens with the model table.

    Tokens are counted per line first; the planner splits tokens that are in most lines.
    """
    wide = _wide(model)
    pairs = lines.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count("*").alias("times"))
    logs = {x: _log_probability(model, x, F.coalesce(x, F.lit(0))) for x in LABELS}
    sums = pairs.join(wide, "token", "left").groupBy(key).agg(
        *[F.sum(F.col("times") * logs[x]).alias(f"sum_{x}") for x in LABELS]
    )
    return sums.select(key, *[(F.lit(model.prior(x)) + F.col(f"sum_{x}")).alias(f"score_{x}") for x in LABELS])


def predict(lines: DataFrame, model: Model, text: str, key: str) -> DataFrame:
    """Add ``ml_label`` and ``confidence``. A line without tokens is benign with confidence 0.

    ``key`` identifies the text: rows that share it must hold the same text.
    """
    prepared = lines.withColumn("tokens", tokens(F.col(text)))
    if model.vocabulary <= SENT_TOKENS:
        scored = _with_scores(prepared, model, key)
    else:
        once = prepared.select(key, "tokens").dropDuplicates([key])
        scored = prepared.join(_scores(once, model, key), key, "left")
    scores = [F.col(f"score_{x}") for x in LABELS]
    top = F.greatest(*scores)
    label = F
    for name, score in zip(LABELS, scores):
        label = label.when(score == top, name)
    weights = [F.exp((s - top) / LOG_UNITS) for s in scores]
    total = sum(weights[1:], weights[0])
    return scored.select(
        *lines.columns,
        F.coalesce(label, F.lit(LABELS[0])).alias("ml_label"),
        F.coalesce(F.round(F.lit(1.0) / total, 2), F.lit(0.0)).alias("confidence"),
    )


def with_indicators(lines: DataFrame, text: str) -> DataFrame:
    """Add ``indicators``: the coarse rules a line hits, as structs in rule order."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("indicator"), F.lit(s).alias("severity"), F.lit(k).alias("type"))
        for n, s, k, _ in COARSE_INDICATORS
    ])
    hits = rule_hits(F.col(text), [p for *_, p in COARSE_INDICATORS])
    return lines.withColumn("indicators", F.transform(hits, lambda i: F.element_at(rows, i + 1)))


def summarise(predictions: DataFrame) -> DataFrame:
    """Line counts per label and indicator counts per type, one row."""
    def of_type(kind: str) -> Column:
        return F.sum(F.size(F.filter("indicators", lambda s: s["type"] == kind)))

    return predictions.agg(
        F.count("*").alias("total_lines"),
        *[F.count_if(F.col("ml_label") == x).alias(f"ml_{x}_count") for x in ("threat", "vulnerability", "benign")],
        F.sum(F.size("indicators")).alias("indicator_count"),
        of_type("threat").alias("threat_indicator_count"),
        of_type("vulnerability").alias("vulnerability_indicator_count"),
    )
