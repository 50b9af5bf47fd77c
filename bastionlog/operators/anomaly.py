"""Anomaly scores (isolation forest) and a supervised threat classifier on feature vectors.

The forest follows the published method: each tree sees a fixed-size sample, so training data has a
proven bound (trees x sample rows) no matter how large the table is, while scoring runs over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.functions.shipping import ship_by_value
from bastionlog.operators.features import VECTOR_FIELDS

ship_by_value(__name__)

# ---- fixed values: forest size, sample size, contamination and seed ---------------------------------
TREES, SAMPLE_ROWS, CONTAMINATION, SEED, FOLDS = 100, 256, 0.05, 42, 4
TREE_DDL = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def vector_columns() -> list[Column]:
    """The seven numbers of a line; missing metrics count as zero."""
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in VECTOR_FIELDS]


def standardise(vectors: DataFrame) -> DataFrame:
    """Subtract the mean and divide by the population deviation; constant columns only shift.

    The moments are one row of seven pairs, read as the scaling constants.
    """
    moments = vectors.agg(
        *[F.avg(c).alias(f"m_{c}") for c in VECTOR_FIELDS], *[F.stddev_pop(c).alias(f"s_{c}") for c in VECTOR_FIELDS]
    ).first()
    scaled = [
        ((F.col(c) - F.lit(moments[f"m_{c}"])) / F.lit(moments[f"s_{c}"] or 1.0)).alias(c) for c in VECTOR_FIELDS
    ]
    return vectors.select(*[c for c in vectors.columns if c not in VECTOR_FIELDS], *scaled)


def expected_depth(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(sample: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one tree grown on its sample."""
    tree = int(sample["tree"].iloc[0])
    data = sample.sort_values("place").head(SAMPLE_ROWS)[VECTOR_FIELDS].to_numpy()
    rng = np.random.default_rng([SEED, tree])
    limit = int(np.ceil(np.log2(max(len(data), 2))))
    nodes: list[list] = []

    def split(rows: np.ndarray, depth: int) -> int:
        number = len(nodes)
        nodes.append([tree, number, -1, 0.0, -1, -1, depth + expected_depth(len(rows))])
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
        if depth < limit and len(rows) > 1 and len(spread):
            feature = int(rng.choice(spread))
            threshold = float(rng.uniform(rows[:, feature].min(), rows[:, feature].max()))
            below = rows[:, feature] <= threshold
            nodes[number][2:4] = [feature, threshold]
            nodes[number][4] = split(rows[below], depth + 1)
            nodes[number][5] = split(rows[~below], depth + 1)
        return number

    split(data, 0)
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])


def draw_samples(scaled: DataFrame, key: str) -> DataFrame:
    """Rows for each tree, drawn for it alone: those whose hash of (key, tree) lies under a bound.

    The bound lets through half as many again as a tree takes, whatever the table's size; the tree then
    takes the smallest hashes. The draw does not depend on the partitioning, and trees x sample rows bound it.
    """
    rows = scaled.count()
    bound = min(2**63 - 1, int(-(2**63) + min(1.0, 1.5 * SAMPLE_ROWS / max(rows, 1)) * 2**64))
    chosen = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(TREES - 1)),
            lambda t: F.struct(t.alias("tree"), F.xxhash64(F.col(key), t + F.lit(SEED)).alias("place")),
        ),
        lambda s: s["place"] <= F.lit(bound),
    )
    return scaled.select(*VECTOR_FIELDS, F.inline(chosen))


def fit_forest(scaled: DataFrame, key: str) -> DataFrame:
    """The forest as a table of nodes, each tree grown in its own task on its sample."""
    return draw_samples(scaled, key).groupBy("tree").applyInPandas(grow_tree, TREE_DDL)


def read_forest(nodes: DataFrame) -> list[np.ndarray]:
    """Trees as arrays; the root's depth is the mean path length of the tree's sample."""
    return [
        g.sort_values("node")[["feature", "threshold", "left", "right", "depth"]].to_numpy()
        for _, g in nodes.toPandas().groupby("tree")
    ]


def path_lengths(data: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Depth at which each row ends in a tree, all rows moving one level per step."""
    at = np.zeros(len(data), dtype=np.int64)
    while True:
        feature = tree[at, 0].astype(np.int64)
        inner = feature >= 0
        if not inner.any():
            return tree[at, 4]
        below = data[np.arange(len(data)), np.maximum(feature, 0)] <= tree[at, 1]
        at = np.where(inner, np.where(below, tree[at, 2], tree[at, 3]).astype(np.int64), at)


def raw_scores(scaled: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``raw_score`` in (0, 1) by a fitted forest: higher is more unusual. Rounded so that ties are exact."""
    shared = scaled.sparkSession.sparkContext.broadcast(read_forest(nodes))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = batch[VECTOR_FIELDS].to_numpy()
            share = [path_lengths(data, t) / max(t[0, 4], 1.0) for t in shared.value]
            yield batch[["line_index"]].assign(raw_score=np.round(2.0 ** -np.mean(share, axis=0), 6))

    return scaled.select("line_index", *VECTOR_FIELDS).mapInPandas(score, "line_index bigint, raw_score double")


def unusual_by_deviation(scaled: DataFrame) -> DataFrame:
    """The plain twin of the forest: the largest absolute deviation of a line's standardised values."""
    far = F.round(F.greatest(*[F.abs(c) for c in VECTOR_FIELDS]), 4)
    return scaled.select("line_index", far.alias("deviation"), (far > 3).cast("int").alias("is_anomaly"))


def anomaly_scores(scores: DataFrame) -> DataFrame:
    """``anomaly_score`` scaled to 0..1 over the table and ``is_anomaly`` for the most unusual 5 percent.

    Raw scores have six decimals, so the exact percentile counts a bounded set of values.
    """
    limits = scores.agg(
        F.min("raw_score").alias("low"), F.max("raw_score").alias("high"),
        F.percentile("raw_score", F.lit(1 - CONTAMINATION)).alias("cut"),
    ).first()
    span = (limits["high"] or 0.0) - (limits["low"] or 0.0)
    normal = F.lit(0.5) if span < 1e-9 else F.round((F.col("raw_score") - limits["low"]) / span, 4)
    return scores.select(
        "line_index", normal.alias("anomaly_score"), (F.col("raw_score") > F.lit(limits["cut"])).cast("int").alias("is_anomaly")
    )


def fit_threat_classifier(labelled: DataFrame, trees: int = TREES) -> PipelineModel:
    """Random forest on ``label``, to be used on any vectors."""
    return Pipeline(stages=[
        StringIndexer(inputCol="label", outputCol="label_no", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=VECTOR_FIELDS, outputCol="vector"),
        RandomForestClassifier(labelCol="label_no", featuresCol="vector", numTrees=trees, seed=SEED, maxDepth=5),
    ]).fit(labelled)


def classify_threats(vectors: DataFrame, model: PipelineModel) -> DataFrame:
    """Predicted label, its probability and the whole probability row of every line of ``vectors``."""
    names = F.array(*[F.lit(n) for n in model.stages[0].labels])
    assembled = model.stages[2].transform(model.stages[1].transform(vectors))
    full = vector_to_array("probability")
    return assembled.select(
        "line_index", *[c for c in ["label"] if c in vectors.columns],
        F.element_at(names, F.col("prediction").cast("int") + 1).alias("prediction"),
        F.array_max(full).alias("probability"), full.alias("probabilities"),
    )


def cross_fitted(labelled: DataFrame, key: str, trees: int = TREES) -> DataFrame:
    """Every line of ``labelled`` classified by a model that has not seen its fold, a hash of ``key``."""
    fold = F.pmod(F.xxhash64(key), F.lit(FOLDS))
    scored = [
        classify_threats(labelled.filter(fold == k), fit_threat_classifier(labelled.filter(fold != k), trees))
        for k in range(FOLDS)
    ]
    return reduce(DataFrame.unionAll, scored)
