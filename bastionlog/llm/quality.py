"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is compressed
with each; the difference of the two sizes over their sum says which class it is closer to. The plain size
over the length and over the size of the upper-cased text join it as compression figures of the text
itself (repetition makes the first small), and a logistic curve fitted on other labelled rows than the
dictionaries' turns them into a score.

Only a bounded sample is learnt from: ``PER_CLASS`` labelled rows of either class, of at most
``MOST_CHARS`` characters. Scoring is one pass over the texts with no shuffle.

Cases: null and empty texts score like an empty text (the curve at the figures of no bytes). With no
labels, or one class only, every score is the smoothed share of label 1 (0.5 without labels). Repeated
rows, null doc_ids and other columns change nothing: one row out for each row in. Whole texts are
compressed, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.llm.labelled import held_out, training_rows
from bastionlog.llm.logistic import Logistic

FOLDS, HELD_OUT_FOLD, CUT = 3, 1, 0.5
PER_CLASS = 3000
MOST_CHARS = 30_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
PIECE_CHARS = 400
RUN_BYTES = 1000
FRAME_BYTES = 6


def pieces(text: str) -> list[bytes]:
    """A text in runs of ``PIECE_CHARS`` characters: dictionaries learn from many short samples."""
    return [text[i : i + PIECE_CHARS].encode() for i in range(0, len(text), PIECE_CHARS)]


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of the texts' plain bytes where there are too few to train on."""
    samples = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: Logistic | None
    share: float

    def compressors(self) -> tuple:
        made = []
        for content in (self.good, self.bad):
            of = zstandard.ZstdCompressionDict(content) if content else None
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=of, write_content_size=False))
        made.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        return tuple(made)


def figures(text: str, good, bad, plain) -> tuple[float, ...]:
    """Compression figures of one text. It is compressed in runs, so that the dictionaries weigh the same
    at the end of a long text as at its start."""
    data = text.encode("utf-8", "surrogatepass")
    runs = [data[i : i + RUN_BYTES] for i in range(0, len(data), RUN_BYTES)] or [b""]
    g = sum(len(good.compress(r)) - FRAME_BYTES for r in runs)
    b = sum(len(bad.compress(r)) - FRAME_BYTES for r in runs)
    p = len(plain.compress(data))
    n = len(data)
    lean = (b - g) / (b + g + 1)
    return lean, (b - g) / (n + 20), p / (n + 20), min(g, b) / (n + 20), (g - b) / (p + 1)


def fit(rows: list[tuple[str, int]]) -> Model:
    """Half of the rows make the dictionaries, the other half the curve."""
    share = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    one, two = rows[::2], rows[1::2]
    model = Model(dictionary([t for t, y in one if y]), dictionary([t for t, y in one if not y]), None, share)
    if len({y for _, y in one}) == len({y for _, y in two}) == 2:
        tools = model.compressors()
        x = np.array([figures(t, *tools) for t, _ in two])
        model.curve = Logistic(x, np.array([y for _, y in two], dtype=float))
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(training_rows(docs, labels, "quality", FOLDS, HELD_OUT_FOLD, PER_CLASS, MOST_CHARS))


def score(text: Column, model: Model) -> Column:
    """double from 0 to 1; higher is better."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tools = model.compressors()
        for batch in batches:
            if model.curve is None:
                yield pd.Series(np.full(len(batch), model.share))
                continue
            x = np.array([figures(t or "", *tools) for t in batch]).reshape(len(batch), -1)
            yield pd.Series(model.curve.score(x) if len(batch) else np.empty(0))

    return scored(text)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    rated = docs.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD).alias("held_out"), score(F.col("text"), model).alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score ``CUT`` or more, with the columns they came with."""
    model = train(docs, labels)
    return docs.withColumn("_quality", score(docs["text"], model)).filter(F.col("_quality") >= CUT).drop("_quality")
