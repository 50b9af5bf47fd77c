"""Packing of tokenised documents into sequences, shortest pack first over the histogram of lengths.

A document's ids are cut every 2,048: full pieces are sequences of their own, what is left over is packed.
Only the histogram of the left-over lengths (at most 2,047 rows) goes to the driver. Lengths are placed
longest first; each piece goes to the shortest pack that is open, or to a new one where it fits none.
Packs with the same history are one pattern with a count: a run of consecutive sequence numbers. Placing a
length raises the fill of whole runs and cuts at most one, so a placement is a row (length, ranks, run,
offset), and documents meet it by their rank among the pieces of their length.

A pattern has at most 63 different lengths, as 1 + 2 + ... + 63 = 2,016, and a length opens at most one
pattern and cuts one: at most 4,094 patterns and 258,000 placements of 40 bytes, whatever the number of
documents. They are sent to the tasks as sorted arrays.

Packs that end neither full nor at a power of two are laid end to end and cut every 2,048; the ids after
the last cut make sequences of powers of two. So no sequence needs padding, and each of them has at most
one document cut at either end.

Texts are tokenised once, by their runs between ASCII white space, which the vocabulary's normaliser and
pattern treat independently. The different runs of some 4 MB of texts are looked up once each, and their ids
gathered by Arrow. A worker keeps the ids of some 300,000 short runs, in two generations; of a run not met yet,
signs at its end are looked up apart, so that a word is learnt once whatever follows it. Ranks are
a task's own count plus the sum over the tasks before it. What is shuffled is a few numbers a document, and
the ids of left-over pieces only for those that are cut.

Cases: null and empty texts have the closing id alone. Repeated rows and null ids are documents like
others. An empty table gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bastionlog.session import materialise

SEQUENCE, CLOSING_ID = 2048, 1
KEPT_RUNS, KEPT_BYTES, LEARNT_BYTES = 300_000, 48, 1 << 14
MARK, WORD_END = b"\0", "</w>"
SIGNS, SPECIAL = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"<|"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, by runs between ASCII white space.

    Signs at a run's end are looked up by themselves where the vocabulary's pattern parts them from what is before;
    A-Z are lower-cased at once, as its normaliser does. Texts that may name special ids are left as they are.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.mark = self._ids(MARK.decode())
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parted: dict[str, bool] = {}

    def _ids(self, text: str) -> np.ndarray:
        made = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(made[0].ids, dtype="<u4")

    def _learn(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs, many encoded as one text.

        A run of a-z is one word, which normaliser and pattern leave as it is: the model alone has its ids. Other
        letters are one word as a rule, whose last id alone ends a word; the rest get a mark between that no run holds.
        """
        known: dict[bytes, bytes] = {}
        letters, marked, single = [], [], []
        spare = marked if len(self.mark) == 1 else single
        for run in runs:
            if run.isalpha() and run.islower():
                ids = [token.id for token in self.model.tokenize(run.decode())]
                known[run] = struct.pack(f"<{len(ids)}I", *ids)
            elif run.decode("utf-8").isalpha():
                letters.append(run)
            else:
                (single if MARK in run else spare).append(run)
        for some, between in ((letters, b" "), (marked, b" " + MARK + b" ")):
            skip = int(some is marked)
            for begin, stop in runs_of_rows([len(r) for r in some], LEARNT_BYTES):
                ids = self._ids(between.join([*some[begin:stop], b""]).decode("utf-8"))
                last = np.flatnonzero(ids == self.mark[0] if skip else self.ends[ids]) + 1
                if len(last) != stop - begin:
                    # Each run ends a word at least; one of them, parted by the normaliser or the pattern, ends more.
                    (single if skip else spare).extend(some[begin:stop])
                    continue
                data, at = ids.tobytes(), 0
                for run, end in zip(some[begin:stop], last.tolist(), strict=True):
                    known[run] = data[4 * at : 4 * (end - skip)]
                    at = end
        known.update((r, self._ids(r.decode("utf-8")).tobytes()) for r in single)
        return known

    def _signs(self, run: bytes) -> int:
        """Where the signs at a run's end begin, if they are a word of their own; else the run's length."""
        stem = run.rstrip(SIGNS)
        if not stem or len(stem) == len(run) or SPECIAL in run:
            return len(run)
        if stem[-1] < 128:
            return len(stem) if stem[-1:].isalnum() else len(run)
        char = stem[-4:].decode("utf-8", "ignore")[-1]
        if char not in self.parted:
            both, apart = self._ids(char + "."), (self._ids(char), self._ids("."))
            self.parted[char] = np.array_equal(both, np.concatenate(apart))
        return len(stem) if self.parted[char] else len(run)

    def _settle(self, runs: list[bytes]) -> list[bytes]:
        """Ids of different runs; short ones are kept."""
        if len(self.known) > KEPT_RUNS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = list(map(known.get, runs))
        cuts = []
        for i in places_of(None, found):
            run = runs[i]
            if run in older:
                found[i] = known[run] = older[run]
            else:
                cuts.append((i, run, self._signs(run)))
        parts = {part for _, run, at in cuts for part in (run[:at], run[at:])}
        made = {part: ids for part in parts if (ids := known.get(part, older.get(part))) is not None} | {b"": b""}
        made |= self._learn([part for part in parts if part not in made])
        for i, run, at in cuts:
            found[i] = made[run] = made[run[:at]] + made[run[at:]]
        known.update((r, ids) for r, ids in made.items() if len(r) <= KEPT_BYTES)
        return found

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        special = pc.match_substring(texts, SPECIAL.decode())
        split = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        runs = split.flatten().dictionary_encode()
        different = runs.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._settle(different), pa.large_binary()).take(runs.indices)
        bounds = np.frombuffer(ids.buffers()[1], dtype=np.int64)[split.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for begin, stop in zip(bounds, bounds[1:]):
            yield bytes(data[begin:stop])


def places_of(value, values: list) -> list[int]:
    places, at = [], -1
    try:
        while True:
            at = values.index(value, at + 1)
            places.append(at)
    except ValueError:
        return places


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str) -> Encoder:
    """A worker's encoder, which later tasks use too."""
    return Encoder(vocabulary)


TOKENISED = pa.schema([
    ("doc_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("doc_tokens", pa.int64()),
    ("full_before", pa.int64()), ("full_crcs", pa.list_(pa.int64())),
    ("rest", pa.int32()), ("local", pa.int64()), ("rest_crc", pa.int64()), ("rest_ids", pa.binary()),
])
TOKENISED_DDL = (
    "doc_id long, part int, number long, doc_tokens long, full_before long, full_crcs array<long>, "
    "rest int, local long, rest_crc long, rest_ids binary"
)
BATCH_BYTES = 4 << 20


def runs_of_rows(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``most`` bytes; a longer row is a run of its own."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def tokenised(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, closing: int = CLOSING_ID) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): lengths, digests of full pieces, what is left over, its rank in the task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), encoder_of(vocabulary)
        end = np.array([closing], dtype="<u4").tobytes()
        seen = np.zeros(size, dtype=np.int64)
        number = full = 0
        for batch in batches:
            texts = batch.column("text")
            ids_of = batch.column("doc_id").to_pylist()
            for begin, stop in runs_of_rows(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH_BYTES):
                rows = []
                gc.disable()
                for doc_id, ids in zip(ids_of[begin:stop], encoder.encode(texts.slice(begin, stop - begin)), strict=True):
                    ids += end
                    n, step = len(ids) // 4, 4 * size
                    whole, rest = divmod(n, size)
                    crcs = [zlib.crc32(ids[i * step : (i + 1) * step]) for i in range(whole)]
                    tail = ids[whole * step :]
                    rows.append((doc_id, part, number, n, full, crcs, rest, int(seen[rest]), zlib.crc32(tail), tail))
                    seen[rest] += 1
                    number, full = number + 1, full + whole
                gc.enable()
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TOKENISED, strict=True)], schema=TOKENISED)

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(encode, TOKENISED_DDL)


class Placement(NamedTuple):
    """Pieces of ``length`` from rank ``rank``: ``times`` to each pack from ``pack`` on, laid from ``offset``."""

    length: int
    rank: int
    times: int
    pack: int
    offset: int


class Run(NamedTuple):
    """Packs of one pattern: consecutive numbers, equally full."""

    fill: int
    pack: int
    count: int


def raised(fills: np.ndarray, length: int, level: int, size: int) -> np.ndarray:
    """Pieces a pack of each fill takes until none that has room is shorter than ``level``."""
    return np.clip(-(-(level - fills) // length), 0, (size - fills) // length)


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> tuple[list[Placement], list[Run]]:
    """Placements of all pieces, and the packs they make."""
    placements: list[Placement] = []
    runs: list[Run] = []
    packs = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        able = sorted((r for r in runs if r.fill + length <= size))
        after = [r for r in runs if r.fill + length > size]
        if able:
            fills = np.array([r.fill for r in able])
            counts = [r.count for r in able]
            taken = lambda level: sum(c * int(t) for c, t in zip(counts, raised(fills, length, level, size), strict=True))  # noqa: E731, B023
            low, high = 0, size
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if taken(middle) <= left else (low, middle - 1)
            times = raised(fills, length, low, size).tolist()
            left -= sum(c * t for c, t in zip(counts, times, strict=True))
            more = [0] * len(able)
            for i in sorted(range(len(able)), key=lambda i: able[i].fill + times[i] * length):
                if able[i].fill + (times[i] + 1) * length <= size:
                    more[i] = min(left, able[i].count)
                    left -= more[i]
            for run, least, extra in zip(able, times, more, strict=True):
                for count, pack, t in ((extra, run.pack, least + 1), (run.count - extra, run.pack + extra, least)):
                    if count and t:
                        placements.append(Placement(length, rank, t, pack, run.fill))
                        rank += count * t
                    if count:
                        after.append(Run(run.fill + t * length, pack, count))
        each = size // length
        for count, t in ((left // each, each), (1, left % each)):
            if count and t:
                placements.append(Placement(length, rank, t, packs, 0))
                after.append(Run(t * length, packs, count))
                rank, packs = rank + count * t, packs + count
        runs = after
    return placements, runs


class Plan(NamedTuple):
    """Placements as sorted arrays; ``stream`` is where a run of loose packs begins in the row of them, or -1."""

    key: np.ndarray
    rank: np.ndarray
    times: np.ndarray
    pack: np.ndarray
    offset: np.ndarray
    runs: np.ndarray
    fill: np.ndarray
    stream: np.ndarray
    packs: int
    loose: int


def planned(histogram: dict[int, int], size: int = SEQUENCE) -> Plan:
    """The packing of a histogram, with the loose packs laid end to end."""
    placements, runs = shortest_pack_first(histogram, size)
    placements.sort(key=lambda p: (p.length, p.rank))
    runs.sort(key=lambda r: r.pack)
    stream, at = [], 0
    for r in runs:
        loose = r.fill < size and r.fill & (r.fill - 1) != 0
        stream.append(at if loose else -1)
        at += r.fill * r.count if loose else 0
    column = lambda values: np.array(list(values), dtype=np.int64)
    return Plan(
        column((p.length << 48) + p.rank for p in placements),
        *(column(getattr(p, f) for p in placements) for f in ("rank", "times", "pack", "offset")),
        column(r.pack for r in runs), column(r.fill for r in runs), column(stream),
        sum(r.count for r in runs), at,
    )


PLACED_DDL = "sequence_id long, offset long, stream long"


def placed(plan: Plan):
    """Column function (length, rank) -> where the piece lies; ``stream`` is null unless its pack is loose."""

    @F.pandas_udf(PLACED_DDL)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, ranks = length.to_numpy().astype(np.int64), rank.to_numpy()
        at = np.searchsorted(plan.key, (size << 48) + ranks, side="right") - 1
        pack, slot = np.divmod(ranks - plan.rank[at], plan.times[at])
        pack = pack + plan.pack[at]
        offset = plan.offset[at] + slot * size
        run = np.searchsorted(plan.runs, pack, side="right") - 1
        base = plan.stream[run]
        stream = pd.array(base + (pack - plan.runs[run]) * plan.fill[run] + offset, dtype="Int64")
        stream[base < 0] = pd.NA
        return pd.DataFrame({"sequence_id": pack, "offset": offset, "stream": stream})

    return place


def tail_sizes(n: int) -> list[int]:
    """The powers of two that make ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def cut(loose: DataFrame, plan: Plan, size: int = SEQUENCE) -> DataFrame:
    """Loose pieces (..., rest, stream) cut to (..., piece_start, length, sequence_id, offset)."""
    last = plan.loose - plan.loose % size
    marks = np.cumsum([last, *tail_sizes(plan.loose % size)]).tolist()
    begin, end = F.col("stream"), F.col("stream") + F.col("rest")
    next_full = F.least((F.floor(begin / size) + 1) * size, F.lit(last))
    inside = F.filter(F.array_distinct(F.array(next_full, *(F.lit(m) for m in marks))), lambda m: (m > begin) & (m < end))
    points = F.array_sort(F.concat(F.array(begin), inside))
    stops = F.concat(F.slice(points, 2, F.size(points)), F.array(end))
    tails = F.array(*(F.lit(m) for m in marks))
    whole = loose.select("*", F.explode(F.arrays_zip(points.alias("a"), stops.alias("b"))).alias("cut"))
    a = F.col("cut.a")
    number = F.size(F.filter(tails, lambda m: m <= a))
    in_tail = a >= last
    return whole.select(
        *(c for c in loose.columns if c not in ("sequence_id", "offset")),
        (a - begin).alias("piece_start"),
        (F.col("cut.b") - a).alias("length"),
        F.when(in_tail, plan.packs + last // size + number - 1).otherwise(plan.packs + F.floor(a / size)).alias("sequence_id"),
        F.when(in_tail, a - F.element_at(tails, F.greatest(number, F.lit(1)))).otherwise(a % size).alias("offset"),
    )


def ranked(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``rank`` among the left-over pieces of their length and ``full_rank`` of their first full piece."""
    before = lambda *keys: Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_task = tokens.groupBy("part").agg(F.sum(F.size("full_crcs")).alias("n"))
    # One row a task of the first pass.
    full = by_task.select(F.col("part"), F.coalesce(F.sum("n").over(before(F.lit(0))), F.lit(0)).alias("full_base"))
    by_length = tokens.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"))
    base = by_length.select("part", "rest", F.coalesce(F.sum("n").over(before("rest")), F.lit(0)).alias("rest_base"))
    return (
        tokens.join(base.join(full, "part"), ["part", "rest"])
        .withColumn("rank", F.col("rest_base") + F.col("local"))
        .withColumn("full_rank", F.col("full_base") + F.col("full_before"))
        .drop("rest_base", "full_base")
    )


def packed(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, closing: int = CLOSING_ID) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = materialise(tokenised(docs, vocabulary, size, closing), "packing-tokens")
    counted = tokens.filter("rest > 0").groupBy("rest").count().collect()
    plan = planned({r["rest"]: r["count"] for r in counted}, size)
    where = F.when(F.col("rest") > 0, placed(plan)("rest", "rank"))
    # Read three times below.
    slim = materialise(ranked(tokens.drop("rest_ids")).select("*", where.alias("at")), "packing-places")
    result = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    first = plan.packs + plan.loose // size + len(tail_sizes(plan.loose % size))
    full = slim.select("doc_id", "doc_tokens", "full_rank", F.posexplode("full_crcs").alias("i", "ids_crc32")).select(
        "doc_id", (F.col("i").cast("long") * size).alias("start"), F.lit(size).cast("long").alias("length"), "ids_crc32",
        "doc_tokens", (F.lit(first) + F.col("full_rank") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    begin = F.col("doc_tokens") - F.col("rest")
    rest = slim.filter("rest > 0").select(
        "doc_id", "part", "number", "doc_tokens", F.col("rest").cast("long").alias("rest"), "rest_crc",
        "at.*",
    )
    bound = rest.filter("stream IS NULL").select(
        "doc_id", begin.alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
    loose = cut(rest.filter("stream IS NOT NULL"), plan, size)
    whole = loose.filter("length = rest").withColumn("ids_crc32", F.col("rest_crc"))
    ids = tokens.select("part", "number", "rest_ids")
    # Few as a rule; written, so that the planner knows how few before it shuffles the ids.
    divided = materialise(loose.filter("length < rest"), "packing-cuts").join(ids, ["part", "number"]).withColumn(
        "ids_crc32", F.crc32(F.expr("substring(rest_ids, cast(4 * piece_start + 1 as int), cast(4 * length as int))"))
    )
    loose_rows = [d.withColumn("start", begin + F.col("piece_start")).select(*result) for d in (whole, divided)]
    return full.select(*result).unionAll(bound.select(*result)).unionAll(loose_rows[0]).unionAll(loose_rows[1])
