"""Benchmark decontamination with suffix arrays over the training texts.

Training texts are cut into shards of a few megabytes where they lie; no text is shuffled. Each shard
builds a suffix array of its words, ordered by as many words as a window holds. All suffixes of the
benchmark items are searched in it together: the interval of matching suffixes is narrowed word by word
with two binary searches, so each ends with the places of its full matches. Words the benchmark does not
hold are one filler that matches nothing, and no suffix starts there. Full matches are then extended: the
matched places of a shard and the item places of the same windows are sorted as suffixes of window numbers,
and the nearest item suffix of a place shares the longest verbatim match that starts there.

The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text; a document's spans from
several blocks are united. All blocks stay with the tasks until the end, so a benchmark of many blocks
needs as much memory.

Cases: a null or blank text has no words, ``n_hit`` 0 and is not contaminated. An item without words has
no window; a shorter item than the window is one window of its own length. Equal windows of several items
count for each of them; repeated rows of an item count once. A null item_id names no item but its words
still hit. Repeated documents and null doc_ids each give a row. Other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.llm import words as W

WINDOW = 13
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20
LONGEST = "struct<words:long,start:long,item_id:string>"
FOUND = f"n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest {LONGEST}"


class Suffixes:
    """The distinct windows of a block of items, as sequences of word numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        rows: dict[tuple[int, ...], int] = {}
        places: list[int] = []
        holders: list[int] = []
        self.ids: list[str | None] = []
        for item_id, text in sorted(set(items), key=lambda i: (i[0] is None, i[0] or "", i[1] or "")):
            data = np.frombuffer(W.lower_ascii(text), dtype=np.uint8)
            hashes = W.span_hashes(data, *W.spans(data, W.WORD_BYTES)).tolist()
            for at in range(max(1, len(hashes) - window + 1) if hashes else 0):
                sequence = tuple(hashes[at : at + window])
                owners[sequence].update([item_id] if item_id is not None else [])
                rows.setdefault(sequence, len(rows))
                if len(sequence) == window:
                    places.append(rows[sequence] + 1)
            # A zero ends the item.
            places.append(0)
            holders += [len(self.ids)] * (len(places) - len(holders))
            self.ids.append(item_id)
        self.places, self.holders = np.array(places, dtype=np.int64), np.array(holders, dtype=np.int64)
        self.vocabulary = np.unique(np.array([h for w in owners for h in w], dtype=np.uint64))
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.window = window
        self.lengths = np.array([len(w) for w in owners], dtype=np.int64)
        self.numbers = np.zeros((len(owners), window), dtype=np.int64)
        for row, sequence in enumerate(owners):
            self.numbers[row, : len(sequence)] = np.searchsorted(self.vocabulary, np.array(sequence, np.uint64)) + 1
        self.items = [sorted(v) for v in owners.values()]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1; 0 for words that no item holds."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def suffix_array(numbers: np.ndarray, window: int, bits: int) -> np.ndarray:
    """Starts of suffixes ordered by their first ``window`` words; ``numbers`` ends with enough zeros.

    Several word numbers fit one 64-bit key; the keys are sorted last word first.
    """
    starts = np.flatnonzero(numbers[: len(numbers) - window])
    each = max(1, 63 // bits)
    keys = []
    for low in range(0, window, each):
        key = np.zeros(len(starts), dtype=np.int64)
        for offset in range(low, min(low + each, window)):
            key = (key << bits) | numbers[starts + offset]
        keys.append(key)
    return starts[np.lexsort(keys[::-1])]


def bisect(column, low: np.ndarray, high: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """Many binary searches at once, each in its own interval of a column sorted there."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        seen = column(np.where(open_, middle, 0))
        up = open_ & ((seen <= value) if right else (seen < value))
        low = np.where(up, middle + 1, low)
        high = np.where(open_ & ~up, middle, high)
    return low


def search(order: np.ndarray, numbers: np.ndarray, wanted: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each wanted window: words of its longest match, and the interval of its full matches in ``order``."""
    n = len(wanted.lengths)
    low, high = np.zeros(n, dtype=np.int64), np.full(n, len(order), dtype=np.int64)
    longest = np.zeros(n, dtype=np.int64)
    for depth in range(wanted.window):
        live = np.flatnonzero((wanted.lengths > depth) & (low < high))
        if not len(live):
            break
        column = lambda at, depth=depth: numbers[order[at] + depth]
        value = wanted.numbers[live, depth]
        first = bisect(column, low[live], high[live], value, right=False)
        last = bisect(column, first, high[live], value, right=True)
        low[live], high[live] = first, last
        longest[live] += first < last
    return longest, low, high


def longest_matches(placed: np.ndarray, wanted: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Per place of ``placed`` (window number from 1, 0 where none is): words of the longest verbatim match with
    an item that starts there, and the place in ``wanted.places`` of one that has it."""
    here = np.flatnonzero(placed)
    seen = np.zeros(len(wanted.numbers) + 1, dtype=bool)
    seen[placed[here]] = True
    seen[0] = False
    there = np.flatnonzero(seen[wanted.places])
    words, holder = np.zeros(len(here), dtype=np.int64), np.zeros(len(here), dtype=np.int64)
    # Runs of neighbouring places, each ended by a zero.
    where = np.concatenate((there, here + len(wanted.places) + 1))
    ends = np.flatnonzero(np.append(np.diff(where) != 1, True)) + 1
    slot = np.arange(len(where)) + np.searchsorted(ends, np.arange(len(where)), side="right")
    symbols = np.zeros(len(where) + len(ends), dtype=np.int64)
    symbols[slot] = np.concatenate((wanted.places[there], placed[here]))
    zeros = np.flatnonzero(symbols == 0)
    end = zeros[np.searchsorted(zeros, np.arange(len(symbols)))]
    longest = int((end - np.arange(len(symbols))).max(initial=0))
    # Ranks of the first 1, 2, 4, ... windows of each suffix, up to the end of its run.
    levels = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
    while (1 << (len(levels) - 1)) < longest:
        rank = levels[-1].astype(np.int64)
        after = rank[np.minimum(np.arange(len(symbols)) + (1 << (len(levels) - 1)), end)]
        levels.append(np.unique(rank * (len(symbols) + 1) + after, return_inverse=True)[1].astype(np.int32))
    order = np.argsort(levels[-1], kind="stable")
    is_item = np.zeros(len(symbols), dtype=bool)
    is_item[slot[: len(there)]] = True
    index = np.arange(len(order))
    before = np.maximum.accumulate(np.where(is_item[order], index, -1))
    behind = np.minimum.accumulate(np.where(is_item[order], index, len(order))[::-1])[::-1]
    position = np.empty(len(order), dtype=np.int64)
    position[order] = index
    mine = slot[len(there) :]
    place_of = np.zeros(len(symbols), dtype=np.int64)
    place_of[slot[: len(there)]] = there
    for near in (before[position[mine]], behind[position[mine]]):
        real = (near >= 0) & (near < len(order))
        other = order[np.where(real, near, 0)]
        one, two, length = mine.copy(), other.copy(), np.zeros(len(mine), dtype=np.int64)
        for level in range(len(levels) - 1, -1, -1):
            step = 1 << level
            fits = real & (one + step <= end[one]) & (two + step <= end[two])
            same = fits & (levels[level][one] == levels[level][two])
            one, two, length = one + same * step, two + same * step, length + same * step
        better = length + wanted.window - 1 > words
        better &= length > 0
        words = np.where(better, length + wanted.window - 1, words)
        holder = np.where(better, place_of[other], holder)
    return words, holder


def scan(texts: list[bytes], wanted: Suffixes) -> Iterator[tuple]:
    """Per lower-cased text: number of words, word spans that windows cover, items with windows there, and the
    longest verbatim match (words, start, item), the first of equally long ones; None without a match."""
    data, starts, ends, first = W.joined(texts, W.WORD_BYTES)
    counts = np.diff(first)
    if not len(starts) or not len(wanted.lengths):
        yield from ((int(n), [], [], None) for n in counts)
        return
    # Zeros after each text keep a window from running into the next one.
    gap = np.arange(len(texts)) * wanted.window
    place = np.arange(len(starts)) + np.repeat(gap, counts)
    numbers = np.zeros(len(starts) + (len(texts) + 1) * wanted.window, dtype=np.int64)
    numbers[place] = wanted.number(W.span_hashes(data, starts, ends))
    order = suffix_array(numbers, wanted.window, wanted.bits)
    longest, low, high = search(order, numbers, wanted)
    full = np.flatnonzero(longest == wanted.lengths)
    sizes = high[full] - low[full]
    which = np.repeat(full, sizes)
    at = order[np.repeat(low[full] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())]
    change = np.zeros(len(numbers) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + wanted.lengths[which], -1)
    covered = np.zeros(len(numbers) + 2, dtype=np.int8)
    covered[1:-1] = np.cumsum(change[:-1]) > 0
    edge = np.diff(covered)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    base = first[:-1] + gap
    owner = np.searchsorted(base, begin, side="right") - 1
    spans_of: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for text, b, e in zip(owner.tolist(), begin.tolist(), stop.tolist(), strict=True):
        spans_of[text].append((b - int(base[text]), e - int(base[text])))
    items_of: dict[int, set[str]] = defaultdict(set)
    if len(at):
        pairs = np.unique(np.stack((np.searchsorted(base, at, side="right") - 1, which)), axis=1)
        for text, window in pairs.T.tolist():
            items_of[text].update(wanted.items[window])
    best: dict[int, tuple[int, int, str | None]] = {}
    if len(at):
        placed = np.zeros(len(numbers), dtype=np.int64)
        whole = wanted.lengths[which] == wanted.window
        placed[at[whole]] = which[whole] + 1
        words, holder = longest_matches(placed, wanted)
        short = ~whole
        starts_at = np.concatenate((np.flatnonzero(placed), at[short]))
        lengths = np.concatenate((words, wanted.lengths[which[short]]))
        source = np.concatenate((holder, -1 - which[short]))
        text_of = np.searchsorted(base, starts_at, side="right") - 1
        rows = np.lexsort((source, starts_at, -lengths, text_of))
        for row in rows[np.append(True, np.diff(text_of[rows]) > 0)].tolist():
            owner_at = int(source[row])
            held_by = wanted.ids[wanted.holders[owner_at]] if owner_at >= 0 else next(iter(wanted.items[-1 - owner_at]), None)
            best[int(text_of[row])] = (int(lengths[row]), int(starts_at[row] - base[text_of[row]]), held_by)
    for i, n in enumerate(counts.tolist()):
        yield n, spans_of.get(i, []), sorted(items_of.get(i, ())), best.get(i)


def scan_column(text: Column, wanted, shard_bytes: int) -> Column:
    """``scan`` over a text column, shard by shard; ``wanted`` is a broadcast of ``Suffixes``."""

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [W.lower_ascii(t) for t in batch]
            rows = [r for b, e in W.shards(texts, shard_bytes) for r in scan(texts[b:e], wanted.value)]
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items", "longest"])

    return found(text)


def united(spans: Column) -> Column:
    """Overlapping or touching spans as one."""

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def merged(lists: pd.Series) -> pd.Series:
        out = []
        for found in lists:
            kept: list[list[int]] = []
            for b, e in sorted((s["start"], s["end"]) for s in found):
                if kept and b <= kept[-1][1]:
                    kept[-1][1] = max(kept[-1][1], e)
                else:
                    kept.append([b, e])
            out.append([(b, e) for b, e in kept])
        return pd.Series(out, dtype=object)

    return merged(spans)


def matches(docs: DataFrame, items: DataFrame, text: str, window: int, shard_bytes: int, block_bytes: int) -> DataFrame:
    """``docs`` with one more column ``_match`` (n_words, spans, items), next to all it has."""
    spark = docs.sparkSession
    size = items.select(F.octet_length("text").cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for block in range(blocks):
        some = items.select(F.col("item_id").cast("string"), "text").filter(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block
        )
        wanted = Suffixes([(r[0], r[1]) for r in some.toLocalIterator()], window)
        parts.append(scan_column(docs[text], spark.sparkContext.broadcast(wanted), shard_bytes))
    if blocks == 1:
        return docs.withColumn("_match", parts[0])
    names = [f"_match_{i}" for i in range(blocks)]
    wide = docs.select("*", *(p.alias(n) for p, n in zip(parts, names, strict=True)))
    gathered = F.struct(
        F.col(f"{names[0]}.n_words").alias("n_words"),
        united(F.flatten(F.array(*(F.col(f"{n}.spans") for n in names)))).alias("spans"),
        F.array_distinct(F.flatten(F.array(*(F.col(f"{n}.items") for n in names)))).alias("items"),
        # Longest first, then leftmost; a null match is less than any.
        F.array_max(F.array(*(F.when(F.col(f"{n}.longest").isNotNull(), F.struct(
            F.col(f"{n}.longest.words").alias("words"), (-F.col(f"{n}.longest.start")).alias("start"),
            F.col(f"{n}.longest.item_id").alias("item_id"))) for n in names))).alias("longest"),
    )
    leftmost = F.struct(
        F.col("_match.longest.words").alias("words"), (-F.col("_match.longest.start")).alias("start"),
        F.col("_match.longest.item_id").alias("item_id"),
    )
    return wide.withColumn("_match", gathered).drop(*names).withColumn(
        "_match", F.col("_match").withField("longest", F.when(F.col("_match.longest").isNotNull(), leftmost))
    )


def hit_words(match: str = "_match") -> Column:
    return F.aggregate(f"{match}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty lies in a benchmark window."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) what of ``items`` (item_id, text) it holds.

    doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_words, longest_start and
    longest_item (the longest verbatim match, its first word in the document, an item that holds it), spans (word spans).
    """
    found = matches(docs.select("doc_id", "text"), items, "text", window, shard_bytes, block_bytes)
    n_hit, n_words = hit_words(), F.col("_match.n_words")
    return found.select(
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_match.items"), ","), 256).alias("items_sha256"),
        is_contaminated(n_hit, n_words).alias("contaminated"),
        F.coalesce("_match.longest.words", F.lit(0)).alias("longest_words"),
        F.col("_match.longest.start").alias("longest_start"),
        F.col("_match.longest.item_id").alias("longest_item"),
        F.col("_match.spans").alias("spans"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns they came with."""
    found = matches(docs, items, "text", window, SHARD_BYTES, BLOCK_BYTES)
    return found.filter(~is_contaminated(hit_words(), F.col("_match.n_words"))).drop("_match")
