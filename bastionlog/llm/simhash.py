"""SimHash near-duplicates through a Gray-order hierarchical index.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. Equal fingerprints are
one node from then on. Two fingerprints that differ in at most ``d`` bits agree in one of ``d + 1`` bit
blocks, so fingerprints meet by the value of a block. Within it they are dealt out by range of their Gray
rank (the place of the bit pattern in the Gray sequence, where neighbours differ in one bit), so a block
value that holds a third of all fingerprints spreads over many chunks. A chunk is a node of the index:
the bits all its members share, as mask and pattern. Chunks of one block value are paired only if their
shared bits differ in at most ``d`` places. Inside a pair of chunks the same index goes on: runs of members
in Gray order, runs of runs above, each with its shared bits; a pair of groups is given up as soon as
the differences in shared bits exceed ``d``. What is left is compared member by member.

A pair of chunks returns a spanning forest of its links, never all pairs. Components of the forests'
union are those of all links.

Cases: null, empty and blank texts have fingerprint zero and link like any other. Repeated rows each give
a row. A null doc_id has a row and a component, and is the smallest id only where there is no other. An
empty table gives an empty result. Columns other than doc_id and text are not looked at; whole texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.llm.components import components
from bastionlog.llm.words import lower_ascii
from bastionlog.session import materialise

SHINGLE = 4
SEED = 42
DIFFERENCE = 4
CHUNK_ROWS = 1 << 14
LEAF = 32
FAN = 8
COUNT_ROWS = 1 << 14


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit majority of the XXH64 hashes of the word shingles, repeats included."""
    words = lower_ascii(text).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[b:e], SEED) for b, e in zip(begins, stops, strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, COUNT_ROWS):
        part = hashes[at : at + COUNT_ROWS]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """long: the fingerprint's bits as a signed number."""

    @F.pandas_udf("long")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return bits(text)


def gray_rank(bits: Column) -> Column:
    """Place in the Gray sequence, as a signed number in the same order."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def blocks(bits: Column, difference: int) -> Column:
    """array<long>: number and value of each of ``difference + 1`` bit blocks."""
    edges = [64 * i // (difference + 1) for i in range(difference + 2)]
    return F.array(
        *(
            F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(i << 56)
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        )
    )


def apart(a_all, a_any, b_all, b_any):
    """Bits that all of one group share and all of another share otherwise: a lower bound of differences."""
    shared = ~(a_all ^ a_any) & ~(b_all ^ b_any)
    return np.bitwise_count((a_all ^ b_all) & shared)


class GrayIndex:
    """Levels of groups over fingerprints in Gray order; a group keeps its bitwise AND and OR."""

    def __init__(self, members: np.ndarray) -> None:
        self.members = members
        self.levels = []
        both, size = (members, members), LEAF
        while True:
            cuts = np.arange(0, len(both[0]), size)
            both = np.bitwise_and.reduceat(both[0], cuts), np.bitwise_or.reduceat(both[1], cuts)
            self.levels.append(both)
            if len(cuts) == 1:
                break
            size = FAN


def close_groups(a: GrayIndex, b: GrayIndex, difference: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaf groups that shared bits do not keep apart, from the top level down."""
    levels_a, levels_b = list(a.levels), list(b.levels)
    while len(levels_a) < len(levels_b):
        levels_a.append(levels_a[-1])
    while len(levels_b) < len(levels_a):
        levels_b.append(levels_b[-1])
    i = j = np.zeros(1, dtype=np.int64)
    for depth in range(len(levels_a) - 1, -1, -1):
        (a_all, a_any), (b_all, b_any) = levels_a[depth], levels_b[depth]
        near = apart(a_all[i], a_any[i], b_all[j], b_any[j]) <= difference
        if a is b:
            near &= i <= j
        i, j = i[near], j[near]
        if depth:
            fan_a, fan_b = FAN if depth < len(a.levels) else 1, FAN if depth < len(b.levels) else 1
            step = np.arange(fan_a * fan_b)
            i, j = (i[:, None] * fan_a + step // fan_b).ravel(), (j[:, None] * fan_b + step % fan_b).ravel()
            inside = (i < len(levels_a[depth - 1][0])) & (j < len(levels_b[depth - 1][0]))
            i, j = i[inside], j[inside]
    return i, j


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked positions one label, the smallest position of their component, in place."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j = i[differ], j[differ]
        low, high = np.minimum(a[differ], b[differ]), np.maximum(a[differ], b[differ])
        np.minimum.at(label, high, low)
        while not np.array_equal(label[label], label):
            label[:] = label[label]


def forest(a: np.ndarray, b: np.ndarray | None, difference: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within ``a``, or between ``a`` and ``b``; members are in Gray order."""
    one = GrayIndex(a)
    two = one if b is None else GrayIndex(b)
    members = a if b is None else np.concatenate((a, b))
    shift = 0 if b is None else len(a)
    label = np.arange(len(members))
    left, right = close_groups(one, two, difference)
    step = np.arange(LEAF)
    for at in range(0, len(left), 2048):
        i = left[at : at + 2048, None] * LEAF + step
        j = right[at : at + 2048, None] * LEAF + step
        x, y = a[np.minimum(i, len(a) - 1)], two.members[np.minimum(j, len(two.members) - 1)]
        near = np.bitwise_count(x[:, :, None] ^ y[:, None, :]) <= difference
        near &= (i < len(a))[:, :, None] & (j < len(two.members))[:, None, :]
        pair, p, q = np.nonzero(near)
        merge_labels(label, i[pair, p], j[pair, q] + shift)
    child = np.flatnonzero(label != np.arange(len(label)))
    return members[label[child]], members[child]


def cell_links(batches: Iterator[pd.DataFrame], difference: int) -> Iterator[pd.DataFrame]:
    """Links of cells; rows come sorted by cell, side and Gray rank, and a cell is bounded."""

    def done(cell: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        members, side = cell["bits"].to_numpy().view(np.uint64), cell["side"].to_numpy()
        cut = int(np.searchsorted(side, 1))
        return forest(members[:cut], members[cut:] if cut < len(members) else None, difference)

    held: list[pd.DataFrame] = []
    names = ["bucket", "one", "two"]
    for batch in batches:
        if not len(batch):
            continue
        key = batch[names].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        parts = [batch.iloc[s:e] for s, e in zip([0, *cuts], [*cuts, len(batch)], strict=True)]
        if held and tuple(held[-1][names].iloc[0]) == tuple(key[0]):
            held.append(parts.pop(0))
        ready = ([pd.concat(held)] if held and parts else []) + parts[:-1]
        if parts:
            held = [parts[-1]]
        found = [done(c) for c in ready if len(c) > 1]
        if found:
            yield linked(found)
    if held and sum(map(len, held)) > 1:
        yield linked([done(pd.concat(held))])


def linked(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({n: np.concatenate([f[k] for f in found]).view(np.int64) for k, n in enumerate("uv")})


def links(nodes: DataFrame, difference: int = DIFFERENCE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Links (u, v) of distinct ``bits`` that leave the components of all links as they are."""
    count = nodes.count() * (difference + 1)
    keyed = materialise(
        nodes.select("bits", F.explode(blocks(F.col("bits"), difference)).alias("bucket"))
        .withColumn("rank", gray_rank(F.col("bits")))
        .repartitionByRange(max(1, -(-count // chunk_rows)), "bucket", "rank")
        .withColumn("chunk", F.spark_partition_id()),
        "simhash-chunks",
    )
    groups = keyed.groupBy("bucket", "chunk").agg(F.bit_and("bits").alias("every"), F.bit_or("bits").alias("some"))
    spread = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    split = materialise(groups.join(spread, "bucket"), "simhash-groups")
    left = split.select("bucket", F.col("chunk").alias("one"), F.col("every").alias("e1"), F.col("some").alias("s1"))
    right = split.select("bucket", F.col("chunk").alias("two"), F.col("every").alias("e2"), F.col("some").alias("s2"))
    same = F.bitwise_not(F.col("e1").bitwiseXOR(F.col("s1"))).bitwiseAND(F.bitwise_not(F.col("e2").bitwiseXOR(F.col("s2"))))
    pairs = left.join(right, "bucket").filter(
        (F.col("one") < F.col("two")) & (F.bit_count(F.col("e1").bitwiseXOR(F.col("e2")).bitwiseAND(same)) <= difference)
    ).select("bucket", "one", "two")
    own = keyed.select("bucket", F.col("chunk").alias("one"), F.col("chunk").alias("two"), F.lit(0).alias("side"), "rank", "bits")
    cells = own
    for side, end in enumerate(("one", "two")):
        met = keyed.withColumnRenamed("chunk", end).join(pairs, ["bucket", end])
        cells = cells.unionAll(met.select("bucket", "one", "two", F.lit(side).alias("side"), "rank", "bits"))
    dealt = cells.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "side", "rank")
    return dealt.select("bucket", "one", "two", "side", "bits").mapInPandas(
        lambda batches: cell_links(batches, difference), "u long, v long"
    )


def grouped(marked: DataFrame, difference: int = DIFFERENCE) -> DataFrame:
    """(bits, component_id, leader) of each distinct fingerprint of ``marked`` (doc_id, bits); the
    leader is the fingerprint of the component's smallest doc_id."""
    nodes = materialise(marked.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes, difference), "simhash-links")
    led = nodes.join(roots, nodes["bits"] == roots["node"], "left").select(
        "bits", "first_id", F.coalesce("root", "bits").alias("root")
    )
    first = F.min(F.struct(F.col("first_id").isNull(), "first_id", "bits"))
    smallest = led.groupBy("root").agg(first.alias("first"))
    return led.join(smallest, "root").select(
        "bits", F.col("first.first_id").alias("component_id"), F.col("first.bits").alias("leader")
    )


def near_duplicates(docs: DataFrame, difference: int = DIFFERENCE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    marked = materialise(docs.select("doc_id", fingerprint(F.col("text")).alias("bits")), "simhash-marks")
    found = grouped(marked, difference)
    return marked.join(found.select("bits", "component_id"), "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, difference: int = DIFFERENCE) -> DataFrame:
    """One row of each component of ``docs``, that with the smallest doc_id, with the columns it came with.

    Rows are known by one key of fingerprint and id, so the texts are shuffled once for both the look-up
    of the first rows and the removal of repeated ones.
    """

    def key(bits: Column, doc_id: Column) -> Column:
        return F.concat(bits.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))

    marked = docs.withColumn("_bits", fingerprint(docs["text"]))
    marks = materialise(marked.select("doc_id", F.col("_bits").alias("bits")), "simhash-marks")
    first = grouped(marks, difference).filter("bits = leader").select(key(F.col("bits"), F.col("component_id")).alias("_first"))
    known = marked.withColumn("_first", key(F.col("_bits"), F.col("doc_id"))).drop("_bits")
    return known.join(first, "_first", "left_semi").dropDuplicates(["_first"]).drop("_first")
