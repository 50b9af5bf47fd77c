"""Byte-level byte pair encoding and decoding by a rank file.

Each match of the split pattern is encoded by itself. A segment tree over its byte positions keeps the
leftmost pair of lowest rank at the root; a merge changes three leaves (the merged pair, its left
neighbour, the swallowed position), each in logarithmic time, so a match of n bytes costs n log n however
long it is. Matches of up to 64 bytes are merged many at a time: one row of a matrix holds the tree of
one match. Longer ones have a tree each.

A task works through its texts in shards of about half a megabyte. Splitting, looking up the matches it has
seen, laying out ids and bytes are array operations over the shard. Looked-up matches are known by a
64-bit hash; as the ids of a text must decode to its very bytes, each shard is compared with its input,
and a shard that differs is done again match by match.

The rank file is read once on the driver and broadcast; a vocabulary is bounded by its file.

Cases: null and empty texts have no ids and decode to nothing. A match that is a token as a whole is that
token. Every byte must be in the ranks, else encoding raises ``KeyError``. Repeated rows, null doc_ids and
other columns are kept apart: one row out for each row in. Texts are never cut.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bastionlog.llm.words import raw, shards, span_hashes

SHARD_BYTES = 1 << 19
KEPT_MATCHES = 1 << 18
NEVER = 1 << 62
#: The pattern whose matches are found by array operations; others go through the ``regex`` library.
RUNS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, OTHER, BLANK = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines ``base64(token) rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class LeftmostLowest:
    """Segment tree over positions; the root holds the lowest (rank, position)."""

    def __init__(self, keys: list[int]) -> None:
        self.leaves = 1 << max(0, len(keys) - 1).bit_length()
        self.node = [NEVER] * self.leaves + keys + [NEVER] * (self.leaves - len(keys))
        for i in range(self.leaves - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def lowest(self) -> int:
        return self.node[1]

    def put(self, position: int, key: int) -> None:
        node, i = self.node, self.leaves + position
        node[i] = key
        while i > 1:
            i >>= 1
            node[i] = min(node[2 * i], node[2 * i + 1])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: merge the leftmost pair of lowest rank until no pair has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    width = n.bit_length()
    mask = (1 << width) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def key(at: int) -> int:
        """Of the pair that begins at a live position."""
        middle = after[at]
        if middle >= n:
            return NEVER
        rank = ranks.get(piece[at : after[middle]])
        return NEVER if rank is None else rank << width | at

    tree = LeftmostLowest([key(i) for i in range(n)])
    while (best := tree.lowest()) != NEVER:
        at = best & mask
        gone = after[at]
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        tree.put(gone, NEVER)
        tree.put(at, key(at))
        if before[at] >= 0:
            tree.put(before[at], key(before[at]))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


def laid_out(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[offset : offset + length]`` one after another."""
    before = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    return flat[np.repeat(offsets - before, lengths) + np.arange(int(lengths.sum()))]


class Merger:
    """Merges many short matches at once."""

    WIDEST = 64

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = np.fromiter(sorted(pairs), dtype=np.int64, count=len(pairs))
        self.rank = np.array([pairs[k] for k in self.pairs.tolist()], dtype=np.int64)

    def key(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(rank, position) of pairs; ``NEVER`` for pairs without a rank."""
        wanted = left << 32 | right
        found = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[found] == wanted, self.rank[found] << 7 | at, NEVER)

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of at most ``WIDEST`` bytes one after another, and how many each has."""
        rows, leaves = len(starts), 1 << max(1, int(lengths.max() - 1).bit_length())
        column = np.arange(leaves)
        live = column < lengths[:, None]
        token = np.zeros((rows, leaves + 1), dtype=np.int64)
        token[:, :-1] = self.byte[data[np.minimum(starts[:, None] + column, len(data) - 1)]]
        after = np.tile(np.arange(1, leaves + 2), (rows, 1))
        before = np.tile(np.arange(-1, leaves), (rows, 1))
        tree = np.full((rows, 2 * leaves), NEVER, dtype=np.int64)
        row, at = np.nonzero(column < lengths[:, None] - 1)
        tree[row, leaves + at] = self.key(token[row, at], token[row, at + 1], at)
        for level in range(leaves.bit_length() - 2, -1, -1):
            low = 1 << level
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])

        def put(row: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
            node = leaves + at
            tree[row, node] = key
            for _ in range(leaves.bit_length() - 1):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.flatnonzero(tree[:, 1] != NEVER)
        while len(row):
            best = tree[row, 1]
            at = best & 127
            gone = after[row, at]
            beyond = after[row, gone]
            token[row, at] = best >> 7
            live[row, gone] = False
            after[row, at] = beyond
            before[row, np.minimum(beyond, leaves)] = at
            put(row, gone, NEVER)
            put(row, at, np.where(beyond < lengths[row], self.key(token[row, at], token[row, np.minimum(beyond, leaves)], at), NEVER))
            has = np.flatnonzero(before[row, at] >= 0)
            left = before[row[has], at[has]]
            put(row[has], left, self.key(token[row[has], left], token[row[has], at[has]], left))
            row = row[tree[row, 1] != NEVER]
        return token[:, :-1][live], live.sum(axis=1)


def character_classes() -> np.ndarray:
    """Class of each code point, by the properties the pattern names."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    everything = "".join(map(chr, points.tolist()))
    for name, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for run in regex.finditer(name, everything):
            table[points[run.start() : run.end()]] = value
    return table


def runs(point: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the matches of ``RUNS`` begin in texts laid end to end; ``first`` is where each text begins.

    A run of letters, numbers or others takes one plain space before it along. Of more blanks before it,
    all but the last are a match. An apostrophe that begins a run, with no space to take along, takes a
    contraction's letters from the run behind it.
    """
    n = len(point)
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[first[first < n]] = True
    fresh[n] = True
    new = fresh[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    begin = new.copy()
    solid = np.flatnonzero(new & (kind != BLANK))
    solid = solid[~fresh[solid]]
    solid = solid[kind[solid - 1] == BLANK]
    spaced = solid[point[solid - 1] == 0x20]
    begin[solid - 1] = True
    begin[spaced] = False
    # Contractions.
    def ahead(at: np.ndarray, by: int) -> np.ndarray:
        """The code point so far ahead in the same text, or 0."""
        value = np.where(at + by < n, point[np.minimum(at + by, n - 1)], 0)
        for k in range(1, by + 1):
            value = np.where(fresh[np.minimum(at + k, n)], 0, value)
        return value

    quote = np.flatnonzero(begin & (point == 0x27))
    one, two = ahead(quote, 1), ahead(quote, 2)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for which, length in ((short, 2), (long & ~short, 3)):
        at = quote[which]
        begin[at + 1] = False
        end = at + length
        begin[end[end < n]] = True
    return np.flatnonzero(begin)


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern, self.merger = ranks, pattern, Merger(ranks)
        self.split = regex.compile(pattern)
        self.kind = character_classes() if pattern == RUNS else None
        size = max(ranks.values()) + 1
        content = [b""] * size
        for token, rank in ranks.items():
            content[rank] = token
        self.content = content
        self.token = self.table(content)
        self.decimal = self.table([b",%d" % i for i in range(size)])
        tokens = np.frombuffer(b"".join(content), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in content])
        filled = np.flatnonzero([bool(t) for t in content])
        hashes = span_hashes(tokens, (ends - self.token[2])[filled], ends[filled])
        order = np.argsort(hashes)
        self.seed = hashes[order], filled[order], np.ones(len(order), dtype=np.int64)
        self.forget()

    @staticmethod
    def table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(e) for e in entries], dtype=np.int64)
        return np.frombuffer(b"".join(entries), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths

    def forget(self) -> None:
        """Known matches are the vocabulary's tokens again: hash, offset in ``ids``, number of ids."""
        self.ids = np.arange(len(self.content), dtype=np.int64)
        self.known = self.seed

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Merge matches that are new, and keep their ids."""
        lengths = ends - starts
        added, counts = [], np.zeros(len(starts), dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        width = np.maximum(lengths[order] - 1, 0)
        at = 0
        while at < len(order):
            if lengths[order[at]] > Merger.WIDEST:
                ids = merge(data[starts[order[at]] : ends[order[at]]].tobytes(), self.ranks)
                added.append(np.array(ids, dtype=np.int64))
                counts[order[at]] = len(ids)
                at += 1
                continue
            leaves = 1 << max(1, int(width[at]).bit_length())
            stop = min(int(np.searchsorted(width, leaves)), at + (1 << 17) // leaves)
            stop = min(max(stop, at + 1), int(np.searchsorted(lengths[order], Merger.WIDEST, side="right")))
            some = order[at:stop]
            ids, counts[some] = self.merger.merge(data, starts[some], lengths[some])
            added.append(ids)
            at = stop
        offsets = np.empty(len(starts), dtype=np.int64)
        offsets[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        self.ids = np.concatenate([self.ids, *added])
        at = np.searchsorted(self.known[0], hashes)
        self.known = tuple(np.insert(old, at, new) for old, new in zip(self.known, (hashes, offsets, counts), strict=True))

    def encode_shard(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        whole = b"".join(texts)
        data = np.frombuffer(whole, dtype=np.uint8)
        if not len(data):
            return np.empty(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        if self.kind is None:
            cut = [len(m.encode()) for t in texts for m in self.split.findall(t.decode())]
            ends = np.cumsum(cut)
            starts = ends - cut
        else:
            point = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
            width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
            offset = np.cumsum(width) - width
            first = np.searchsorted(offset, np.cumsum(sizes) - sizes)
            starts = offset[runs(point, self.kind[point], first)]
            ends = np.append(starts[1:], len(data))
        hashes = span_hashes(data, starts, ends)
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known[0]) > KEPT_MATCHES + len(self.seed[0]):
            self.forget()
        place = np.minimum(np.searchsorted(self.known[0], distinct), len(self.known[0]) - 1)
        new = np.flatnonzero(self.known[0][place] != distinct)
        if len(new):
            self.learn(data, starts[example[new]], ends[example[new]], distinct[new])
            place = np.searchsorted(self.known[0], distinct)
        counts = self.known[2][place][which]
        ids = laid_out(self.ids, self.known[1][place][which], counts)
        if not np.array_equal(laid_out(self.token[0], self.token[1][ids], self.token[2][ids]), data):
            each = [merge(data[b:e].tobytes(), self.ranks) for b, e in zip(starts, ends, strict=True)]
            counts, ids = np.array([len(e) for e in each]), np.array([i for e in each for i in e], dtype=np.int64)
        edges = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))]
        return ids, np.diff(edges)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        content = [raw(t) for t in texts]
        for begin, end in shards(content, SHARD_BYTES):
            ids, counts = self.encode_shard(content[begin:end])
            yield from np.split(ids, np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return laid_out(self.token[0], self.token[1][ids], self.token[2][ids]).tobytes()

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return laid_out(self.decimal[0], self.decimal[1][ids], self.decimal[2][ids]).tobytes()[1:]


_made: dict[tuple[str, str], Codec] = {}


def codec(vocabulary: tuple[str, dict[bytes, int]], pattern: str) -> Codec:
    """The worker's codec; what it has merged stays for the worker's later tasks."""
    if (vocabulary[0], pattern) not in _made:
        _made.clear()
        _made[vocabulary[0], pattern] = Codec(vocabulary[1], pattern)
    return _made[vocabulary[0], pattern]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The ranks under a name made of their content."""
    ranks = read_ranks(path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast((name, ranks))


def encode(text: Column, ranks: Broadcast, pattern: str) -> Column:
    """array<int> of ids."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by = codec(ranks.value, pattern)
        for batch in batches:
            yield pd.Series(list(by.encode(batch.tolist())), dtype=object)

    return ids(text)


def decode(ids: Column, ranks: Broadcast, pattern: str) -> Column:
    """binary: the bytes the ids stand for; null ids are none."""

    @F.pandas_udf("binary")
    def content(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by = codec(ranks.value, pattern)
        for batch in batches:
            yield pd.Series([by.decode(np.asarray(() if i is None else i, dtype=np.int64)) for i in batch], dtype=object)

    return content(ids)


def round_trip(text: Column, ranks: Broadcast, pattern: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids, keeps the digests."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by = codec(ranks.value, pattern)
        for batch in batches:
            rows = [
                (len(ids), hashlib.sha256(by.listed(ids)).hexdigest(), hashlib.sha256(by.decode(ids)).hexdigest())
                for ids in by.encode(batch.tolist())
            ]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks = vocabulary(docs.sparkSession, path)
    return docs.select("doc_id", round_trip(F.col("text"), ranks, pattern).alias("d")).select("doc_id", "d.*")
