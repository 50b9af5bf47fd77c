"""Removal of word passages that stand earlier in the corpus, by difference-cover anchors.

A passage is a window of 20 words. Windows of 8 words are hashed only at positions whose remainder by 13
lies in the difference cover {0, 1, 3, 9}: every remainder is a difference of two members, so two equal
windows of 20 words, wherever they begin, share an equal anchor at the same offset (8 + 13 - 1 = 20). Only
windows that hold an anchor seen twice are extended to their 20 words, hashed and compared; the first in
order of (doc_id, position) stays, the others' words go.

Documents meet in blocks by a hash of id and text, so rows that share an id spread; equal rows are one row
with a count, and what is left of the further ones is known without looking. A block sends each distinct hash once, packed by bucket of
the hash: a passage in a third of all documents is one entry a block, and no bucket gathers more than its
share. A bucket answers each block with a bit per entry. Blocks are made by one shuffle of the texts that
all three passes read; what else is shuffled is a few bytes an anchor or window.

Anchors are told apart by their bucket and 40 bits, as a false meeting only costs an extension. Windows
are told apart by their bucket, from one hash, and 64 bits of another.

Cases: null and blank texts have no words, and the digest of nothing. Texts of fewer words than a window
lose none. Rows of one id are documents one after another, in order of a digest of their texts. Null ids come
last (beside an id of 2^63 - 1). Ids are whole numbers throughout. An empty table gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bastionlog.llm import words as W

WINDOW, ANCHOR, PERIOD = 20, 8, 13
COVER = (0, 1, 3, 9)
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
LAST = int(np.iinfo(np.int64).max)
BUCKET_POWERS = W.Powers(np.uint64(0xD6E8FEB86659FD93))


def window_buckets(words: np.ndarray, at: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """Bucket of the windows at ``at``, from another hash than ``window_hashes``."""
    up, down = BUCKET_POWERS.upto(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return (W.mix((total[at + size] - total[at]) * down[at]) % np.uint64(buckets)).astype(np.int64)


class Block:
    """The documents of a block in order, and their words."""

    def __init__(self, rows: pd.DataFrame, buckets: int) -> None:
        order = rows["place"].to_numpy(dtype=np.int64)
        texts = [W.raw(t) for t in rows["text"]]
        tie = np.array([int.from_bytes(hashlib.sha256(t).digest()[:4], "big") for t in texts], dtype=np.uint32)
        by = sorted(range(len(texts)), key=lambda i: (order[i], tie[i], texts[i]))
        self.rows, self.buckets = rows.iloc[by], buckets
        self.order, self.tie, self.texts = order[by], tie[by], [texts[i] for i in by]
        data, starts, ends, self.first = W.joined(self.texts, W.NOT_BLANK)
        self.counts = np.diff(self.first)
        self.words = W.span_hashes(data, starts, ends)
        self.doc = np.repeat(np.arange(len(self.texts)), self.counts)
        self.position = np.arange(len(self.words)) - self.first[self.doc]
        self._anchors()

    def _anchors(self) -> None:
        """Distinct anchors in order of (bucket, hash), and which of them stands at each anchor's place."""
        here = np.isin(self.position % PERIOD, COVER) & (self.position + ANCHOR <= self.counts[self.doc])
        self.places = np.flatnonzero(here)
        hashes = W.window_hashes(self.words, ANCHOR)[self.places] if len(self.places) else np.empty(0, np.uint64)
        key = ((hashes & np.uint64(0xFFFFFF)) % np.uint64(self.buckets)) << np.uint64(40) | hashes >> np.uint64(24)
        self.anchors, self.which, self.times = np.unique(key, return_inverse=True, return_counts=True)
        self.anchor_bucket = (self.anchors >> np.uint64(40)).astype(np.int64)

    def anchor_packs(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, five bytes of each anchor)."""
        low = (self.anchors & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        yield from ((b, low[s:e].tobytes()) for b, s, e in parts(self.anchor_bucket))

    def extend(self, answers: dict[int, bytes]) -> None:
        """Windows that hold an anchor seen twice, grouped by (bucket, hash), in order within a group."""
        seen = bits_of(self.anchor_bucket, answers) | (self.times > 1)
        at = self.places[seen[self.which]]
        last = self.first[1:] - WINDOW
        begin = np.maximum(self.first[:-1][self.doc[at]], at - (PERIOD - 1))
        end = np.minimum(at, last[self.doc[at]])
        begin, end = begin[begin <= end], end[begin <= end]
        change = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, end + 1, -1)
        windows = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        hashes = W.window_hashes(self.words, WINDOW)[windows] if len(windows) else np.empty(0, np.uint64)
        bucket = window_buckets(self.words, windows, WINDOW, self.buckets)
        order = np.lexsort((windows, hashes, bucket))
        self.windows, hashes, bucket = windows[order], hashes[order], bucket[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (bucket[1:] != bucket[:-1])
        self.head = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.window_hash, self.window_bucket = hashes[self.head], bucket[self.head]

    def window_packs(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, hash of each group of equal windows and the place of the first document that has it)."""
        first = self.doc[self.windows[self.head]]
        ids, tie = self.order[first], self.tie[first]
        yield from ((b, packed(self.window_hash[s:e], ids[s:e], tie[s:e])) for b, s, e in parts(self.window_bucket))

    def results(self, answers: dict[int, bytes]) -> pd.DataFrame:
        """What stays of each document, by whether the block's first of each group is the corpus's first."""
        first = bits_of(self.window_bucket, answers)
        again = np.ones(len(self.windows), dtype=bool)
        again[self.head] = ~first
        change = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(change, self.windows[again], 1)
        np.add.at(change, self.windows[again] + WINDOW, -1)
        kept = np.cumsum(change)[:-1] == 0
        total = np.concatenate(([0], np.cumsum(~kept)))
        removed = total[self.first[1:]] - total[self.first[:-1]]
        made = []
        for i, text in enumerate(self.texts):
            own = text.split()
            if removed[i]:
                own = compress(own, kept[self.first[i] : self.first[i + 1]].tolist())
            n, whole = int(self.counts[i]), int(self.counts[i]) >= WINDOW
            made.append((n, int(removed[i]), hashlib.sha256(b" ".join(own)).hexdigest()))
            # Every word of a further equal row lies in a window that stands earlier, if there is a window.
            again = (n, n, hashlib.sha256(b"").hexdigest()) if whole else made[-1]
            made += [again] * (int(self.rows["copies"].iloc[i]) - 1)
        copies = self.rows["copies"].to_numpy()
        places, missing = (np.repeat(self.rows[c].to_numpy(), copies) for c in ("place", "missing"))
        result = pd.DataFrame(made, columns=["n_words", "n_removed", "kept_sha256"])
        result.insert(0, "doc_id", pd.arrays.IntegerArray(places.astype(np.int64), missing.astype(bool)))
        return result


def parts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of a sorted array."""
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    yield from ((int(bucket[s]), s, e) for s, e in zip(cuts, cuts[1:], strict=False) if e > s)


def bits_of(bucket: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """The answered bits of entries that are sorted by bucket."""
    bits = [np.unpackbits(np.frombuffer(answers[b], dtype=np.uint8), count=e - s) for b, s, e in parts(bucket)]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, dtype=bool)


def packed(hashes: np.ndarray, ids: np.ndarray, tie: np.ndarray) -> bytes:
    """Hashes, ties, and ids less their smallest in as few bytes as they need."""
    base = int(ids.min())
    more = (ids.astype(object) - base if int(ids.max()) - base >= 1 << 63 else ids - base).astype("<u8")
    width = max(1, (int(more.max()).bit_length() + 7) // 8)
    head = np.array([len(ids), base, width], dtype="<i8").tobytes()
    return head + hashes.astype("<u8").tobytes() + tie.astype("<u4").tobytes() + more.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, base, width = np.frombuffer(data, dtype="<i8", count=3).tolist()
    hashes = np.frombuffer(data, dtype="<u8", count=n, offset=24)
    tie = np.frombuffer(data, dtype="<u4", count=n, offset=24 + 8 * n)
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=24 + 12 * n).reshape(n, width)
    return hashes, tie, (wide.view("<u8").ravel() + np.uint64(base & (1 << 64) - 1)).view(np.int64)


def answered(rows: pd.DataFrame, sizes: list[int], flags: np.ndarray, bucket: int) -> pd.DataFrame:
    """A row of bits for each block's pack."""
    cuts = np.cumsum(sizes)[:-1]
    bits = [np.packbits(f).tobytes() for f in np.split(flags, cuts)]
    return pd.DataFrame({"block": rows["block"].to_numpy(), "bucket": bucket, "bits": bits})


def seen_twice(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's anchors, those that more than one block sent."""
    wide = []
    for data in rows["data"]:
        entry = np.zeros((len(data) // 5, 8), dtype=np.uint8)
        entry[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
        wide.append(entry.view("<u8").ravel())
    anchors = np.concatenate(wide)
    order = np.argsort(anchors, kind="stable")
    equal = anchors[order][1:] == anchors[order][:-1]
    flags = np.zeros(len(anchors), dtype=bool)
    flags[order[1:][equal]] = True
    flags[order[:-1][equal]] = True
    return answered(rows, [len(w) for w in wide], flags, key[0])


def seen_first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's windows, those whose block holds the corpus's first."""
    sent = [unpacked(d) for d in rows["data"]]
    sizes = [len(h) for h, _, _ in sent]
    hashes, tie, ids = (np.concatenate([s[k] for s in sent]) for k in (0, 1, 2))
    order = np.lexsort((np.repeat(rows["block"].to_numpy(), sizes), tie, ids, hashes))
    flags = np.zeros(len(hashes), dtype=bool)
    flags[order[np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))]] = True
    return answered(rows, sizes, flags, key[0])


def without_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    doc_id = F.col("doc_id").cast("long")
    dealt = docs.select(
        F.pmod(F.xxhash64(doc_id, "text"), F.lit(blocks)).alias("block"),
        F.coalesce(doc_id, F.lit(LAST)).alias("place"), doc_id.isNull().alias("missing"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # The shuffle by block serves this count and the three passes; equal rows never meet in a group.
    dealt = dealt.repartition("block").groupBy("block", "place", "missing", "text").agg(F.count(F.lit(1)).alias("copies"))
    pack, answer = "block long, bucket long, data binary", "block long, bucket long, bits binary"

    def packs(key: tuple, made: Iterator[tuple[int, bytes]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], b, d) for b, d in made], columns=["block", "bucket", "data"])

    def answers(rows: pd.DataFrame, step: int) -> dict[int, bytes]:
        own = rows[rows["step"] == step]
        return dict(zip(own["bucket"].tolist(), own["bits"].tolist(), strict=True))

    def send_anchors(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return packs(key, Block(rows, buckets).anchor_packs())

    def send_windows(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows, buckets)
        block.extend(answers(told, 1))
        return packs(key, block.window_packs())

    def finish(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows, buckets)
        block.extend(answers(told, 1))
        return block.results(answers(told, 2))

    grouped = dealt.groupBy("block")
    sent = grouped.applyInPandas(send_anchors, pack)
    one = sent.groupBy("bucket").applyInPandas(seen_twice, answer).withColumn("step", F.lit(1))
    sent = grouped.cogroup(one.groupBy("block")).applyInPandas(send_windows, pack)
    two = sent.groupBy("bucket").applyInPandas(seen_first, answer).withColumn("step", F.lit(2))
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return grouped.cogroup(one.unionAll(two).groupBy("block")).applyInPandas(finish, result)
