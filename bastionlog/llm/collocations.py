"""Phrase collocations by sampling with a negative border.

A sample of the documents, chosen by a hash of the text, proposes phrases level by level: those that reach
a lowered count in it. A full pass then counts every phrase that is a word, or all of whose parts (one word
shorter, at either end) were proposed: these are the proposed phrases and their negative border, and a
phrase of the border that does not occur needs no entry. Where a counted phrase reaches the full limit but
had not been proposed, its longer phrases may be missing: it is proposed too and a further pass counts what
that adds, and only that. It ends when no such phrase is left; then every phrase of at least the limit has
been counted, whatever the sample was.

The border is mostly phrases that occur a few times, so these passes count by hash: tasks add up what they
can, send five bytes a phrase to buckets, and a bucket answers with the hashes that reach the limit. Equal
hashes of different phrases can only let one too many through. What reached the limit is then counted by
the phrase itself, exactly.

What is proposed, or reached the limit, comes to the driver and is sent to the tasks as a bitmap of fixed size
(``BITS``), so it does not grow with the corpus. A false positive, or a full bitmap, only means that more is
counted than needed. Texts are split once, into written blocks of numbered words that all passes read. Phrases
are numbered by pairs of (phrase, word), so in a block they are told apart exactly. A phrase or language in a
third of all rows is one entry a block.

Cases: null and empty texts have no words; a null language is ``und``. Repeated rows and null ids are
documents like others. An empty table gives an empty result. Columns other than lang and text are not looked
at. A phrase's cuts and containers are joined by the phrase; ranks are limited before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bastionlog.llm import words as W
from bastionlog.session import materialise

LONGEST, LIMIT, TOP = 5, 100, 2000
#: One document in SHARE is in the sample; a phrase is proposed at this part of its expected count there.
SHARE, LOWERED = 8, 0.4
BITS = 1 << 25
#: Bytes of a bitmap that are sent to the driver as one row.
PAGE, PAGE_DDL = 1 << 10, "page long, data binary"
BLOCK_BYTES, SLICE = 1 << 19, 128
#: Rows an Arrow batch of blocks, and of texts.
BLOCK_ROWS, TEXT_ROWS = 4, 512
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Entries a task holds before it sends them, and word places a bucket.
HELD_ENTRIES, BUCKET_PLACES = 1 << 18, 1 << 19
LOWER_AND_PART = bytes(
    ord(".") if chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)
NOT_SPACE = W.byte_class(lambda b: b != 0x20)
NEXT = np.uint64(0x9FB21C651E98DF25)


class Proposed:
    """Hashes of proposed phrases as a bitmap; two bits each."""

    def __init__(self, bits: int = BITS) -> None:
        self.size = bits
        self.data = np.zeros(bits // 8, dtype=np.uint8)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.uint64(self.size)
        return hashes % size, W.mix(hashes ^ NEXT) % size

    def add(self, bytes_at: np.ndarray, values: np.ndarray) -> Proposed:
        made = Proposed(self.size)
        made.data = self.data.copy()
        made.data[bytes_at] |= values.astype(np.uint8)
        return made

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(self.data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in self.places(hashes)]).astype(bool)


def bits_of(phrases: DataFrame, size: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap bytes that the phrases of ``phrases`` (hash) set. Tasks set the bits and send pages of the bitmap; these
    are united by tasks, so that the driver gets each page once: ``size`` / 8 bytes at most, however many phrases."""
    empty = Proposed(8)
    empty.size = size

    def none() -> np.ndarray:
        return np.zeros((-(-size // 8 // PAGE), PAGE), dtype=np.uint8)

    def filled(pages: np.ndarray) -> pd.DataFrame:
        used = np.flatnonzero(pages.any(axis=1))
        return pd.DataFrame({"page": used, "data": [pages[p].tobytes() for p in used]})

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages = none()
        flat = pages.reshape(-1)
        for batch in batches:
            at = np.concatenate(empty.places(batch["hash"].to_numpy().view(np.uint64))).astype(np.int64)
            for bit in range(8):
                flat[at[at & 7 == bit] >> 3] |= np.uint8(1 << bit)
        yield filled(pages)

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages = none()
        for batch in batches:
            for page, data in zip(batch["page"], batch["data"], strict=True):
                pages[page] |= np.frombuffer(data, np.uint8)
        yield filled(pages)

    made, pages = phrases.select("hash").mapInPandas(mark, PAGE_DDL).repartition("page").mapInPandas(unite, PAGE_DDL), none()
    for row in made.collect():
        pages[row.page] |= np.frombuffer(row.data, np.uint8)
    at = np.flatnonzero(pages)
    return at, pages.reshape(-1)[at]


BLOCK = pa.schema([("langs", pa.list_(pa.string())), ("words", pa.binary()), ("lang", pa.binary()), ("word", pa.binary()), ("ids", pa.binary())])
BLOCK_DDL = "langs array<string>, words binary, lang binary, word binary, ids binary"


def id_type(numbers: int) -> str:
    return "<u2" if numbers <= 1 << 16 else "<i4"


def numbered(texts: list[str | None], langs: list[str]) -> list:
    """A block of texts: languages, words joined by blanks, language and word of each number, numbers by place.

    A number is a word in a language. Pieces are parted by the number of ``.``, which is no word.
    """
    lang_of, names, known, numbers = [], sorted(set(langs)), {}, []
    code = {lang: i for i, lang in enumerate(names)}
    for text, lang in zip(texts, langs, strict=True):
        own = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AND_PART).replace(b".", b" . ").split()
        own.append(b".")
        for word in set(own).difference(known):
            known[word] = len(known)
        numbers.append(np.fromiter(map(known.__getitem__, own), dtype=np.int64, count=len(own)))
        lang_of.append((code[lang], len(own)))
    numbers, words = np.concatenate(numbers), list(known)
    lang = np.repeat([c for c, _ in lang_of], [n for _, n in lang_of])
    pairs = lang * len(words) + numbers
    seen = np.zeros(len(names) * len(words), dtype=bool)
    seen[pairs] = True
    used = np.flatnonzero(seen)
    new = np.cumsum(seen) - 1
    lang, word = np.divmod(used, len(words))
    return [names, b" ".join(words), lang.astype("<i4").tobytes(), word.astype("<i4").tobytes(), new[pairs].astype(id_type(len(word))).tobytes()]


class Words:
    """A block as it was written: numbers by place, and a hash of each word and of each number."""

    def __init__(self, langs: list[str], words: bytes, lang: bytes, word: bytes, ids: bytes) -> None:
        self.langs, self.text = langs, words
        self.lang, self.word = (np.frombuffer(x, "<i4").astype(np.int64) for x in (lang, word))
        self.ids = np.frombuffer(ids, id_type(len(self.word))).astype(np.int64)
        data = np.frombuffer(words, np.uint8)
        hashes = W.span_hashes(data, *W.spans(data, NOT_SPACE))
        names = [n.encode("utf-8", "surrogatepass") + b" " for n in langs]
        of_lang = np.array([int.from_bytes(hashlib.sha256(n).digest()[:8], "little") for n in names], dtype=np.uint64)
        self.word_hash = hashes[self.word]
        self.hash = W.mix(self.word_hash ^ of_lang[self.lang])
        self.valid = (self.word != words.split(b" ").index(b"."))[self.ids]

    def said(self) -> np.ndarray:
        return np.array(self.text.split(b" "), dtype=object)


def number_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` (lang, text) as blocks of numbered words."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in blocks_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(numbered(texts, langs), BLOCK, strict=True)], schema=BLOCK)

    return docs.select("lang", "text").mapInArrow(number, BLOCK_DDL)


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Words(*(batch.column(n)[i].as_py() for n in BLOCK.names))


def distinct_numbers(ids: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of small numbers: which of the distinct ones each is, their counts and their first places."""
    counts = np.bincount(ids, minlength=most)
    used = np.flatnonzero(counts)
    first = np.zeros(most, dtype=np.int64)
    first[ids[::-1]] = at[::-1]
    new = np.zeros(most, dtype=np.int64)
    new[used] = np.arange(len(used))
    return new[ids], counts[used], first[used]


def levels(block: Words, now: Proposed | None, before: Proposed | None, longest: int, entries: Entries) -> Iterator[tuple]:
    """By length: (length, first places, hashes, counts, whether proposed) of the phrases to count.

    ``before`` is what was proposed in the passes before: phrases they counted are left out. Words are counted
    in the first pass only.
    """
    ids, hashes, valid = block.ids, block.hash, block.valid
    n = len(ids)
    # Whether the phrase at a place was counted before; all words were.
    counted = valid.copy()
    for length in range(1, longest + 1):
        at = np.flatnonzero(valid)
        if not len(at):
            return
        if length == 1:
            which, counts, places = distinct_numbers(ids[at], at, len(hashes))
            full = hashes[ids[places]]
        else:
            _, first, which, counts = np.unique(ids[at], return_index=True, return_inverse=True, return_counts=True)
            places = at[first]
            full = hashes[places]
        own = entries.whole(full)
        known = now.has(own) if now is not None else np.zeros(len(own), dtype=bool)
        fresh = np.ones(len(own), dtype=bool) if before is None else ~counted[places]
        yield length, places[fresh], own[fresh], counts[fresh], known[fresh]
        if length == longest or now is None:
            return
        # A phrase of one word more, where both its parts are proposed; numbered by (part, last word).
        here = np.zeros(n, dtype=bool)
        here[at] = known[which]
        was = np.zeros(n, dtype=bool)
        if before is not None:
            was[at] = (before.has(own) & counted[places])[which]
        part = np.zeros(n, dtype=np.int64)
        part[at] = which
        part_hash = np.zeros(n, dtype=np.uint64)
        part_hash[at] = full[which]
        valid = np.zeros(n, dtype=bool)
        valid[:-1] = here[:-1] & here[1:]
        counted = np.zeros(n, dtype=bool)
        counted[:-1] = was[:-1] & was[1:]
        spot = np.flatnonzero(valid)
        last = block.ids[spot + length]
        ids, hashes = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint64)
        ids[spot] = part[spot] * len(block.word) + last
        hashes[spot] = W.mix(part_hash[spot] * NEXT + block.word_hash[last])


COUNTED_DDL = "lang string, phrase string, length int, n long"
COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("length", pa.int32()), ("n", pa.int64())])
SENT = pa.schema([("bucket", pa.int64()), ("length", pa.int32()), ("data", pa.binary())])
SENT_DDL, HEAVY_DDL = "bucket long, length int, data binary", "length int, hash long"


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Texts and languages in blocks of about ``BLOCK_BYTES``; a longer text is a block of its own."""
    texts, langs, size = [], [], 0
    for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if texts and size + len(text or "") > BLOCK_BYTES:
                yield texts, langs
                texts, langs, size = [], [], 0
            texts.append(text)
            langs.append(lang)
            size += len(text or "")
    if texts:
        yield texts, langs


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with the sums of their counts."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    start = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return hashes[start], np.add.reduceat(counts, start)


class Entries:
    """Packs of the hashes' low four bytes, then their counts, which stop at the limit; a bucket is of the upper
    bytes. Most counts are one, so they are kept together, where shuffles compress them."""

    def __init__(self, limit: int, buckets: int) -> None:
        self.limit, self.buckets, self.width = limit, buckets, (limit.bit_length() + 7) // 8

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """What stands for a hash everywhere: its bucket and its low four bytes. Buckets grow with the corpus, so
        that one in about ten thousand meets another, at any size."""
        return (hashes >> np.uint64(40)) % np.uint64(self.buckets) << np.uint64(40) | hashes & np.uint64((1 << 32) - 1)

    def packs(self, length: int, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        hashes, counts = summed(hashes, counts)
        low = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :4]
        often = np.minimum(counts, self.limit).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]
        bucket = (hashes >> np.uint64(40)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        yield from ((int(bucket[s]), length, low[s:e].tobytes() + often[s:e].tobytes()) for s, e in zip(cuts, cuts[1:], strict=False))

    def heavy(self, bucket: int, packs: list[bytes]) -> np.ndarray:
        """The hashes of a bucket whose counts reach the limit together."""
        sizes = [len(p) // (4 + self.width) for p in packs]
        wide = np.zeros((2, sum(sizes), 8), dtype=np.uint8)
        wide[0, :, :4] = np.concatenate([np.frombuffer(p, np.uint8, 4 * n) for p, n in zip(packs, sizes, strict=True)]).reshape(-1, 4)
        wide[1, :, : self.width] = np.concatenate(
            [np.frombuffer(p, np.uint8, offset=4 * n) for p, n in zip(packs, sizes, strict=True)]
        ).reshape(-1, self.width)
        hashes, counts = summed(wide[0].view("<u8").ravel(), wide[1].view("<u8").ravel())
        return hashes[counts >= self.limit] | np.uint64(bucket << 40)


def heavy_hashes(blocks: DataFrame, now: Proposed | None, before: Proposed | None, lengths: list[int], entries: Entries) -> DataFrame:
    """(length, hash) that reach the limit, of phrases whose parts are proposed ``now`` and were not all ``before``."""
    sent = blocks.sparkSession.sparkContext.broadcast((now, before))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = sent.value
        held: dict[int, list] = {length: [] for length in lengths}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for length, pairs in held.items():
                if pairs:
                    hashes, counts = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
                    columns = zip(*entries.packs(length, hashes, counts), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SENT, strict=True)], schema=SENT)
                    pairs.clear()

        for block in read_blocks(batches):
            for length, _, hashes, counts, _ in levels(block, now, before, max(lengths), entries):
                if length in held and len(hashes):
                    held[length].append((hashes, counts))
                    size += len(hashes)
                if size >= HELD_ENTRIES:
                    yield from flushed()
                    size = 0
        yield from flushed()

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bucket, length = int(key[0]), int(key[1])
        return pd.DataFrame({"length": length, "hash": entries.heavy(bucket, rows["data"].tolist()).view(np.int64)})

    return blocks.mapInArrow(count, SENT_DDL).groupBy("bucket", "length").applyInPandas(answer, HEAVY_DDL)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Blocks are rows of megabytes, texts may be: while a pass over them runs, a batch holds few."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def not_proposed(heavy: DataFrame, now: Proposed, longest: int) -> DataFrame:
    """The hashes of ``heavy`` that had to be proposed and were not."""
    sent = heavy.sparkSession.sparkContext.broadcast(now)

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[~sent.value.has(batch["hash"].to_numpy().view(np.uint64))]

    return heavy.filter(F.col("length") < longest).mapInPandas(left, HEAVY_DDL)


def exact_counts(blocks: DataFrame, often: Proposed, longest: int, entries: Entries) -> DataFrame:
    """Exact counts of the phrases ``often`` has, by the phrases; and all words of a language, as length 0."""
    sent = blocks.sparkSession.sparkContext.broadcast(often)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read_blocks(batches):
            said = block.said()
            of_lang = np.array(block.langs, dtype=object)
            totals = np.bincount(block.lang[block.ids[block.valid]], minlength=len(of_lang))
            yield pa.RecordBatch.from_arrays(
                [pa.array(of_lang, pa.string()), pa.array([""] * len(of_lang)), pa.array([0] * len(of_lang), pa.int32()), pa.array(totals, pa.int64())],
                schema=COUNTED,
            )
            for length, places, _, counts, known in levels(block, sent.value, None, longest, entries):
                places, counts = places[known], counts[known]
                if len(places):
                    words = [said[block.word[block.ids[places + k]]] for k in range(length)]
                    phrases = [b" ".join(p).decode("utf-8", "surrogatepass") for p in zip(*words, strict=True)]
                    columns = [of_lang[block.lang[block.ids[places]]], phrases, np.full(len(places), length), counts]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTED, strict=True)], schema=COUNTED)

    return blocks.mapInArrow(count, COUNTED_DDL).groupBy("lang", "phrase", "length").agg(F.sum("n").alias("n"))


def proposals(texts: DataFrame, limit: int, longest: int, share: int, lowered: float, bits: int, buckets: int) -> Proposed:
    """Phrases the sample proposes, level by level."""
    drawn = texts.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    with small_batches(texts.sparkSession, TEXT_ROWS):
        sample = materialise(number_blocks(drawn), "phrase-sample")
    entries = Entries(max(1, int(limit * lowered / share)), buckets)
    now = Proposed(bits)
    for length in range(1, longest):
        with small_batches(texts.sparkSession, BLOCK_ROWS):
            heavy = materialise(heavy_hashes(sample, now if length > 1 else None, None, [length], entries), "phrase-sampled")
        now = now.add(*bits_of(heavy, bits))
    return now


def frequent_phrases(
    docs: DataFrame, limit: int = LIMIT, longest: int = LONGEST, share: int = SHARE, lowered: float = LOWERED, bits: int = BITS
) -> DataFrame:
    """All phrases of up to ``longest`` words of ``docs`` (lang, text) with at least ``limit`` occurrences, and
    as length 0 how many words each language has: lang, phrase, length, n."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession, TEXT_ROWS):
        blocks = materialise(number_blocks(texts), "phrase-blocks")
    places = blocks.agg(F.coalesce(F.sum(F.octet_length("ids").cast("long")), F.lit(0))).first()[0] // 2
    entries = Entries(limit, min(1 << 23, 1 + places // BUCKET_PLACES))
    now = proposals(texts, limit, longest, share, lowered, bits, entries.buckets)
    before, often = None, Proposed(bits)
    while True:
        with small_batches(docs.sparkSession, BLOCK_ROWS):
            heavy = materialise(heavy_hashes(blocks, now, before, list(range(1, longest + 1)), entries), "phrase-hashes")
        often = often.add(*bits_of(heavy, bits))
        bytes_at, values = bits_of(not_proposed(heavy, now, longest), bits)
        if not len(bytes_at):
            break
        now, before = now.add(bytes_at, values), now
    with small_batches(docs.sparkSession, BLOCK_ROWS):
        return materialise(exact_counts(blocks, often, longest, entries).filter((F.col("n") >= limit) | (F.col("length") == 0)), "phrase-counts")


def scored(phrases: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Candidates with the lowest-scoring of their cuts: lang, phrase, length, a, l, r, n, score, all exact."""
    totals = phrases.filter("length = 0").select("lang", F.col("n").alias("total"))
    often = phrases.filter((F.col("n") >= limit) & (F.col("length") > 0))
    said = F.split("phrase", " ", -1)
    cuts = (
        often.filter("length > 1")
        .select("lang", "phrase", "length", F.col("n").alias("a"), said.alias("said"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
        .select(
            "lang", "phrase", "length", "a", "k",
            F.array_join(F.slice("said", F.lit(1), F.col("k")), " ").alias("first_part"),
            F.array_join(F.slice("said", F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("rest"),
        )
    )
    left = often.select("lang", F.col("phrase").alias("first_part"), F.col("n").alias("l"))
    right = often.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    both = cuts.join(left, ["lang", "first_part"]).join(right, ["lang", "rest"]).join(totals, "lang")
    # Sixteen digits a count: the products have at most 36 and 32, inside a decimal's 38.
    number = "cast({} AS decimal(16,0))".format
    whole = both.withColumn("score", F.expr(f"(1000BD * {number('a')} * {number('total')}) div ({number('l')} * {number('r')})"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return whole.groupBy("lang", "phrase", "length", "a", F.col("total").alias("n")).agg(lowest).select(
        "lang", "phrase", "length", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def without_contained(candidates: DataFrame) -> DataFrame:
    """``candidates`` without those that lie inside a longer one that is as frequent."""
    said = F.split("phrase", " ", -1)
    inner = candidates.filter("length > 2").select("lang", F.col("a").alias("longer"), "length", said.alias("said"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("size"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)).alias("at"))
    within = inner.groupBy("lang", F.array_join(F.slice("said", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    inside = F.coalesce(F.col("longer") >= F.col("a"), F.lit(False))
    return candidates.join(within, ["lang", "phrase"], "left").filter(~inside).drop("longer")


def collocations(docs: DataFrame, limit: int = LIMIT, longest: int = LONGEST, top: int = TOP, **sampling) -> DataFrame:
    """Each language's best phrases in ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score."""
    phrases = frequent_phrases(docs, limit, longest, **sampling)
    kept = without_contained(materialise(scored(phrases, limit), "phrase-scores"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
