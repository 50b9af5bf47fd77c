"""Collocations against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from bastionlog.llm import collocations

SCHEMA = "doc_id long, text string, lang string, a long, phrase string"
UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def brute(rows, limit, longest=5, top=2000):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            said = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(said)
            for size in range(1, longest + 1):
                f.update(tuple(said[i : i + size]) for i in range(len(said) - size + 1))
    result = []
    for lang, f in counts.items():
        n, made = totals[lang], []
        candidates = {p for p, a in f.items() if 2 <= len(p) and a >= limit}
        for p in candidates:
            score, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                f[q] >= f[p] and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in candidates if len(q) > len(p)
            )
            if not inside:
                made.append((-score, -f[p], " ".join(p).encode(), f[p], f[p[:k]], f[p[k:]], n, score))
        for rank, (_, _, phrase, *rest) in enumerate(sorted(made)[:top], 1):
            result.append((lang, rank, phrase.decode(), *rest))
    return sorted(result)


def compare(spark, rows, limit, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    made = collocations.collocations(df, limit, **options)
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, made.collect())) == brute(rows, limit, top=options.get("top", 2000))


def made_rows(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "river", "Ünd", "straße", "of", "old", "big-apple", "x"]
    fixed = ["in the very old town", "New York City", "as well as", "a\tb c", "x x x x x x"]
    rows = []
    for i in range(n):
        said = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!"]) for w in said)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("options", [{}, {"share": 1, "lowered": 1.0}, {"share": 64, "lowered": 8.0}, {"bits": 64}])
def test_collocations(spark, options):
    """The sample and the size of the bitmap change the passes, never the result."""
    compare(spark, made_rows(len(options), 400), 12, **options)


def test_expansion_closes(spark, monkeypatch):
    """A sample that proposes nothing leaves all to the border: one pass for each length."""
    passes = []
    whole = collocations.heavy_hashes
    monkeypatch.setattr(collocations, "heavy_hashes", lambda *a: passes.append(len(a[3])) or whole(*a))
    rows = [(i, "one two three four five six", "en") for i in range(30)]
    compare(spark, rows, 20, share=2, lowered=1000.0)
    assert passes == [1] * 4 + [5] * 5


def test_odd_cases(spark):
    rows = [(None, None, None), (1, "", ""), (1, "", ""), (2, " .,\n", "en"), (3, "word " * 30_000, "en"), (None, "\x00 \x1c a\xa0b c", "\x00")]
    rows += [(2**53 + i, "same old song. same old song", "en") for i in range(60)] + [(5, "same old song", None)] * 120
    compare(spark, rows, 100)
    compare(spark, rows, 100, top=1)
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_products_pass_64_bits(spark):
    big = 10**13
    rows = [("en", "a b", 2, big - 7), ("en", "a", 1, big - 3), ("en", "b", 1, big - 5), ("en", "", 0, 11 * big - 8)]
    row = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, length int, n long")).collect()[0]
    n = 11 * big - 8
    assert (row["n"], row["score"]) == (n, 1000 * (big - 7) * n // ((big - 3) * (big - 5)))


def test_bitmap():
    made = collocations.Proposed(1 << 12)
    hashes = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.concatenate(made.places(hashes))
    full = made
    for p in at.tolist():
        full = full.add(np.array([p >> 3]), np.array([1 << (p & 7)]))
    assert full.has(hashes).all() and not made.has(hashes).any()


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 16])
def test_bits_reach_the_driver_as_a_bitmap(spark, monkeypatch, bits):
    """Pages of the bitmap, each once, reach the driver, not a row for each byte; they set the bits of all hashes and no others."""
    reached, frame = [], type(spark.range(0))
    whole = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: reached.append(whole(self)) or reached[-1])
    monkeypatch.setattr(frame, "toPandas", lambda self: pytest.fail("rows were made a table on the driver"))
    values = [random.Random(i).getrandbits(63) for i in range(20_000)] * 2
    heavy = spark.createDataFrame([(2, v) for v in values], "length int, hash long").repartition(7)
    made = collocations.Proposed(bits).add(*collocations.bits_of(heavy, bits))
    want = {p for x in made.places(np.array(values, dtype=np.uint64)) for p in x.tolist()}
    assert set(np.flatnonzero(np.unpackbits(made.data, bitorder="little")).tolist()) == want
    pages = [row.page for rows in reached for row in rows]
    assert len(pages) == len(set(pages)) == -(-bits // 8 // collocations.PAGE)
    assert not len(collocations.bits_of(heavy.limit(0), bits)[0])


def test_entries_come_back():
    """Counts stop at the limit and add up over packs; a hash is its bucket and low bytes."""
    entries = collocations.Entries(300, 7)
    hashes = entries.whole(np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    counts = np.arange(399)
    sent = {}
    for _ in range(2):
        for bucket, _, data in entries.packs(2, hashes, counts):
            sent.setdefault(bucket, []).append(data)
    heavy = np.concatenate([entries.heavy(b, packs) for b, packs in sent.items()])
    assert sorted(heavy.tolist()) == sorted(hashes[counts >= 150].tolist())
