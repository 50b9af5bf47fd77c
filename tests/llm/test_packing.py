"""Packing: plans against a piece-by-piece packer, pieces against the tokenizer itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bastionlog.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def one_by_one(histogram: dict[int, int], size: int) -> list[int]:
    """Fills of the packs when every piece goes to the shortest pack that has room."""
    fills: list[int] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            able = [i for i, f in enumerate(fills) if f + length <= size]
            if able:
                fills[min(able, key=lambda i: fills[i])] += length
            else:
                fills.append(length)
    return sorted(fills)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_shortest_pack_first(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 32, 100])
    histogram = {rng.randint(1, size - 1): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
    placements, runs = packing.shortest_pack_first(histogram, size)
    assert sorted(f for r in runs for f in [r.fill] * r.count) == one_by_one(histogram, size)
    filled: dict[int, set[int]] = {}
    for length, n in histogram.items():
        own = sorted((p for p in placements if p.length == length), key=lambda p: p.rank)
        stops = [p.rank for p in own[1:]] + [n]
        for p, stop in zip(own, stops, strict=True):
            for rank in range(p.rank, stop):
                pack, slot = divmod(rank - p.rank, p.times)
                at = p.offset + slot * length
                cells = filled.setdefault(p.pack + pack, set())
                assert not cells & set(range(at, at + length))
                cells.update(range(at, at + length))
    assert all(c == set(range(len(c))) and len(c) <= size for c in filled.values())


def test_plan_is_bounded():
    placements, runs = packing.shortest_pack_first({n: 10**9 // n + n for n in range(1, 2048)})
    assert len(runs) <= 4094 and len(placements) <= 258_000
    assert sum(r.fill * r.count for r in runs) == sum(n * (10**9 // n + n) for n in range(1, 2048))


def test_encoder_agrees_with_the_tokenizer():
    rng = random.Random(1)
    signs = "ab'sSt eé́ΣσςİıſK\t\n\r\x0b\x0c\x1c\x85\xa0 ‍👍🏽<|endoftext|>\x00中한각̧̀ .,!7AKZ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["Isn't it. <|endoftext|> x", "y<|startoftext|>z", "A.B. c.. d. e,\nf", "x" * 5000, "a" * 47 + ". b", None]
    encoder, plain = packing.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for begin in range(0, len(texts), 50):
        part = texts[begin : begin + 50]
        for text, ids in zip(part, encoder.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_words_are_learnt_once_whatever_signs_follow():
    words, signs = ["stone", "Zürich", "señal", "Ωμέγα", "год", "한국", "42"], [".", ",", "!?", "###", '").', "%%%"]
    encoder, plain, learnt = packing.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY), []
    learn = encoder._learn
    encoder._learn = lambda runs: learnt.extend(runs) or learn(runs)
    texts = [f"{w}{s} {w} {s}{w}" for s in signs for w in words]
    for begin in range(0, len(texts), 5):
        part = texts[begin : begin + 5]
        for text, ids in zip(part, encoder.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    before = {s + w for s in signs for w in words}
    assert len(learnt) == len(set(learnt)) == len(words) + len(signs) + len(before)


def test_signs_after_any_character():
    chars = "aZ9éÉßſİŉΣς한ᄀक\u0958\u093c\u09be\u0301\u0345\u0344ªʰǅⅷ²٣’”…👍\u200d\xa0\u3000\x85\x1c\x00\x7f"
    texts = [f"{c}. a{c}!? é{c}' {c}'s. {c}s {c}{d}, " for c in chars for d in chars]
    texts += ["x<|endoftext|>. y", "A<|. B<|endoftext|>.", "a<| b.", "'s. don't' '", "", None]
    encoder, plain = packing.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    whole = pa.array(texts, pa.large_string())
    for begin in range(0, len(texts), 50):
        for text, ids in zip(texts[begin : begin + 50], encoder.encode(whole.slice(begin, 50)), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def check(rows: list, texts: dict, size: int) -> None:
    """Every id in one piece with its digest, sequences gapless and without padding."""
    plain = Tokenizer.from_file(VOCABULARY)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, copies in texts.items():
        ids = [*plain.encode(copies[0] or "", add_special_tokens=False).ids, packing.CLOSING_ID]
        starts = {}
        for r in by_doc[doc_id]:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["length"] == len(piece) > 0 and r["ids_crc32"] == zlib.crc32(piece.tobytes())
            assert r["doc_tokens"] == len(ids)
            starts.setdefault(r["start"], []).append(r["length"])
        covered = np.zeros(len(ids), dtype=int)
        for start, lengths in starts.items():
            for n in lengths:
                covered[start : start + n] += 1
        assert (covered == len(copies)).all()
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == size or (at < size and at & (at - 1) == 0)


@pytest.mark.parametrize("size", [8, 32, 2048])
def test_pieces(spark, size):
    rng = random.Random(size)
    words = ["stone", "rivers", "antidisestablishmentarianism", "a", "of.", "42", "Ünïcode", "x" * 300]
    texts = {i: [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 200])))] for i in range(150)}
    texts |= {None: [None], 900: [""], 901: [None], 2**53 + 1: ["same text"] * 3, 2**53 + 2: ["same text"], 902: ["far " * 9000]}
    rows = [(i, t, 1, "x") for i, copies in texts.items() for t in copies]
    docs = spark.createDataFrame(rows, SCHEMA + ", rest int, sequence_id string").repartition(5)
    check(packing.packed(docs, VOCABULARY, size).collect(), texts, size)


def test_equal_lengths_and_nothing(spark):
    docs = spark.createDataFrame([(i, None) for i in range(5000)], SCHEMA)
    rows = packing.packed(docs, VOCABULARY).collect()
    check(rows, {i: [None] for i in range(5000)}, 2048)
    assert len(rows) == 5000 and len({r["sequence_id"] for r in rows}) == 2 + bin(5000 % 2048).count("1")
    assert packing.packed(docs.limit(0), VOCABULARY).collect() == []
