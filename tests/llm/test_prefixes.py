"""The prefix trie against a plain count over all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from bastionlog.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n long"


def turn_order(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return turn is not None, turn or 0, role, digest


def brute(rows):
    own = {}
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        own.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made = (*own.get(base, [])[:h], *turns[h:])
        ends.setdefault(made, []).append(c)
        for d in range(len(made) + 1):
            members.setdefault(made[:d], []).append(c)
    saved, leaves, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, convs in members.items():
        if node:
            children[node[:-1]] += 1
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    for node in members:
        if not children[node]:
            for d in range(len(node) + 1):
                leaves[node[:d]] += 1
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node],
         digest(ends.get(node, [])))
        for node, convs in members.items()
    )


def compare(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    made = prefixes.prefix_trie(df, **options)
    assert made.columns == prefixes.NODE
    found = sorted(map(tuple, made.collect()), key=lambda r: (r[0], r[1]))
    assert found == sorted(brute(rows), key=lambda r: (r[0], r[1]))


def made_rows(seed, n, words, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 6 * n), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), "é" * rng.randint(0, words)))
    return rows


@pytest.mark.parametrize("seed,block_turns", [(1, 1 << 16), (2, 40), (3, 16), (4, 100)])
def test_trie(spark, seed, block_turns):
    compare(spark, made_rows(seed, 150, seed % 3, 12), block_turns=block_turns)


def test_blocks_merge_at_every_size():
    """Blocks of any size give what one block gives, over several rounds."""
    for seed in range(60):
        rng = random.Random(seed)
        items = {}
        for _ in range(rng.randint(1, 60)):
            path = [rng.choice("abc") for _ in range(rng.randint(0, rng.choice([3, 9])))]
            items.setdefault("".join(path), len(items))
        sequence = []
        for path, first in sorted(items.items()):
            n = rng.randint(1, 4)
            sums = {"depth": len(path), "n": n, "first": first, "leaves": 0, "saved": 0, "children": 0, "ends": f"e{first}"}
            sequence.append((b"".join(c.encode() * prefixes.WIDTH for c in path), [ord(c) for c in path], [sums]))

        def copy(part):
            return [(k, s, [dict(x) for x in sums]) for k, s, sums in part]

        whole = prefixes.Block(copy(sequence), 0, True)
        assert whole.run() == []
        rows, now, level = [], copy(sequence), 0
        step = rng.randint(3, 7)
        while len(now) > step:
            left = []
            for at in range(0, len(now), step):
                block = prefixes.Block(now[at : at + step], level, False)
                left += block.run()
                rows += block.rows
            now, level = left, level + 1
        last = prefixes.Block(now, level, True)
        last.run()
        rows += last.rows
        ids = {r[8]: r[0] for r in rows if r[8] is not None}
        for r in rows:
            if r[9] is not None:
                r[2] = ids[r[9]]
        by = lambda r: (r[0], r[1])
        assert sorted((r[:8] for r in rows), key=by) == sorted((r[:8] for r in whole.rows), key=by)


def test_odd_cases(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "b"), (0, 1, "user", "b"), (0, 1, None, "c"),
        (2**53 + 1, 0, "user", "x"), (2**53 + 3, 0, "user", "x"), (-7, 0, "user", ""), (-5, 3, "user", "y" * 100_000),
    ]
    rows += [(10_000 + i, t, "user", "copy") for i in range(300) for t in range(10)]
    rows += [(7, t, "user", f"turn {t % 7}") for t in range(150)]
    compare(spark, rows)
    compare(spark, rows, block_turns=64)
    assert prefixes.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_lists_of_ids(spark):
    """Chunks of one node's ids follow each other across tasks."""
    members = spark.range(0, 300_000, 1, 6).selectExpr("cast('s' AS binary) AS seq", "id * 7 AS conv_id")
    other = spark.range(5).selectExpr("cast('t' AS binary) AS seq", "id AS conv_id")
    found = {bytes(r["seq"]): r["ends"] for r in prefixes.end_digests(members.unionAll(other)).collect()}
    assert found[b"s"] == hashlib.sha256(",".join(str(i * 7) for i in range(300_000)).encode()).hexdigest()
    assert found[b"t"] == hashlib.sha256(b"0,1,2,3,4").hexdigest()
