"""The prefix trie of conversations, by union-find over the sorted neighbours' longest common prefixes.

A turn is 16 bytes of SHA-256 over (role, text), a conversation the bytes of its turns. Equal conversations
are one item with a count, so copies meet in partial sums. Items are sorted by range of their bytes and read
in blocks. In a block the edges between neighbours are joined in descending order of their common prefix;
each join is a branching node, and the turns between two of them a chain of nodes with the same members.

Only the nodes on the paths of a block's first and last item may go on in the blocks beside it. All others
are finished where they are; what hangs off the two paths is contracted to sums by depth. The two paths,
with these sums, are the items of the next round, so blocks are merged across their boundaries as items are
in a block, until one block holds what is left. A node that is finished before its parent names the parent
by a digest of the path; the parent's smallest member is joined to it at the end.

Digests of the ids that end at a node are made by a stream: ids are sorted by range and written as text in
chunks by many tasks, and one pass over a node's chunks feeds SHA-256, which has no other order; no task
holds them together. A conversation is one row of 24 bytes a turn, however long its texts are.

Cases: null roles and texts are empty. Rows with a null conv_id belong to no conversation and are left out.
Null turns come first; ties of a turn go by role, then by the turn's digest. Repeated rows are turns of
their own. An empty table has no node, not even a root. Ids below zero: c - c % 5 cuts towards zero.
Columns other than conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.session import materialise

GROUP, MOST_KEPT = 5, 9
WIDTH = 16
BLOCK_TURNS, LEAST_ITEMS = 1 << 16, 8
CHUNK_IDS = 1 << 16
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

SUMS = [("depth", "long"), ("n", "long"), ("first", "long"), ("leaves", "long"), ("saved", "long"), ("children", "long"), ("ends", "string")]
SUMS_DDL = f"array<struct<{','.join(f'{n}:{t}' for n, t in SUMS)}>>"
ARROW = {"long": pa.int64(), "string": pa.string()}
SUMS_ARROW = pa.list_(pa.struct([(n, ARROW[t]) for n, t in SUMS]))
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
MADE = pa.schema(
    [(n, pa.string() if n == "ends_sha256" else pa.int64()) for n in NODE]
    + [("node_key", pa.binary()), ("parent_key", pa.binary()), ("key", pa.binary()), ("sizes", pa.list_(pa.int64())), ("sums", SUMS_ARROW)]
)
MADE_DDL = ", ".join(
    [f"{n} {'string' if n == 'ends_sha256' else 'long'}" for n in NODE]
    + ["node_key binary, parent_key binary, key binary, sizes array<long>", f"sums {SUMS_DDL}"]
)


def kept_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_KEPT).cast("int")


def conversations(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): its turns in order, as digests and text sizes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn"), role.alias("role"), F.unhex(F.substring(F.sha2(marked, 256), 1, 2 * WIDTH)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    own = rows.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
    ordered = own.agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["size"])).alias("turns"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """Every conversation after taking over the first turns of its group's first: conv_id, key, sizes."""
    own = conversations(rows).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    lent = own.filter("conv_id = base").select("base", F.slice("turns", 1, MOST_KEPT - 1).alias("lent"))
    taken = F.coalesce(F.slice("lent", F.lit(1), F.col("kept")), F.array().cast("array<struct<digest:binary,size:long>>"))
    after = F.slice("turns", F.col("kept") + 1, F.size("turns"))
    joined = own.withColumn("kept", kept_turns(F.col("conv_id"))).join(lent, "base", "left")
    turns = joined.select("conv_id", F.concat(taken, after).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    return turns.select("conv_id", F.unhex(text).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (seq, conv_id) as text: seq, first id, ids joined by commas."""
    for batch in batches:
        keys, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or i % CHUNK_IDS == 0), len(keys)]
        spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[a] for a, _ in spans], pa.binary()), pa.array([ids[a] for a, _ in spans], pa.int64()),
             pa.array([",".join(map(str, ids[a:b])).encode() for a, b in spans], pa.binary())],
            names=["seq", "first", "ids"],
        )


def chained_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each seq's chunks, which come sorted by (seq, first)."""
    key, state = None, None

    def done(keys: list, digests: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["seq", "ends"])

    for batch in batches:
        keys, digests = [], []
        for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if seq == key:
                state.update(b"," + ids)
                continue
            if state is not None:
                keys.append(key)
                digests.append(state.hexdigest())
            key, state = seq, hashlib.sha256(ids)
        yield done(keys, digests)
    if state is not None:
        yield done([key], [state.hexdigest()])


def end_digests(members: DataFrame) -> DataFrame:
    """Per seq of ``members`` (seq, conv_id) the digest of its ids in numerical order."""
    ranged = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    chunks = ranged.mapInArrow(id_chunks, "seq binary, first long, ids binary")
    return chunks.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(chained_digests, "seq binary, ends string")


def distinct_items(made: DataFrame) -> DataFrame:
    """Items (key, sizes, sums) of the different conversations in ``made`` (conv_id, seq, key, sizes)."""
    same = made.groupBy("seq").agg(
        F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("key").alias("key"), F.first("sizes").alias("sizes")
    )
    zero = F.lit(0).cast("long")
    end = F.struct(
        F.size("sizes").cast("long").alias("depth"), "n", "first", zero.alias("leaves"), zero.alias("saved"), zero.alias("children"), "ends"
    )
    return same.join(end_digests(made.select("seq", "conv_id")), "seq").select("key", "sizes", F.array(end).alias("sums"))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // WIDTH


def path_digests(key: bytes) -> list[bytes]:
    """A digest of every prefix of the turns, the empty one included."""
    state = hashlib.blake2b(digest_size=WIDTH)
    made = [state.digest()]
    for at in range(0, len(key), WIDTH):
        state.update(key[at : at + WIDTH])
        made.append(state.copy().digest())
    return made


class Component:
    """Neighbours joined so far, as the node they stand at: members, sums and children of that node.

    ``later`` holds sums for lower depths. An ``open`` component lies on a path that may go on beside the
    block: its sums are only what hangs off the path here, and go to ``trail`` when it rises.
    """

    __slots__ = ("children", "depth", "ends", "first", "item", "later", "leaves", "n", "open", "saved", "tops", "trail")

    def __init__(self, item: int, sums: list[dict], open_: bool) -> None:
        self.item, self.open, self.trail, self.tops = item, open_, [], []
        self.later = sorted(sums, key=lambda s: s["depth"])
        self.depth = self.later[-1]["depth"]
        self.clear()
        self.absorb()

    def clear(self) -> None:
        self.n = self.leaves = self.saved = self.children = 0
        self.first = self.ends = None

    def add(self, n: int, first: int | None, leaves: int, saved: int, children: int, ends: str | None) -> None:
        self.n, self.leaves, self.saved, self.children = self.n + n, self.leaves + leaves, self.saved + saved, self.children + children
        if first is not None:
            self.first = first if self.first is None else min(self.first, first)
        self.ends = self.ends or ends

    def absorb(self) -> None:
        """Take in the sums that belong to the present depth."""
        while self.later and self.later[-1]["depth"] == self.depth:
            s = self.later.pop()
            self.add(s["n"], s["first"], s["leaves"], s["saved"], s["children"], s["ends"])

    def record(self) -> None:
        if self.n or self.children or self.ends:
            values = (self.depth, self.n, self.first, self.leaves, self.saved, self.children, self.ends)
            self.trail.append({name: v for (name, _), v in zip(SUMS, values, strict=True)})


class Block:
    """A stretch of sorted items, joined to nodes."""

    def __init__(self, items: list[tuple[bytes, list[int], list[dict]]], level: int, final: bool) -> None:
        self.items, self.level, self.final = items, level, final
        self.rows: list[list] = []
        self.digests: dict[int, list[bytes]] = {}

    def digest(self, item: int, depth: int) -> bytes:
        if item not in self.digests:
            self.digests[item] = path_digests(self.items[item][0])
        return self.digests[item][depth]

    def close(self, c: Component, stop: int) -> None:
        """Finish the node ``c`` stands at and the chain above it, down to but without depth ``stop``."""
        sizes = self.items[c.item][1]
        leaves, saved = c.leaves or 1, c.saved
        for row in c.tops:
            self.rows[row][2] = c.first
        children, ends = c.children, c.ends or EMPTY_SHA256
        for depth in range(c.depth, stop, -1):
            if depth:
                saved += (c.n - 1) * sizes[depth - 1]
            key = self.digest(c.item, depth) if self.level else None
            self.rows.append([c.first, depth, c.first if depth > stop + 1 else None, c.n, children, leaves, saved, ends, key, None])
            children, ends = 1, EMPTY_SHA256
        c.tops, c.leaves, c.saved, c.children, c.ends, c.depth = [len(self.rows) - 1], leaves, saved, 1, None, stop

    def rise(self, c: Component, depth: int) -> None:
        """Bring ``c`` up to ``depth``."""
        if c.open and c.depth > depth:
            c.record()
            c.clear()
            while c.later and c.later[-1]["depth"] > depth:
                c.trail.append(c.later.pop())
            c.depth = depth
            c.absorb()
        while c.depth > depth:
            below = c.later[-1]["depth"] if c.later else depth
            self.close(c, max(depth, below))
            c.absorb()

    def join(self, a: Component, b: Component, depth: int) -> Component:
        """One node of both, which follow each other, at the depth of their common prefix."""
        self.rise(a, depth)
        self.rise(b, depth)
        big, small = (a, b) if (a.open, len(a.tops)) >= (b.open, len(b.tops)) else (b, a)
        big.add(small.n, small.first, small.leaves, small.saved, small.children, small.ends)
        if big.open:
            for row in small.tops:
                self.rows[row][9] = self.digest(big.item, depth)
        else:
            big.tops.extend(small.tops)
        big.later = sorted(big.later + small.later, key=lambda s: s["depth"])
        return big

    def run(self) -> list[tuple[bytes, list[int], list[dict]]]:
        """Join everything; the items that stand for the block in the next round."""
        items, last = self.items, len(self.items) - 1
        if not self.final and last == 0:
            return items
        keys = [k for k, _, _ in items]
        common = [common_turns(a, b) for a, b in zip(keys, keys[1:], strict=False)]
        parts = [Component(i, sums, not self.final and i in (0, last)) for i, (_, _, sums) in enumerate(items)]
        ends = parts[0], parts[-1]
        leader = list(range(len(items)))

        def find(i: int) -> int:
            while leader[i] != i:
                leader[i] = leader[leader[i]]
                i = leader[i]
            return i

        for i in sorted(range(last), key=lambda i: -common[i]):
            a, b = find(i), find(i + 1)
            parts[a] = self.join(parts[a], parts[b], common[i])
            parts[b] = None
            leader[b] = a
        whole = parts[find(0)]
        if self.final:
            self.rise(whole, 0)
            self.close(whole, -1)
            self.rows[-1][2] = None
            return []
        whole.record()
        whole.trail.extend(whole.later)
        return [(*items[i][:2], c.trail) for i, c in zip((0, last), ends, strict=True)]


def merged(level: int, final: bool, block_turns: int):
    """Arrow function over sorted items (key, sizes, sums): finished nodes, and the items of the next round."""

    def batch_of(block: Block) -> pa.RecordBatch:
        left = block.run()
        rows = [[*r, None, None, None] for r in block.rows] + [[None] * 10 + list(i) for i in left]
        columns = zip(*rows, strict=True) if rows else [[]] * len(MADE)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MADE, strict=True)], schema=MADE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, turns = [], 0
        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("key", "sizes", "sums")), strict=True):
                items.append(item)
                turns += len(item[1]) + len(item[2])
                if not final and turns >= block_turns and len(items) >= LEAST_ITEMS:
                    yield batch_of(Block(items, level, final))
                    items, turns = [], 0
        if items:
            yield batch_of(Block(items, level, final))

    return merge


def prefix_trie(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie over ``rows`` (conv_id, turn, role, text): see ``NODE``."""
    made = rebuilt(rows).select("conv_id", F.unhex(F.sha2("key", 256)).alias("seq"), "key", "sizes")
    items = materialise(distinct_items(materialise(made, "trie-conversations")), "trie-items")
    finished, level, final = [], 0, False
    while not final:
        size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("sizes") + F.size("sums")).alias("turns")).first()
        final = size["n"] <= LEAST_ITEMS or size["turns"] <= block_turns
        # Later rounds hold few items a task of the round before: fewer tasks bring neighbours together.
        tasks = max(1, size["n"] // (4 * LEAST_ITEMS))
        ranged = items.repartitionByRange(tasks, "key") if level else items.repartitionByRange("key")
        spread = items.repartition(1) if final else ranged
        out = spread.sortWithinPartitions("key").mapInArrow(merged(level, final, block_turns), MADE_DDL)
        out = materialise(out, f"trie-level-{level}")
        finished.append(out.filter("key IS NULL").drop("key", "sizes", "sums"))
        items, level = out.filter("key IS NOT NULL").select("key", "sizes", "sums"), level + 1
    nodes, parents = finished[0], None
    for later in finished[1:]:
        nodes = nodes.unionAll(later)
        parents = later if parents is None else parents.unionAll(later)
    if parents is None:
        return nodes.select(*NODE)
    waiting = nodes.filter("parent_key IS NOT NULL").drop("parent_conv_id")
    known = parents.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.filter("parent_key IS NULL").select(*NODE).unionAll(waiting.join(known, "parent_key").select(*NODE))
