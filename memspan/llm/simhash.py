"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints are the leaves of a binary trie. Two nodes of one depth are traversed
together; the bits in which their prefixes differ are added up; a pair of nodes is
pruned as soon as they exceed the Hamming budget.

The upper levels are walked as tables of node pairs. A pair whose nodes hold few
enough fingerprints becomes a tile, which one task walks down to the leaves; pairs with
a larger node are taken deeper first, so that no tile outgrows a task. A node's leaves are
laid into blocks once, and blocks, eight bytes a leaf, go to the tiles of the node: 8 of
them at depth 3, 42 at 6, 130 at 9 and 299 at 12, which some 10^9 distinct fingerprints
need. A tile gives a spanning forest of its links, never all pairs of a dense group: it also drops node pairs
whose leaves are already connected. Equal fingerprints are one leaf.

Defined cases: a text without words, or null, has fingerprint zero, which links like any
other. Rows that repeat an id are documents of their own, each in its own component. Null ids take part as documents, but a
component is named by its smallest id that is not null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.llm.common import columns, slices, small_batches
from memspan.llm.components import connected_components
from memspan.sources.tables import checkpoint

SHINGLE = 3
BUDGET = 3
SEED = 42
#: Fingerprints below one node of a tile: its two tries take some 250 MB of a task. Blocks that a node's leaves are laid into.
TILE_NODE, BLOCKS = 1 << 18, 16
#: Bits of the first level, and of every further one.
STRIDE = 3
#: Node pairs that a task holds at once.
PAIRS = 1 << 20


def shingle_hashes(text: str | None, size: int, seed: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return []
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), seed)]
    if size == 3:
        return [xxh64_intdigest(b"%b %b %b" % s, seed) for s in zip(words, words[1:], words[2:], strict=False)]
    return [xxh64_intdigest(b" ".join(words[i : i + size]), seed) for i in range(len(words) - size + 1)]


def majority_bits(hashes: list[list[int]]) -> np.ndarray:
    """For each list the bits that are set in more than half of its hashes."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(x) for x in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(sizes.sum()))
    starts = np.cumsum(sizes[full]) - sizes[full]
    found = np.zeros(len(full), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat(((flat >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts, dtype=np.int64)
        found |= (2 * ones > sizes[full]).astype(np.uint64) << np.uint64(bit)
    out[full] = found
    return out


def _fingerprints(size: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                bits = majority_bits([shingle_hashes(text, size, seed) for text in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``id`` and the 64-bit ``fp`` (as a signed long) of each whole text."""
    small_batches(df.sparkSession)
    rows = columns(df, id=id_col, text=text_col)
    return rows.mapInArrow(_fingerprints(shingle, seed), f"id {rows.schema['id'].dataType.simpleString()}, fp long")


class Trie:
    """Nodes of a binary trie over sorted distinct fingerprints, level by level."""

    def __init__(self, leaves: np.ndarray):
        self.leaves = leaves
        self.levels: dict[int, np.ndarray] = {}
        self.below: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def starts(self, depth: int) -> np.ndarray:
        """The first leaf of each node."""
        if depth not in self.levels:
            if depth == 0:
                self.levels[0] = np.zeros(1, np.int32)
            else:
                prefix = self.leaves >> np.uint64(64 - depth)
                self.levels[depth] = np.concatenate([[0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1]).astype(np.int32)
        return self.levels[depth]

    def children(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node its child by bit 0 and by bit 1, or -1."""
        if depth not in self.below:
            mine, next_ = self.starts(depth), self.starts(depth + 1)
            parent = np.searchsorted(mine, next_, "right") - 1
            bit = (self.leaves[next_] >> np.uint64(63 - depth)) & np.uint64(1)
            pair = (np.full(len(mine), -1, np.int32), np.full(len(mine), -1, np.int32))
            for b in (0, 1):
                at = bit == b
                pair[b][parent[at]] = np.flatnonzero(at)
            self.below[depth] = pair
        return self.below[depth]


class Forest:
    """Union-find over the leaves of a tile; keeps the links that joined two trees."""

    def __init__(self, size: int):
        self.root = np.arange(size)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
            ri, rj = self.root[i], self.root[j]
            apart = ri != rj
            i, j, high, low = i[apart], j[apart], np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart]
            if not len(i):
                return
            _, first = np.unique(high, return_index=True)  # one new parent for each root
            self.root[high[first]] = low[first]
            self.a.append(i[first])
            self.b.append(j[first])


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, differ: int, budget: int, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``a`` (sorted, below one node), or between ``a`` and ``b``."""
    left = Trie(a)
    right = left if b is None else Trie(b)
    both = a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    forest = Forest(len(both))
    stack = [(depth, np.zeros(1, np.int32), np.zeros(1, np.int32), np.full(1, differ, np.int8))]
    while stack:
        depth, x, y, d = stack.pop()
        sx, sy = left.starts(depth), right.starts(depth)
        if len(x) > 1 << 12:  # drop what is connected already
            low_x, high_x = (f.reduceat(forest.root[: len(a)], sx) for f in (np.minimum, np.maximum))
            low_y, high_y = (low_x, high_x) if b is None else (f.reduceat(forest.root[shift:], sy) for f in (np.minimum, np.maximum))
            live = (low_x[x] != high_x[x]) | (low_y[y] != high_y[y]) | (low_x[x] != low_y[y])
            x, y, d = x[live], y[live], d[live]
        ends_x, ends_y = np.append(sx[1:], len(a)), np.append(sy[1:], len(right.leaves))
        single = (ends_x[x] - sx[x] == 1) & (ends_y[y] - sy[y] == 1)
        if single.any():
            i, j = sx[x[single]], sy[y[single]]
            near = np.bitwise_count(left.leaves[i] ^ right.leaves[j]) <= budget
            forest.join(i[near], j[near] + shift)
            x, y, d = x[~single], y[~single], d[~single]
        if not len(x):
            continue
        cx, cy = left.children(depth), right.children(depth)
        parts = []
        for p in (0, 1):
            for q in (0, 1):
                keep = (cx[p][x] >= 0) & (cy[q][y] >= 0) & (d + (p != q) <= budget)
                if b is None and p > q:
                    keep &= x != y
                parts.append((cx[p][x[keep]], cy[q][y[keep]], d[keep] + (p != q)))
        x, y, d = (np.concatenate(z) for z in zip(*parts, strict=True))
        order = np.argsort(-d, kind="stable")  # the closest come off the stack first
        for k in range(0, len(x), pairs):
            at = order[k : k + pairs]
            stack.append((depth + 1, x[at], y[at], d[at]))
    if not forest.a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return both[np.concatenate(forest.a)], both[np.concatenate(forest.b)]


def _tile(budget: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        depth, a, b, differ = (int(k) for k in key)
        sides = [np.sort(np.concatenate([np.zeros(0, np.int64), *rows["fps"][rows["side"] == side]]).view(np.uint64)) for side in (0, 1)]
        src, dst = walk(sides[0], None if a == b else sides[1], depth, differ, budget)
        return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return run


def _masks(bits: int, budget: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= budget]


def _prefix(depth: int) -> F.Column:
    return F.shiftrightunsigned("fp", 64 - depth)


def tiles(leaves: DataFrame, budget: int = BUDGET, node: int = TILE_NODE) -> DataFrame:
    """Node pairs ``depth, a, b, differ`` that cover all pairs of leaves within the budget."""
    count = lambda depth: leaves.groupBy(_prefix(depth).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    depth = STRIDE
    nodes = checkpoint(count(depth))
    other = F.explode(F.array(*(F.lit(m).cast("long") for m in _masks(depth, budget))))
    pairs = nodes.select(F.col("p").alias("a"), F.col("n").alias("na"), other.alias("mask")).withColumn("b", F.col("a").bitwiseXOR(F.col("mask"))).where("a <= b")
    pairs = pairs.join(nodes.select(F.col("p").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", "na", "nb", F.bit_count("mask").alias("differ"))
    out = None
    while True:
        pairs = checkpoint(pairs)
        heavy = F.greatest("na", "nb") > node
        light = pairs.where(~heavy).select(F.lit(depth).alias("depth"), "a", "b", "differ")
        out = light if out is None else out.unionByName(light)
        pairs = pairs.where(heavy)
        if pairs.isEmpty():
            return checkpoint(out)
        depth += STRIDE
        nodes = checkpoint(count(depth))
        steps = [(p, q) for p in range(1 << STRIDE) for q in range(1 << STRIDE)]
        step = F.explode(F.array(*(F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q"), F.lit((p ^ q).bit_count()).alias("d")) for p, q in steps)))
        down = pairs.select("a", "b", "differ", step.alias("s")).select(
            (F.col("a") * (1 << STRIDE) + F.col("s.p")).alias("a"), (F.col("b") * (1 << STRIDE) + F.col("s.q")).alias("b"), (F.col("differ") + F.col("s.d")).alias("differ")
        )
        down = down.where((F.col("differ") <= budget) & (F.col("a") <= F.col("b")))
        pairs = down.join(nodes.select(F.col("p").alias("a"), F.col("n").alias("na")), "a").join(nodes.select(F.col("p").alias("b"), F.col("n").alias("nb")), "b")


def trie_links(leaves: DataFrame, budget: int = BUDGET, node: int = TILE_NODE) -> DataFrame:
    """Edges ``src, dst`` that connect the distinct fingerprints ``fp`` as all links within the budget do."""
    return tile_links(leaves, tiles(leaves, budget, node), budget)


def tile_links(leaves: DataFrame, found: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The edges that a walk of every tile finds."""
    depths = [row.depth for row in found.select("depth").distinct().collect()]  # 21 at most
    if not depths:
        return leaves.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    placed = leaves.select("fp", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(d).alias("p")) for d in depths))).alias("x")).select("fp", "x.depth", "x.p")
    blocks = placed.groupBy("depth", "p", F.pmod(F.xxhash64("fp"), F.lit(BLOCKS)).alias("block")).agg(F.collect_list("fp").alias("fps"))
    first = found.withColumn("p", F.col("a")).withColumn("side", F.lit(0))
    second = found.where("a <> b").withColumn("p", F.col("b")).withColumn("side", F.lit(1))
    rows = blocks.join(first.unionByName(second), ["depth", "p"]).select("depth", "a", "b", "differ", "side", "fps")
    return rows.groupBy("depth", "a", "b", "differ").applyInPandas(_tile(budget), "src long, dst long")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, budget: int = BUDGET, node: int = TILE_NODE) -> DataFrame:
    """``id``, ``fp`` and ``component_id``, the smallest id reachable by links."""
    prints = checkpoint(fingerprints(df, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed))
    leaves = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least")))
    groups = connected_components(trie_links(leaves, budget, node)).select(F.col("node").alias("fp"), F.col("component").alias("head"))
    headed = leaves.join(groups, "fp", "left").select("fp", "least", F.coalesce("head", "fp").alias("head"))
    names = headed.groupBy("head").agg(F.min("least").alias("component_id"))
    classes = checkpoint(headed.join(names, "head").select("fp", "component_id"))
    return prints.join(classes, "fp").select("id", "fp", "component_id")
