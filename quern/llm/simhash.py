"""SimHash near-dedup with BK-trees.

A text's fingerprint has 64 bits: bit b is set when more than half of the XXH64 hashes of its
three-word shingles have bit b set. Distinct fingerprints (not documents) are dealt to shards such
that any two within the radius share a shard: with 64 bits in 5 blocks and at most 3 differing
bits, two blocks agree, so a fingerprint goes to 10 shards, one for each pair of blocks. A shard of
more than SHARD fingerprints is dealt again on three of six parts of its other bits, by the same
argument; such a shard has at most 2**20 fingerprints, because no more bits are free, so no group
is unbounded. In each shard a BK-tree is built and asked: children are keyed by their integer Hamming
distance to the parent, and a search follows only the edges within the radius. Trees are co-located
with the fingerprints that ask them instead of being broadcast whole, because all trees together
grow with the corpus. A task passes on a spanning forest of its links, which keeps the connected
components and never lists all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import partitions, schema_of, texts, written

RADIUS = 3
#: Fingerprints of a shard above which it is dealt again on its other bits.
SHARD = 2048
#: Hashes that are held at once, and linked fingerprints of a task.
BLOCK, LINKED = 1 << 18, 1 << 18


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles with repeats; 0 without words."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(s, seed) for s in shingles), np.uint64, max(1, len(w) - words + 1))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp long); null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter(map(fingerprint, texts(b)), np.uint64, len(b)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp)], ["id", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([schema_of(rows, "id"), T.StructField("fp", T.LongType())]))


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of nearly equal consecutive parts of a list of bit numbers."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Masks of the first dealing (two of five blocks) and, for each, of the second (three of six parts of the other bits).
FIRST = [a | b for a, b in combinations(_cut(list(range(64)), 5), 2)]
SECOND = [[m | sum(c) for c in combinations(_cut([b for b in range(64) if not m >> b & 1], 6), 3)] for m in FIRST]


class BKTree:
    """Fingerprints by Hamming distance; each node is [fingerprint, {distance: node}]."""

    def __init__(self, radius: int = RADIUS):
        self.root, self.radius = None, radius

    def near_then_add(self, x: int) -> list[int]:
        """The fingerprints within the radius of x, then x is added (a fingerprint is added once)."""
        if self.root is None:
            self.root = [x, {}]
            return []
        found, stack, r = [], [self.root], self.radius
        while stack:
            at, children = stack.pop()
            d = (at ^ x).bit_count()
            if d <= r:
                found.append(at)
            for edge in range(d - r, d + r + 1):
                if edge in children:
                    stack.append(children[edge])
        node = self.root
        while d := (node[0] ^ x).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [x, {}]
                break
            node = child
        return found


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, k, fp) sorted by shard (c, k) -> links (u, v): forests of what this task links, LINKED fingerprints at a time."""
    up: dict[int, int] = {}

    def links() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(up)]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.array([p[i] for p in pairs], np.uint64).view(np.int64)) for i in (0, 1)], ["u", "v"])

    def root(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    shard, tree, first = None, None, 0
    for b in batches:
        for key, fp in zip(zip(b.column("c").to_pylist(), b.column("k").to_pylist(), strict=True), b.column("fp").to_pylist(), strict=True):
            x = fp & 0xFFFFFFFFFFFFFFFF
            if key != shard:
                shard, tree, first = key, None, x
                continue
            if tree is None:
                tree = BKTree()
                tree.near_then_add(first)
            for y in tree.near_then_add(x):
                p, q = root(x), root(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
            if len(up) >= LINKED:
                yield links()
    yield links()


def links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` within the radius, enough for their components."""
    n = partitions(nodes.sparkSession)
    dealt = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for c, m in enumerate(FIRST)))).alias("s")).select("fp", "s.c", "s.k")
    hot = dealt.groupBy("c", "k").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD).select("c", "k")
    hot = written(hot)
    second = F.element_at(F.array(*(F.array(*(F.lit(_signed(m)) for m in row)) for row in SECOND)), F.col("c") + 1)
    again = dealt.join(hot, ["c", "k"], "left_semi").select("fp", "c", F.posexplode(second).alias("j", "m")).select("fp", (10 + F.col("c") * 20 + F.col("j")).alias("c"), F.col("fp").bitwiseAND(F.col("m")).alias("k"))
    shards = dealt.join(hot, ["c", "k"], "left_anti").select("fp", "c", "k").unionByName(again.select("fp", "c", "k"))
    return shards.repartition(n, "c", "k").sortWithinPartitions("c", "k", "fp").mapInArrow(_forest, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links: root is the smallest node it reaches.

    Alternates the large-star and small-star steps; each round is a written table, and only a count
    and a checksum reach the driver.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (the smallest id that links reach).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Equal
    fingerprints are linked. Null ids are passed over when the smallest is taken, so a component of
    null ids only has a null component_id. Repeated rows get equal results. An empty table gives an
    empty result. Other columns are not read, so their names can't clash.
    """
    rows = written(fingerprints(df, id_col, text_col))
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("id")))
    roots = components(links(nodes))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    label = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(label, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
