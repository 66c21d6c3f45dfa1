"""Hard negatives by spanning-tree bounds between anchors.

Anchors of one label are dealt into trees of at most TREE (those near one pivot together), and each tree is
a minimum spanning tree: an anchor has a parent and the length of the edge to it. For a row c, the scores of
a child and its parent differ by at most the edge times c's length, since <c, child> - <c, parent> = <c, child - parent>. So
tasks go down the trees level by level with an interval for each score: the root's is exact, a child's is its
parent's, wider by edge times length. Only where the interval meets the range that the child still looks for
is the row scored against the child, which makes its interval exact; all others are passed over, and their wider interval is handed on.

Two passes over all rows, which are read where they lie and never shuffled. The first looks for each
anchor's best rows of its own label: scores from the worst of the best found so far up. The second looks for rows of other labels whose
scores lie in the windows below the positives' scores, again only those better than what the task has found. A task
hands on its best rows of each anchor and window once, at its end; ranks are taken over these.

Anchors are the stated query set. They go to the tasks in blocks of whole trees, BLOCK_BYTES of vectors at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import ceil_div, finite_vectors, join_counted, written

#: Anchors of a tree and bytes of anchors' vectors that a task holds; pivots at most; rows scored at once, at first and later; pairs that a task gathers before it keeps the best.
TREE, BLOCK_BYTES, PIVOTS, FIRST, TILE, GATHERED = 512, 32 << 20, 4096, 256, 2048, 1 << 18
#: Where more than this share of the pairs between some anchors and rows are to be scored, one matrix product scores them all, which costs no more.
DENSE = 1 / 8
#: Widens bounds by more than rounding.
SLACK = 1 + 1e-9
PAIR = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])


def quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, whole numbers as doubles) of the vectors that take part."""
    at, x = finite_vectors(column)
    return at, np.floor(scale * x)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge, depth) of the minimum spanning tree from row 0, by levels; parents are places in that order, the root's is -1."""
    n = len(x)
    near, edge, parent = np.zeros(n, np.int64), np.sqrt(((x - x[0]) ** 2).sum(axis=1)), np.full(n, -1)
    out, depth, length = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n)
    out[0] = False
    for _ in range(n - 1):
        k = int(np.argmin(np.where(out, edge, np.inf)))
        out[k], parent[k], length[k], depth[k] = False, near[k], edge[k], depth[near[k]] + 1
        far = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        closer = out & (far < edge)
        edge[closer], near[closer] = far[closer], k
    order = np.argsort(depth, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, np.where(parent[order] < 0, -1, place[parent[order]]), length[order], depth[order]


def plant(rows: DataFrame, scale: int) -> DataFrame:
    """The trees of the anchors (id, label, vec), written: a row per anchor with its key ``anchor``, tree, parent, edge and depth.

    A pivot is one of at most PIVOTS anchors of a bounded sample; an anchor goes to the nearest. A label's anchors at a pivot are
    one tree, or where they are many, as many trees as that takes, by the hash of the id and vector.
    """
    kept = T.StructType([*rows.schema.fields[:2], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = quantised(b.column("vec"), scale)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("id", "label")), lists], [f.name for f in kept])

    found = written(rows.mapInArrow(whole, kept).distinct())
    pivots = found.orderBy(F.xxhash64("id", "x"), "id").limit(min(PIVOTS, ceil_div(found.count(), TREE))).select("x").toArrow().column("x").combine_chunks()
    _, middle = finite_vectors(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = finite_vectors(b.column("x"))
            d = max(x.shape[1], middle.shape[1])
            x, m = (np.pad(v, ((0, 0), (0, d - v.shape[1]))) for v in (x, middle))
            at = ((m**2).sum(axis=1) - 2 * x @ m.T).argmin(axis=1) if len(m) > 1 else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(at, pa.int32())], [*(f.name for f in kept), "pivot"])

    dealt = found.mapInArrow(nearest, T.StructType([*kept.fields, T.StructField("pivot", T.IntegerType())]))
    sizes = dealt.groupBy("label", "pivot").agg(F.count("*").alias("of"))
    dealt = join_counted(dealt, sizes, ["label", "pivot"], "of").withColumn("part", F.pmod(F.xxhash64("id", "x"), F.ceil(F.col("of") / TREE)))
    out = T.StructType([T.StructField("id", T.LongType()), kept["label"], kept["x"], T.StructField("parent", T.IntegerType()), T.StructField("edge", T.DoubleType()), T.StructField("depth", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("tree", T.StringType())])

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        _, x = finite_vectors(table.column("x").combine_chunks())
        order, parent, edge, depth = spanning_tree(x)
        name = "/".join(str(table.column(c)[0].as_py()) for c in ("label", "pivot", "part"))
        cols = [table.column(c).take(pa.array(order)).combine_chunks() for c in ("id", "label", "x")]
        cols += [pa.array(parent, pa.int32()), pa.array(edge), pa.array(depth, pa.int32()), pa.array(np.arange(len(x)), pa.int32()), pa.array([name] * len(x))]
        return pa.Table.from_arrays(cols, [f.name for f in out])

    trees = written(dealt.select("id", "label", "x", "pivot", "part").groupBy("label", "pivot", "part").applyInArrow(grow, out))
    return written(trees.withColumn("anchor", F.monotonically_increasing_id()))


class Forest:
    """Trees of a block, in a task: looks for rows in ranges of scores."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, parent: np.ndarray, edge: np.ndarray, depth: np.ndarray):
        self.keys, self.ids, self.labels, self.x, self.edge = keys, ids, labels, x, edge * SLACK
        starts = np.flatnonzero(parent < 0)
        self.trees = []
        for a, b in zip(starts, [*starts[1:], len(parent)], strict=True):
            levels = [np.arange(a, b)[depth[a:b] == k] for k in range(int(depth[a:b].max()) + 1)]
            self.trees.append((int(labels[a]), [(nodes, a + parent[nodes]) for nodes in levels]))
        self.asked = self.scored = 0

    def products(self, nodes: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores of anchors by rows."""
        self.scored += len(nodes) * len(c)
        return self.x[nodes] @ c.T

    def search(self, levels: list, c: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, rows, scores) of the pairs of one tree whose score lies in the anchor's range [low, high]."""
        first, last = levels[0][0][0], levels[-1][0][-1] + 1
        least, most = np.empty((last - first, len(c))), np.empty((last - first, len(c)))
        for nodes, parents in levels:
            own, self.asked = nodes - first, self.asked + len(nodes) * len(c)
            if nodes[0] == first:
                least[0] = most[0] = self.products(nodes, c)[0]
                need = np.ones((1, len(c)), bool)
            else:
                width = np.outer(self.edge[nodes], length)
                least[own], most[own] = least[parents - first] - width, most[parents - first] + width
                need = (most[own] >= low[nodes, None]) & (least[own] <= high[nodes, None])
                if not need.any():
                    continue
                of, at = np.flatnonzero(need.any(axis=1)), np.flatnonzero(need.any(axis=0))
                if np.count_nonzero(need) > DENSE * len(of) * len(at):
                    box = np.ix_(own[of], at)
                    least[box] = most[box] = self.products(nodes[of], c[at])
                else:
                    of, at = np.nonzero(need)
                    self.scored += len(of)
                    least[own[of], at] = most[own[of], at] = np.einsum("ij,ij->i", self.x[nodes[of]], c[at])
            s = least[own]
            of, at = np.nonzero(need & (s >= low[nodes, None]) & (s <= high[nodes, None]))
            yield nodes[of], at, s[of, at]


def first_of(group: list[np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, by falling score, then id."""
    order = np.lexsort((ids, -score, *group[::-1]))
    same = np.ones(len(order), bool)
    for g in group:
        same[1:] &= g[order][1:] == g[order][:-1]
    same[:1] = False
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return order[np.arange(len(order)) - start < k]


class Best:
    """What a task has found: for each anchor and window, the first k rows at or below the window's upper end."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.floor, self.high, self.k = low.copy(), high, k
        self.pairs = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        self.fresh, self.size = [], 0
        self._range()

    def _range(self) -> None:
        """What an anchor still looks for: from the least score that could enter one of its windows to the highest upper end."""
        self.low, self.top = self.floor.min(axis=1, initial=np.inf), self.high.max(axis=1, initial=-np.inf)

    def add(self, anchors: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.fresh.append([anchors, ids, score])
        self.size += len(ids)
        if self.size > max(GATHERED, len(self.pairs[0])):
            self.settle()

    def settle(self) -> None:
        if not self.fresh:
            return
        anchors, ids, score = (np.concatenate(c) for c in zip(self.pairs, *self.fresh, strict=True))
        window, pair = np.nonzero(((score[:, None] >= self.floor[anchors]) & (score[:, None] <= self.high[anchors])).T)
        kept = first_of([anchors[pair], window], score[pair], ids[pair], self.k)
        window, pair = window[kept], pair[kept]
        full = np.zeros(self.floor.shape, np.int64)
        np.add.at(full, (anchors[pair], window), 1)
        worst = np.full(self.floor.shape, np.inf)
        np.minimum.at(worst, (anchors[pair], window), score[pair])
        self.floor = np.where(full == self.k, worst, self.floor)
        pair = np.unique(pair)
        self.pairs, self.fresh, self.size = [anchors[pair], ids[pair], score[pair]], [], 0
        self._range()


def _search(rows: DataFrame, anchors: DataFrame, windows: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], same: bool, k: int, scale: int) -> DataFrame:
    """(anchor, id, score) with the first k rows of each of an anchor's windows among a task's rows, those of the anchor's label or of the others; an anchor's own id is left out."""
    size = anchors.agg(F.coalesce(F.sum(F.size("x")), F.lit(0))).first()[0] * 8
    blocks, parts = ceil_div(size, BLOCK_BYTES), []
    for block in range(blocks):
        table = anchors.filter(F.pmod(F.xxhash64("tree"), F.lit(blocks)) == block).toArrow().sort_by([("tree", "ascending"), ("place", "ascending")])
        if not len(table):
            continue
        keys, ids, parent, edge, depth = (table.column(c).to_numpy() for c in ("anchor", "id", "parent", "edge", "depth"))
        names = pc.unique(table.column("label"))
        _, x = finite_vectors(table.column("x").combine_chunks())
        labels = pc.index_in(table.column("label"), value_set=names).to_numpy()
        low, high = windows(table)

        def look(batches: Iterator[pa.RecordBatch], tree: tuple = (keys, ids, labels, x, parent, edge, depth), names: pa.Array = names, low: np.ndarray = low, high: np.ndarray = high) -> Iterator[pa.RecordBatch]:
            forest, best, tile = Forest(*tree), Best(low, high, k), FIRST
            for b in batches:
                at, c = quantised(b.column("vec"), scale)
                if c.shape[1] != forest.x.shape[1]:
                    d = max(c.shape[1], forest.x.shape[1])
                    c, forest.x = (np.pad(v, ((0, 0), (0, d - v.shape[1]))) for v in (c, forest.x))
                row_ids = b.column("id").to_numpy()[at]
                label = pc.fill_null(pc.index_in(b.column("label"), value_set=names), -1).to_numpy()[at]
                length = np.sqrt((c**2).sum(axis=1))
                begin = 0
                while begin < len(c):
                    here = slice(begin, begin + tile)
                    for of, levels in forest.trees:
                        some = begin + np.flatnonzero((label[here] == of) == same)
                        if len(some):
                            for nodes, rows_, score in forest.search(levels, c[some], length[some], best.low, best.top):
                                found = row_ids[some[rows_]]
                                other = found != forest.ids[nodes] if same else np.ones(len(found), bool)
                                best.add(nodes[other], found[other], score[other])
                    if tile == FIRST:
                        best.settle()
                    begin, tile = begin + tile, TILE
            best.settle()
            out = [best.pairs[0], best.pairs[1], np.clip(best.pairs[2], -(2.0**63), 2.0**63 - 1024).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(forest.keys[out[0]]), *map(pa.array, out[1:])], [f.name for f in PAIR])

        parts.append(rows.mapInArrow(look, PAIR))
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], PAIR)


def mine(df: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its positives, the first negatives in the window below the positive's score.

    Components become floor(scale * x), and a score is the whole-number inner product (a shorter vector counts as padded with zeros). Higher scores come first, ties by smaller id. An anchor's positives are its first
    ``positives`` other rows (rows of another id) of its label; its negatives at one are the first ``negatives``
    rows of other labels with least * positive_score <= 100 * negative_score <= most * positive_score.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. Repeated rows
    are each a row among the positives and negatives, and one anchor together; rows of one id that differ are
    anchors of their own. Scores are exact up to 2^53, and doubles beyond. An anchor without positives, or a positive without negatives, has no rows; nor has an empty table. Other columns are not read. Ids are whole numbers.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"), anchors.alias("asks")).filter("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    trees = plant(rows.filter("asks").select("id", "label", "vec"), scale)
    rows = rows.select("id", "label", "vec")
    pairs = _search(rows, trees, lambda t: (np.full((len(t), 1), -np.inf), np.full((len(t), 1), np.inf)), True, positives, scale)
    w = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
    ranked = pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= positives)
    found = written(ranked.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = found.groupBy("anchor").agg(F.collect_list("positive_score").alias("scores"))

    def windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        high = np.full((len(table), positives), -np.inf)
        low = np.full((len(table), positives), np.inf)
        for k, s in enumerate(table.column("scores").to_pylist()):
            low[k, : len(s)], high[k, : len(s)] = [-(-least * x // 100) for x in s], [most * x // 100 for x in s]
        return low, high

    pairs = _search(rows, trees.join(scores, "anchor"), windows, False, negatives, scale)
    both = pairs.join(found, "anchor").filter((least * F.col("positive_score") <= 100 * F.col("score")) & (100 * F.col("score") <= most * F.col("positive_score")))
    w = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "id")
    ranked = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= negatives)
    names = trees.select("anchor", F.col("id").alias("anchor_id"))
    return ranked.join(names, "anchor").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
