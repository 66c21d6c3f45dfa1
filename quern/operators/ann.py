"""Approximate dense search over a written index: cells, product codes, exact scores for a short list.

Writing: cells are the k-means centres of a bounded sample; a vector goes to the folder of its nearest cell with a code of
its residual, one byte for each of a few groups of dimensions, the nearest of that group's centres. Asking: a question asks the cells
nearest to it; only their folders are read, and of these first the codes alone, whose scores are sums of looked-up products. Its best
chunks by code, a few times as many as are wanted, are then scored exactly, from the vectors in the folders that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.vectors import normalised
from quern.operators.retrieval import _blocks, _matrix, top
from quern.sources.files import written

#: Vectors that cells and code centres are fitted on, at most; vectors of the sample for a cell at least; groups of dimensions; centres of a group; rounds of fitting.
SAMPLE, PER_CELL, GROUPS, CENTRES, ROUNDS = 16_384, 16, 16, 256, 12
#: Bytes of vectors for a task that writes; rows of short lists that are sent to all tasks; pairs that are scored at once.
TASK_BYTES, SENT, PAIRS = 64 << 20, 1_000_000, 1_000_000
#: Questions whose tables of products are held at once.
AT_ONCE = 512


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def group_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most ``k`` centres of rows, by Lloyd's rounds; a centre that loses all its rows stays where it is."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        of = nearest(x, centres)
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Codebook:
    """Cells with their shares of the sample, and the code centres of each group of dimensions."""

    def __init__(self, cells: np.ndarray, shares: np.ndarray, groups: list[np.ndarray]):
        self.cells, self.shares, self.groups = cells, shares, groups
        self.cuts = np.cumsum([0, *(g.shape[1] for g in groups)])

    @classmethod
    def fit(cls, x: np.ndarray, cells: np.ndarray, groups: int, centres: int, seed: int) -> Codebook:
        of = nearest(x, cells)
        rest = x - cells[of]
        parts = np.array_split(np.arange(x.shape[1]), min(groups, x.shape[1]))
        return cls(cells, np.bincount(of, minlength=len(cells)) / max(1, len(x)), [group_centres(rest[:, p], centres, seed + i) for i, p in enumerate(parts)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of unit rows."""
        cell = nearest(x, self.cells)
        rest = x - self.cells[cell]
        return cell, np.stack([nearest(rest[:, a:b], g) for a, b, g in zip(self.cuts, self.cuts[1:], self.groups)], axis=1).astype(np.uint8)

    def products(self, asked: np.ndarray) -> list[np.ndarray]:
        """For each group, questions by centres."""
        return [asked[:, a:b] @ g.T for a, b, g in zip(self.cuts, self.cuts[1:], self.groups)]

    def rows(self) -> list[tuple]:
        out = [(0, i, [float(s), *map(float, c)]) for i, (c, s) in enumerate(zip(self.cells, self.shares, strict=True))]
        return out + [(g + 1, i, list(map(float, c))) for g, centres in enumerate(self.groups) for i, c in enumerate(centres)]

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Codebook:
        rows = sorted(map(tuple, spark.read.parquet(f"{path}/codebook").collect()))  # as many as cells and code centres, which are bounded
        of = lambda k: np.array([v for kind, _, v in rows if kind == k])
        cells = of(0)
        return cls(cells[:, 1:], cells[:, 0], [of(k) for k in range(1, max(kind for kind, *_ in rows) + 1)])


def write_index(chunks: DataFrame, path: str, sample: int = SAMPLE, cells: int | None = None, groups: int = GROUPS, centres: int = CENTRES, seed: int = 7) -> str:
    """Writes the vectors of chunks (chunk_id, embedding) below ``path``: the codebook, and a folder per cell.

    There are as many cells as the square root of the number of vectors unless given, but no more than the sample has room for. Null vectors have none.
    A cell is dealt over as many tasks as its share of the bytes asks for, so a cell that holds most vectors is no hot key.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark, chunks = chunks.sparkSession, chunks.select("chunk_id", "embedding").filter("embedding IS NOT NULL")
    n, dim = chunks.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    some = written(chunks.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select(normalised(F.col("embedding")).alias("v")))
    held = np.array([r.v for r in some.collect()]).reshape(-1, dim)
    cells = cells or max(1, min(int(n**0.5), len(held) // PER_CELL))
    middle = np.zeros((1, dim)) if cells < 2 or not len(held) else np.array(KMeans(k=cells, seed=seed, maxIter=ROUNDS).fit(some.select(array_to_vector("v").alias("features"))).clusterCenters())
    book = Codebook.fit(held if len(held) else np.zeros((1, dim)), middle, groups, centres, seed)
    out = T.StructType([chunks.schema["chunk_id"], T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("codes", T.BinaryType()), T.StructField("cell", T.IntegerType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, codes = book.encode(_matrix(b.column("embedding"), dim))
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), b.column("embedding").cast(pa.list_(pa.float32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell, pa.int32())], [f.name for f in out])

    tasks = -(-n * dim * 4 // TASK_BYTES)
    parts = max(1, -(-tasks // len(book.cells)))
    rows = chunks.mapInArrow(encode, out).repartition(max(1, tasks, parts * len(book.cells) // 8), "cell", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)))
    rows.sortWithinPartitions("cell", "chunk_id").write.partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame(book.rows(), "kind int, number int, values array<double>").coalesce(1).write.parquet(f"{path}/codebook")
    return path


def asked_cells(book: Codebook, asked: np.ndarray, share: float) -> np.ndarray:
    """Questions by cells: whether a question asks a cell, the nearest ones that hold ``share`` of the sample."""
    order = np.argsort((book.cells**2).sum(axis=1) - 2 * asked @ book.cells.T, axis=1, kind="stable")
    before = np.cumsum(book.shares[order], axis=1) - book.shares[order]
    out = np.zeros((len(asked), len(book.cells)), bool)
    np.put_along_axis(out, order, before < share, axis=1)
    return out


def search(queries: DataFrame, path: str, k: int = 10, share: float = 0.7, short: int = 10, floor: float = -1.0) -> DataFrame:
    """(query_id, chunk_id, similarity, position): the best ``k`` chunks of a written index that are found in the asked cells.

    short: so many times ``k`` chunks of the best codes are scored exactly. Questions go to the tasks in blocks; folders that no question of the block asks aren't read.
    """
    spark = queries.sparkSession
    book, index = Codebook.read(spark, path), spark.read.parquet(f"{path}/vectors")
    kept = T.StructType([queries.schema["query_id"], index.schema["chunk_id"], T.StructField("cell", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
    limit, lists = k * short, []
    for ids, asked in _blocks(queries.filter("query_embedding IS NOT NULL")):
        if not len(ids):
            continue
        asked = np.pad(asked, ((0, 0), (0, max(0, book.cells.shape[1] - asked.shape[1]))))[:, : book.cells.shape[1]]
        asks = asked_cells(book, asked, share)

        def by_code(batches: Iterator[pa.RecordBatch], ids: pa.Array = ids, asks: np.ndarray = asks, asked: np.ndarray = asked) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = b.column("cell").to_numpy()
                codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(cells), -1)
                for c in np.unique(cells):
                    mine, all_who = np.flatnonzero(cells == c), np.flatnonzero(asks[:, c])
                    for j in range(0, len(all_who), AT_ONCE):  # tables of products are made for few questions at a time
                        who = all_who[j : j + AT_ONCE]
                        tables, base = book.products(asked[who]), asked[who] @ book.cells[c]
                        for i in range(0, len(mine), step := max(1, PAIRS // len(who))):
                            some = mine[i : i + step]
                            s = np.repeat(base[:, None], len(some), axis=1)
                            for g, t in enumerate(tables):
                                s += t[:, codes[some, g]]
                            least = np.partition(s, -limit, axis=1)[:, -limit][:, None] if s.shape[1] > limit else -np.inf
                            q, at = np.nonzero(s >= least)
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[q])), b.column("chunk_id").take(pa.array(some[at])), pa.array(np.full(len(q), c, np.int32)), pa.array(s[q, at])], [f.name for f in kept])

        folders = np.flatnonzero(asks.any(axis=0)).tolist()
        lists.append(index.filter(F.col("cell").isin(folders)).select("cell", "chunk_id", "codes").mapInArrow(by_code, kept))
    if not lists:
        return spark.createDataFrame([], T.StructType([*kept.fields[:2], T.StructField("similarity", T.DoubleType()), T.StructField("position", T.IntegerType())]))
    best = written(top(reduce(DataFrame.unionByName, lists), "similarity", limit).select("query_id", "cell", "chunk_id"))
    folders = [r.cell for r in best.select("cell").distinct().collect()]
    one = best.groupBy("cell", "chunk_id").agg(F.collect_list("query_id").alias("of"))
    vectors = index.filter(F.col("cell").isin(folders)).select("cell", "chunk_id", "embedding")
    found = vectors.join(F.broadcast(one) if one.limit(SENT + 1).count() <= SENT else one, ["cell", "chunk_id"])
    pairs = found.select(F.explode("of").alias("query_id"), "chunk_id", "embedding").join(queries.select("query_id", "query_embedding"), "query_id")
    return top(pairs.select("query_id", "chunk_id", F.round(_cosine(), 6).alias("similarity")).filter(F.col("similarity") >= floor), "similarity", k)


def _cosine():
    from quern.functions.vectors import cosine

    return cosine(F.col("embedding"), F.col("query_embedding"))


def share_of_bytes(queries: DataFrame, path: str, k: int = 10, share: float = 0.7, short: int = 10) -> float:
    """Bytes of codes and vectors that ``search`` reads, against those of all vectors, which a search without an index reads."""
    spark = queries.sparkSession
    book, index = Codebook.read(spark, path), spark.read.parquet(f"{path}/vectors")
    rows = {r.cell: r.n for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    asked = set().union(*(np.flatnonzero(asked_cells(book, a, share).any(axis=0)).tolist() for _, a in _blocks(queries)))
    held = {r.cell for r in search(queries, path, k, share, short).join(index.select("cell", "chunk_id"), "chunk_id").select("cell").distinct().collect()}
    vector = 4 * book.cells.shape[1]
    return (sum(rows.get(c, 0) for c in asked) * len(book.groups) + sum(rows.get(c, 0) for c in held) * vector) / max(1, sum(rows.values()) * vector)
