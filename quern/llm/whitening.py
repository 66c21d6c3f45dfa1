"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows, the method builds orthonormal u_1, u_2, ... (as long as X has rows) and v_1, v_2, ...
(as long as a vector) by alternating products with X and its transpose::

    a_j u_j = X v_j - b_(j-1) u_(j-1)        b_j v_(j+1) = X' u_j - a_j v_j

so that X V = U B with B upper bidiagonal (a on the diagonal, b above it). The singular values of the small B,
over the root of the number of rows, are the components' deviations, and V times its right vectors are the components.

The rows stay where they are, in a table of packed blocks that is written once, and one pass over it makes
both products of a step. A u_j is never stored: it is X w_j for a short vector w_j, so a task gets
the short vectors and makes its own rows of all u. With p = X y, y = v_j - b_(j-1) w_(j-1), a pass sums U'p, p'p, X'p and
U'u_(j-1) over its rows. From these the driver takes p's parts along earlier u out, twice (the second time with the inner products
of the u among themselves, as measured, so the u stay orthonormal to the last digits), and X'u_j follows from X'p by the same
steps. All that reaches the driver are sums of about two dimensions and the step's number; tasks' sums are added in a shuffle first.

Where b_j or a_j is nothing but rounding, the vectors found so far are closed under both products; then b_j = 0
and a new direction starts, so that equal eigenvalues are found as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import finite_vectors, schema_of, written

#: Entries become floor(SCALE * entry) + SHIFT: fixed values of the contract.
SCALE, SHIFT = 64, 1_000_000
#: A share of the largest singular value below which a length is rounding; one below which a residual is; dimensions up to which all steps are made.
NOTHING, SETTLED, FULL = 1e-10, 1e-14, 512


def pack(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Blocks of the rows that take part, written: ids, n, dim, x (integers less SHIFT, in the narrowest type) and their sums by dimension."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    id_type = schema_of(rows, "id").dataType
    out = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("n", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("x", T.BinaryType()), T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, c = finite_vectors(b.column("vec"))
            x = np.clip(np.floor(SCALE * c), -(2.0**62), 2.0**62).astype(np.int64)
            most = int(np.abs(x).max(initial=0))
            width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
            total = x.sum(axis=0).tolist() if most * max(1, len(x)) < 1 << 62 else [sum(map(int, col)) for col in x.T]
            ids = b.column("id").take(pa.array(at))
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            cols = [ids, pa.array([len(x)]), pa.array([x.shape[1]], pa.int32()), pa.array([width], pa.int32()), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary()), pa.array([total], pa.list_(pa.decimal128(38, 0)))]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in out])

    return written(rows.mapInArrow(blocks, out))


def _integers(b: pa.RecordBatch, k: int, dim: int) -> np.ndarray:
    """The k-th block of a batch; a block of fewer dimensions is padded with what a zero entry gives."""
    n, own, width = (b.column(c)[k].as_py() for c in ("n", "dim", "width"))
    x = np.frombuffer(b.column("x")[k].as_buffer(), f"<i{width}").reshape(n, own)
    return x if own == dim else np.pad(x, ((0, 0), (0, dim - own)))


class Rows:
    """The packed rows with their number, dimensions and exact sums."""

    def __init__(self, packed: DataFrame):
        self.packed = packed
        self.n, self.dim = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(0))).first()
        found = packed.select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).collect()
        self.sums = [0] * self.dim
        for k, s in found:
            self.sums[k] = int(s)
        self.mean = np.array([s / max(1, self.n) for s in self.sums])

    def total(self, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all blocks of ``of`` (a centred block), ``size`` numbers; tasks add theirs, and a shuffle adds the tasks'."""
        dim, mean = self.dim, self.mean

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                for k in range(b.num_rows):
                    total += of(_integers(b, k, dim) - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["k", "s"])

        found = self.packed.select("n", "dim", "width", "x").mapInArrow(sums, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow()
        out = np.zeros(size)
        out[found.column("k").to_numpy()] = found.column("s").to_numpy()
        return out


def bidiagonalise(rows: Rows, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, right singular vectors as columns) of the centred rows, ``wanted`` at most.

    As many steps as dimensions up to FULL dimensions; beyond, the steps end when the residuals of the wanted vectors are rounding.
    """
    d, rng = rows.dim, np.random.default_rng(seed)

    def fresh(basis: np.ndarray) -> np.ndarray:
        v = rng.standard_normal(d)
        for _ in range(3):
            v -= basis @ (basis.T @ v)
            v /= np.linalg.norm(v)
        return v

    v, w, z, gram = (np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((0, 0)))
    diagonal, above, largest = [], [], 0.0
    new = fresh(v)
    while True:
        j = len(diagonal)
        v = np.column_stack([v, new])
        y = new - (above[-1] * w[:, -1] if j else 0.0)

        def step(x: np.ndarray, y: np.ndarray = y, w: np.ndarray = w) -> np.ndarray:
            p, u = x @ y, x @ w
            return np.concatenate([u.T @ p, [p @ p], x.T @ p, u.T @ u[:, -1] if w.shape[1] else []])

        got = rows.total(step, 2 * j + 1 + d)
        g, s, t, last = got[:j], got[j], got[j + 1 : j + 1 + d], got[j + 1 + d :]
        if j:
            gram = np.block([[gram, last[:-1, None]], [last[None, :]]])
        c = g + (g - gram @ g)
        length = np.sqrt(max(0.0, s - 2 * c @ g + c @ gram @ c))
        largest = max(largest, length)
        if length > NOTHING * largest:
            w, z = np.column_stack([w, (y - w @ c) / length]), np.column_stack([z, (t - z @ c) / length])
        else:
            length, w, z = 0.0, np.column_stack([w, np.zeros(d)]), np.column_stack([z, np.zeros(d)])
        diagonal.append(length)
        if j + 1 == d:
            break
        r = z[:, -1] - length * v[:, -1]
        for _ in range(2):
            r -= v @ (v.T @ r)
        b = float(np.linalg.norm(r))
        largest = max(largest, b)
        new, b = (r / b, b) if b > NOTHING * largest else (fresh(v), 0.0)
        above.append(b)
        if d > FULL and j + 1 > wanted and (j + 1) % 8 == 0:
            left, values, _ = np.linalg.svd(np.diag(diagonal) + np.diag(above[:-1], 1))
            if (b * np.abs(left[-1, :wanted]) <= SETTLED * values[0]).all():
                above.pop()
                break
    _, values, right = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1))
    good = min(wanted, int((values > NOTHING * max(largest, 1e-300)).sum()))
    return values[:good], v @ right[:good].T


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32, name: str = "whitened") -> DataFrame:
    """One row per row that takes part: id_col, n, deviation decimal(38,0), the array ``name`` (a place per component), and the same arrays ``explained`` and value identity_error in every row.

    A vector that is null or holds a null or non-finite entry is left out. Entries become whole numbers (floor(64 c) + 1,000,000), those beyond 2^62 are held there, and a deviation of more than 38 digits is null; a vector shorter than the longest counts as padded with zeros. Components are the eigenvectors of the covariance (divisor n) by
    falling eigenvalue; a direction in which the rows don't vary (singular value below 1e-10 of the
    largest) is no component, so equal rows or a single row have an empty array, and fewer distinct rows than components fewer places.
    Null, repeated and tied ids stay rows of their own. No rows, or rows of empty vectors only, give an empty result. Other columns are not read.
    """
    rows = Rows(pack(df, id_col, vec_col))
    id_field = T.StructField("id", df.schema[id_col].dataType)
    out = T.StructType([id_field, T.StructField("deviation", T.DecimalType(38, 0)), T.StructField(name, T.ArrayType(T.DoubleType()))])
    if not rows.n or not rows.dim:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(id_col, id_field.dataType), T.StructField("n", T.LongType()), *out.fields[1:], T.StructField("explained", T.ArrayType(T.DoubleType())), T.StructField("identity_error", T.DoubleType())]))
    values, vectors = bidiagonalise(rows, min(components, rows.dim))
    k, n, dim, mean, sums = len(values), rows.n, rows.dim, rows.mean, rows.sums
    scaled = vectors * (np.sqrt(n) / values)

    def spread(x: np.ndarray) -> np.ndarray:
        y = x @ scaled
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0), [np.einsum("ij,ij", x, x)]])

    got = rows.total(spread, k * k + k + 1)
    middle = got[k * k : k * k + k] / n
    error = float(np.abs(got[: k * k].reshape(k, k) / n - np.outer(middle, middle) - np.eye(k)).max(initial=0.0))
    explained = (values**2 / got[-1]).tolist() if k else []

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = _integers(b, i, dim)
                y = (x - mean) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), pa.array([a if a < 10**38 else None for a in deviations(x, n, sums)], pa.decimal128(38, 0)), lists], [f.name for f in out])

    done = rows.packed.select("ids", "n", "dim", "width", "x").mapInArrow(finish, out)
    lit = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    return done.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", name, lit.alias("explained"), F.lit(error).alias("identity_error"))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over dimensions of (n x - S)^2 of each row; SHIFT falls out."""
    most = n * int(np.abs(x.astype(np.int64)).max(initial=0)) + max(map(abs, sums))
    if most >= 1 << 47:
        return [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    away = x.astype(np.int64) * n - np.array(sums, np.int64)
    if most * most * x.shape[1] < 1 << 62:
        return np.einsum("ij,ij->i", away, away).tolist()
    high, low = away >> 24, away & 0xFFFFFF
    a, b, c = (np.einsum("ij,ij->i", p, q).tolist() for p, q in ((high, high), (high, low), (low, low)))
    return [(i << 48) + (j << 25) + m for i, j, m in zip(a, b, c, strict=True)]


def components_long(done: DataFrame, id_col: str = "vec_id", name: str = "whitened") -> DataFrame:
    """``whiten``'s rows with one row for each component, numbered from 1; a deviation beyond a long is null."""
    placed = done.select(id_col, "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "explained", "identity_error", F.posexplode(name).alias("place", name))
    return placed.select(id_col, (F.col("place") + 1).alias("component"), "n", "deviation", name, F.element_at("explained", F.col("place") + 1).alias("explained"), "identity_error")
