"""Helpers that the operators share: the shared scratch folder, written tables, Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.files import new_folder

#: Bytes of text for a task of a shuffle; rows of a table that is broadcast; rows above which a join key is hot.
TASK_BYTES, BROADCAST_ROWS, HOT_ROWS = 128 << 20, 100_000, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder that driver and executors share, ``spark.checkpoint.dir``."""
    return new_folder(spark, "quern")


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder named by URI or by local path."""
    if "://" in uri or uri.startswith("file:"):
        scheme, _, rest = uri.partition(":")
        if scheme == "file":
            return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
        return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
    return pafs.LocalFileSystem(), uri


def schema_of(df: DataFrame, col: str, name: str | None = None) -> T.StructField:
    return T.StructField(name or col, df.schema[col].dataType, True)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def finite_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows as doubles) of the vectors of a list column that are neither null nor hold a null or non-finite entry; shorter vectors are padded with zeros to the longest."""
    sizes = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = column.is_valid().to_numpy(zero_copy_only=False).copy()
    good[row[~np.isfinite(flat)]] = False
    dim = int(sizes[good].max()) if good.any() else 0
    if (sizes[good] == dim).all():
        return np.flatnonzero(good), flat[good[row]].reshape(int(good.sum()), dim)
    out, place = np.zeros((len(sizes), dim)), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    of_good = good[row]
    out[row[of_good], place[of_good]] = flat[of_good]
    return np.flatnonzero(good), out[good]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ceil_div(a: int, b: int) -> int:
    return max(1, math.ceil(a / b))


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts of a column."""
    return df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def tasks_for(df: DataFrame, n_bytes: int) -> int:
    """Partitions for a shuffle of ``n_bytes`` of text: at least the session's number, and one for each TASK_BYTES."""
    return max(partitions(df.sparkSession), ceil_div(n_bytes, TASK_BYTES))


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``side``, which has one row per key and says in ``count`` how many rows have it.

    A side of at most BROADCAST_ROWS goes to the tasks whole. Of a larger one only the keys of
    more than HOT_ROWS rows do, of which there are at most one for each HOT_ROWS rows, as long as they too are at most
    BROADCAST_ROWS; all other keys are joined by a shuffle in which no key has more than HOT_ROWS rows.
    """
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), keys)
    hot = side.filter(F.col(count) > HOT_ROWS)
    if hot.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return rows.join(side, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.filter(F.col(count) <= HOT_ROWS), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def labelled(df: DataFrame, labels: DataFrame, mark: Column, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(key, mark, text) of at most ``sample`` labelled rows, those of the smallest id hashes (the key); of rows that share a labelled id, the one of the smallest text hash."""
    chosen = labels.select(F.col("doc_id").alias("_id"), mark.alias("mark")).filter("_id IS NOT NULL AND mark IS NOT NULL").groupBy("_id").agg(F.min("mark").alias("mark")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    return rows.groupBy("_id").agg(F.min("mark").alias("mark"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select(F.xxhash64("_id").alias("key"), "mark", "text")
