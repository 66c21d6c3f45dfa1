"""Token ids in Arrow IPC files of fixed-size-list batches.

Documents are dealt by ranges of their id, so file k holds smaller ids than file k + 1 and documents
are in ascending order in each file. A task encodes its documents, ends each with the end id, and
writes one file of equal-length sequences: column ``ids`` is a fixed-size list of unsigned 16-bit
ids (32-bit for vocabularies over 65,536), column ``mask`` marks the real ids; only a file's last
sequence is padded. Batches are uncompressed, so a memory map gives any sequence and its mask without
copying. A second, small file holds each document's place. A file's name is new for each attempt and
is listed in the manifest only by the attempt whose output Spark commits, so a lost executor or a
second attempt leaves no half file in use.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import open_fs, schema_of, shared_dir, tasks_for, text_bytes, texts, written

SEQUENCE, BATCH = 2048, 256
#: Words whose ids a worker remembers and the bytes of such a word, at most; words that are given to the tokenizer as one text, and texts whose new words are learned at once.
MEMO, REMEMBERED, JOINED, TEXTS = 1_000_000, 64, 256, 128
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_sequences long"


class WordEncoder:
    """Ids of texts for a tokenizer that drops white space: each word between ASCII white space is encoded once and remembered, but for long ones.

    New words are given to the tokenizer many at a time, joined by spaces, and its offsets tell
    whose ids are whose. Texts need not fit: white space of other kinds stays inside a word and is
    handled by the tokenizer.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.memo = Tokenizer.from_file(path), dtype, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def learn(self, new: list[bytes], known: dict[bytes, bytes]) -> None:
        """Puts the ids of new words in ``known``."""
        groups = [[w.decode() for w in new[i : i + JOINED]] for i in range(0, len(new), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            starts = np.cumsum([0] + [len(w) + 1 for w in group])
            cuts = np.searchsorted(np.array([a for a, _ in e.offsets], np.int64), starts)
            for w, a, b in zip(group, cuts, cuts[1:], strict=False):
                known[w.encode()] = ids[a:b].tobytes()

    def encode(self, batch: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, as bytes."""
        memo = self.memo
        for i in range(0, len(batch), TEXTS):
            texts_words = [t.split() for t in batch[i : i + TEXTS]]
            new = set().union(*texts_words).difference(memo)
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = set().union(*texts_words)
            long = {w for w in new if len(w) > REMEMBERED}
            self.learn(list(new - long), memo)
            for w in texts_words:
                if long.isdisjoint(w):
                    yield b"".join([memo[x] for x in w])
                else:
                    here: dict[bytes, bytes] = {}
                    self.learn(list(long.intersection(w)), here)
                    yield b"".join([here[x] if x in here else memo[x] for x in w])


@lru_cache(maxsize=2)
def word_encoder(path: str, dtype: str) -> WordEncoder:
    """A worker keeps what it has learned from one task to the next."""
    return WordEncoder(path, dtype)


class _Writer:
    """Fills sequences and writes batches of them."""

    def __init__(self, sink, dtype: str, end: int, length: int):
        self.dtype, self.end, self.length, self.held, self.n = np.dtype(dtype), end, length, bytearray(), 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.held += ids
        full = BATCH * self.length * self.dtype.itemsize
        while len(self.held) >= full:
            self._write(bytes(self.held[:full]), BATCH * self.length)
            del self.held[:full]

    def _write(self, ids: bytes, real: int) -> None:
        flat = np.frombuffer(ids, self.dtype)
        mask = np.arange(len(flat)) < real
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)], schema=self.schema))
        self.n += len(flat) // self.length

    def close(self) -> int:
        if self.held:
            real = len(self.held) // self.dtype.itemsize
            self._write(bytes(self.held) + np.full(-real % self.length, self.end, self.dtype).tobytes(), real)
        self.out.close()
        return self.n


class TokenFile:
    """Random access to the sequences of one file, without copies where the file is local."""

    def __init__(self, path: str):
        fs, at = open_fs(path)
        self.source = pa.memory_map(at) if fs.type_name == "local" else fs.open_input_file(at)
        self.file = ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size

    def flat(self, batch: int) -> np.ndarray:
        return self.file.get_batch(batch).column("ids").values.to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Sequence i and its mask, as views."""
        b = self.file.get_batch(i // BATCH)
        at = (i % BATCH) * self.length
        return b.column("ids").values.slice(at, self.length).to_numpy(zero_copy_only=True), b.column("mask").values.slice(at, self.length)


def write_tokens(df: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, vocabulary: int = 49_408) -> DataFrame:
    """Writes the files and returns their manifest: part, path, n_docs, n_tokens, n_sequences; parts are in id order.

    A file takes about TASK_BYTES of text, or less where the session has more shuffle partitions. Null texts count as empty; null ids come first; equal ids are ordered by their texts' hash.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = encoder = None
        places: list[pa.RecordBatch] = []
        end, n_tokens, n_docs = np.array([end_id], dtype).tobytes(), 0, 0
        for b in batches:
            if writer is None:
                encoder, part, name = word_encoder(tokenizer, dtype), TaskContext.get().partitionId(), uuid.uuid4().hex
                fs, at = open_fs(folder)
                fs.create_dir(at, recursive=True)
                path = f"{folder}/{part:06d}-{name}"
                sink = fs.open_output_stream(f"{at}/{part:06d}-{name}.tokens.arrow")
                writer = _Writer(sink, dtype, end_id, length)
            sizes = []
            for ids in encoder.encode(texts(b)):
                writer.add(ids + end)
                sizes.append(len(ids) // np.dtype(dtype).itemsize + 1)
            ends = n_tokens + np.cumsum(sizes)
            places.append(pa.RecordBatch.from_arrays([b.column("id"), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64())], ["id", "at", "n"]))
            n_tokens, n_docs = n_tokens + sum(sizes), n_docs + len(b)
        if writer is not None:
            n_sequences = writer.close()
            sink.close()
            with fs.open_output_stream(f"{at}/{part:06d}-{name}.docs.arrow") as s, ipc.new_file(s, places[0].schema) as out:
                for p in places:
                    out.write_batch(p)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), *(pa.array([x], pa.int64()) for x in (n_docs, n_tokens, n_sequences))], ["part", "path", "n_docs", "n_tokens", "n_sequences"])

    ranges = rows.repartitionByRange(tasks_for(rows, text_bytes(rows)), F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return written(ranges.sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text")).mapInArrow(run, MANIFEST))


def read_documents(manifest: DataFrame, id_type: T.DataType) -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    n = max(1, manifest.count())
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before).select("part", "path", "before").repartition(n, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                tokens = TokenFile(f"{path}.tokens.arrow")
                size = BATCH * tokens.length
                fs, at = open_fs(f"{path}.docs.arrow")
                held, flat = -1, None
                with fs.open_input_file(at) as s:
                    docs = ipc.open_file(s)
                    for k in range(docs.num_record_batches):
                        d, crcs = docs.get_batch(k), []
                        for x, m in zip(d.column("at").to_pylist(), d.column("n").to_pylist(), strict=True):
                            crc, y = 0, x
                            while y < x + m:
                                if y // size != held:
                                    held = y // size
                                    flat = tokens.flat(held)
                                z = min(x + m, (held + 1) * size)
                                crc = zlib.crc32(flat[y - held * size : z - held * size].astype("<u4").tobytes(), crc)
                                y = z
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays([d.column("id"), pa.array(d.column("at").to_numpy() + base), d.column("n"), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    out = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    return files.mapInArrow(run, out)


def token_files(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``df`` as token files in the shared folder and returns, read from them, one row per document.

    An empty table writes no file and gives an empty result; an empty or null text is the end id alone.
    """
    spark: SparkSession = df.sparkSession
    manifest = write_tokens(df, tokenizer, end_id, shared_dir(spark), id_col, text_col)
    return read_documents(manifest, df.schema[id_col].dataType).withColumnRenamed("id", id_col)
