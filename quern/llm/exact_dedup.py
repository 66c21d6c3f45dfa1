"""Exact dedup with a minimal perfect hash over historical distinct digests.

History is the set of distinct text digests seen so far, each with the row that won it. It is cut
into shards of a bounded number of digests; each shard becomes one row that holds a minimal perfect
hash (levels of bit arrays, ranked by population count) and, per slot, the full 32-byte digest, the
winner's locator and the count. A lookup computes the slot and compares all 32 bytes, so a digest
that is not in history can never be taken for one that is. Members are repeats of the winner;
nonmembers are grouped among themselves.

Without an earlier history a table is taken in two parts: one part's digests are the history in which the other
part is looked up. Members and nonmembers are counted apart, the winners are brought up to date, and all rows
find their winner in the history of the whole table.

Rows reach a shard as (id, digest) only, never as texts. A shard with many rows (a hot text) is
dealt over several salts, each of which gets a copy of the shard's hash; rows stream through a task,
so a hot text needs no memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import LOWER, UPPER, ceil_div, join_counted, partitions, schema_of, written

#: Distinct digests of a shard's hash, on average: at most, and as many as make a shard worth a task; rows of a shard that one task looks up.
SHARD_DIGESTS, LEAST_DIGESTS, SALT_ROWS = 65_536, 256, 65_536
DIGEST = 32


def text_digest(col):
    """SHA-256 (binary) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER).cast("binary"), 256))


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit mix of h for one level (fixed multipliers of the splitmix64 finaliser)."""
    z = h + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests: a key's slot is the rank of its bit."""

    def __init__(self, sizes: list[int], bits: bytes, digests: bytes):
        self.sizes = [int(x) for x in sizes]
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8))[: sum(self.sizes)].astype(bool)
        self.rank = np.cumsum(self.bits) - 1
        self.digests = np.frombuffer(digests, f"V{DIGEST}")

    @staticmethod
    def _heads(keys: np.ndarray) -> np.ndarray:
        words = keys.view(np.uint64).reshape(-1, 4)
        return words[:, 0] ^ words[:, 2] << np.uint64(1)

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
        """Level sizes, packed bits, and the slot of each key; keys are distinct."""
        left, heads, sizes, levels = np.arange(len(keys)), cls._heads(keys), [], []
        place = np.zeros(len(keys), np.int64)
        while len(left):
            if len(sizes) >= 64:
                raise ValueError("digests whose first and third words agree can't be told apart")
            size = max(8, int(1.6 * len(left)))
            at = (_mix(heads[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            place[left[alone[at]]] = sum(sizes) + at[alone[at]]
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        return sizes, np.packbits(bits).tobytes(), (np.cumsum(bits) - 1)[place] if len(keys) else place

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key whose 32 bytes the slot holds; -1 for nonmembers."""
        heads, slot, base, left = self._heads(keys), np.full(len(keys), -1), 0, np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = base + (_mix(heads[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            slot[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        same = np.zeros(len(keys), bool)
        found = slot >= 0
        same[found] = self.digests[slot[found]] == keys[found]
        return np.where(same, slot, -1)


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), f"V{DIGEST}")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard from distinct (digest, keep, n): shard, sizes, bits, digests, keeps, counts."""
    keep = history.schema["keep"].dataType
    out = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType()),
        T.StructField("digests", T.BinaryType()), T.StructField("keeps", T.ArrayType(keep)), T.StructField("counts", T.ArrayType(T.LongType())),
    ])

    def make(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = _keys(table.column("digest"))
        sizes, bits, slots = PerfectHash.build(keys)
        order = np.argsort(slots)
        rest = {"keeps": table.column("keep").take(pa.array(order)).to_pylist(), "counts": table.column("n").take(pa.array(order)).to_pylist()}
        return pa.table({"shard": [table.column("shard")[0].as_py()], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": [bits], "digests": [keys[order].tobytes()], "keeps": pa.array([rest["keeps"]], pa.list_(table.column("keep").type)), "counts": pa.array([rest["counts"]], pa.list_(pa.int64()))})

    return history.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards))).groupBy("shard").applyInArrow(make, out)


def shards_for(history: DataFrame) -> int:
    """Shards of a history: small enough for a task, and as many as there are tasks where that leaves them LEAST_DIGESTS."""
    n = history.count()
    return max(ceil_div(n, SHARD_DIGESTS), min(partitions(history.sparkSession), ceil_div(n, LEAST_DIGESTS)))


def lookup(rows: DataFrame, history: DataFrame) -> DataFrame:
    """(id, digest) of rows (place, id, digest) with keep and n of the slot that holds the digest; null for nonmembers."""
    shards = shards_for(history)
    index = build_index(history, shards)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    salts = rows.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(SALT_ROWS)).cast("int").alias("salts"))
    parts = ["sizes", "bits", "digests", "keeps", "counts"]
    dealt = rows.join(salts, "shard").select("shard", F.pmod(F.xxhash64("place"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "digest", *(F.lit(None).cast(index.schema[c].dataType).alias(c) for c in parts))
    hashes = index.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(None).cast("binary").alias("digest"), *parts)
    out = T.StructType([schema_of(rows, "id"), schema_of(rows, "digest"), T.StructField("keep", index.schema["keeps"].dataType.elementType), T.StructField("n", T.LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held = keeps = counts = None
        for batch in batches:
            kinds, shard_of = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
            starts = np.flatnonzero(np.r_[True, (kinds[1:] == 0) | (shard_of[1:] != shard_of[:-1])]) if len(kinds) else []
            for a, b in zip(starts, [*starts[1:], len(kinds)], strict=True):
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    head = part.slice(0, 1)
                    shard, held = shard_of[a], PerfectHash(head.column("sizes")[0].as_py(), head.column("bits")[0].as_py(), head.column("digests")[0].as_py())
                    keeps, counts = head.column("keeps")[0].values, head.column("counts")[0].values
                    part = part.slice(1)
                if not len(part):
                    continue
                slots = held.find(_keys(part.column("digest"))) if shard == shard_of[a] else np.full(len(part), -1)
                at = pa.array(slots, mask=slots < 0)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), *((x.take(at) for x in (keeps, counts)) if keeps is not None else (pa.nulls(len(part), f) for f in (part.column("keeps").type.value_type, pa.int64())))], ["id", "digest", "keep", "n"])

    both = dealt.unionByName(hashes).repartition(partitions(rows.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return both.mapInArrow(find, out)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    history: distinct (digest binary, keep, n) of earlier tables, as ``distinct_digests`` makes; its
    members are repeats (not kept) and the others are grouped separately. By default half of ``df``'s
    rows, by the hash of their place, are the history of the other half, whose members may win over the history's
    rows, so that each group keeps its row with the largest id.

    Null and empty texts are equal. Of rows with one text the largest id stays; rows that repeat
    both id and text count in group_size and are marked alike (``drop_repeats`` leaves one). A null
    id loses to any other; a group with null ids only has keep_id null and each row kept. An empty
    table gives an empty result. Other columns are not read, so their names can't clash.
    """
    rows = written(df.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")))
    if history is None:
        past = F.pmod(F.xxhash64("place"), F.lit(2)) == 0
        updated = written(update_history(written(distinct_digests(rows.filter(past))), rows.filter(~past)))
        marked = lookup(rows, updated).withColumn("open", F.lit(True))
    else:
        found = written(lookup(rows, written(history.select("digest", "keep", "n"))))
        new = found.filter(F.col("n").isNull()).select("id", "digest")
        own = join_counted(new, written(distinct_digests(new)), ["digest"], "n").select("id", "digest", "keep", "n")
        marked = found.filter(F.col("n").isNotNull()).withColumn("open", F.lit(False)).unionByName(own.withColumn("open", F.lit(True)))
    return marked.select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("open") & F.col("id").eqNullSafe(F.col("keep"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_digests(rows: DataFrame) -> DataFrame:
    """History of (id, digest) rows: digest, keep (largest id), n; counted before the shuffle."""
    return rows.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("n"))


def update_history(history: DataFrame, rows: DataFrame) -> DataFrame:
    """``history`` with the rows (place, id, digest) that come after it: members add to their slot's winner and count, nonmembers are grouped separately."""
    found = written(lookup(rows, history))
    member = F.col("n").isNotNull()
    more = distinct_digests(found.filter(member).select("id", "digest")).select("digest", F.col("keep").alias("later"), F.col("n").alias("times"))
    held = history.join(more, "digest", "left").select("digest", F.greatest("keep", "later").alias("keep"), (F.col("n") + F.coalesce("times", F.lit(0))).alias("n"))
    return held.unionByName(distinct_digests(found.filter(~member).select("id", "digest")))


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, whatever their names.

    Of rows that repeat an id and, but for the case of A-Z, a text, the one whose JSON is the greatest stays, so one of
    them that does not depend on their order. Rows without any id stay as one per text.
    """
    kept = written(exact_dedup(df, id_col, text_col).filter("kept").groupBy(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("digest")).agg(F.count("*").alias("n")))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("row_id"), text_digest(F.col(text_col)).alias("row_digest"))
    same = (F.col("row_digest") == F.col("digest")) & F.col("row_id").eqNullSafe(F.col("id"))
    stay = rows.join(kept.filter("n = 1"), same, "left_semi").select("row")
    if not kept.filter("n > 1").isEmpty():
        several = rows.join(kept.filter("n > 1"), same).groupBy("id", "digest").agg(F.max_by("row", F.to_json("row")).alias("row"))
        stay = stay.unionByName(several.select("row"))
    return stay.select("row.*")
