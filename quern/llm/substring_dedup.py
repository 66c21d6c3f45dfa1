"""Substring dedup: repeated windows of words, found with a count-min prefilter and an exact second pass.

A window is SIZE consecutive words of one document. Its anchor is the smallest hash of its runs of GRAM
words. Two copies of a window have the same runs, so the same smallest hash, at the same places in the window; copies
that start at different places therefore have it at different places of the corpus, and an anchor
occurs at least as often as any of its windows. So the count of its anchor overestimates a window, and leaving out
windows whose anchor occurs once loses none. Anchors are about one word in twelve, which is why they are counted in
the windows' stead.

First pass. A task packs its documents in units of UNIT_BYTES and fills a count-min sketch for each: DEPTH rows of cells, as
many as the bytes of all texts ask for, that tell none, one, or more. A unit's sketch is sent as its filled cells, in ranges whose
number grows with the corpus. A range adds the cells of all units' sketches, in one array of its own size, and tells each unit which of its cells
hold two or more. An anchor all of whose cells do is estimated to be repeated. So sketches are merged by cell, and no task holds more than a range.

Second pass. The windows with such an anchor get a 128-bit BLAKE2 digest. Digests go in blocks: a task sends each
distinct digest of a block once, with a mark if the block has it more than once, to the bucket of
its leading bits. A bucket, of which there are more the larger the corpus is, tells each block which of its
digests occur elsewhere, and the block's documents, kept beside with the places of their windows, are then cut. So
a passage in a third of all documents is one anchor per unit and one digest per block, and nothing lists pairs
of occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import ceil_div, partitions, schema_of, shared_dir, tasks_for, text_bytes, texts

SIZE, GRAM, DEPTH = 35, 12, 3
#: Cells of a sketch row for each anchor, and bytes of text for an anchor, about a dozen words; both bear only on how many windows are looked at in vain.
CELLS, ANCHOR_BYTES = 4, 72
#: Bytes of text of a unit (at most, and not above a quarter of a task's share), of a page of one, of a block, of a shard's share and of a bucket's share; windows of a block.
UNIT_BYTES, PAGE_BYTES, BLOCK_BYTES, SHARD_BYTES, BUCKET_BYTES, BLOCK = 32 << 20, 4 << 20, 8 << 20, 1 << 30, 64 << 20, 1_000_000
#: Ranges of a sketch row at least; their number follows the bytes alone, since each unit has a row for each range.
LEAST_RANGES = 4
#: How hard texts are packed; bytes of a digest beyond its leading eight.
LEVEL, REST = 7, 8
#: Words whose hash a worker remembers, and the bytes of such a word, at most.
MEMO, REMEMBERED = 1_000_000, 64
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= REMEMBERED:
            if len(self) > MEMO:
                self.clear()
            self[word] = h
        return h


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64."""
    out = []
    for base in (MULTIPLIER, INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _slide(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over each run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(words: list[bytes], hashes: WordHashes, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the hash at each place that is some window's anchor."""
    n, spread = len(words), size - gram + 1
    up, down = _powers(1 << max(12, (n + 1).bit_length()))
    v = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * up[:n])])
    g = _mix((s[gram:] - s[:-gram]) * down[: n - gram + 1])
    m = _slide(np.minimum, g, spread)
    edge = np.zeros(spread - 1, np.uint64)
    return m, g[_slide(np.maximum, np.concatenate([edge, m, edge]), spread) == g]


def _cells(h: np.ndarray, width: int, row: int) -> np.ndarray:
    """The cell of each hash in a row of a sketch; width is a power of two."""
    return _mix(h + np.uint64(MULTIPLIER * (row + 1) % (1 << 64))) & np.uint64(width - 1)


def sketch_width(n_bytes: int) -> int:
    """Cells of a sketch row, a power of two: CELLS for each anchor that so many bytes of text are thought to hold."""
    return 1 << max(10, (CELLS * n_bytes // ANCHOR_BYTES).bit_length())


def sketch(h: np.ndarray, times: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of a sketch of distinct hashes that occur so many times: its filled cells, ascending, and whether they hold more than one."""
    out = []
    for row in range(DEPTH):
        cells, of = np.unique(_cells(h, width, row), return_inverse=True)
        out.append((cells, np.bincount(of, weights=times, minlength=len(cells)) > 1))
    return out


def _in(cells: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which cells are among ascending known ones."""
    at = np.minimum(np.searchsorted(known, cells), max(0, len(known) - 1))
    return known[at] == cells if len(known) else np.zeros(len(cells), bool)


def _sha(words) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys of two numbers, and in it the first of each distinct key."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    s = keys[order]
    return order, np.r_[True, (s[1:] != s[:-1]).any(axis=1)] if len(s) else np.zeros(0, bool)


def _narrow(x: np.ndarray, width: int) -> bytes:
    """64-bit numbers below 256 ** width in so many bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widen(x: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def pack(h: np.ndarray) -> bytes:
    """Ascending 64-bit numbers: the first, the bytes that the largest step takes, and the steps in so many bytes."""
    if not len(h):
        return b""
    steps = np.diff(h)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return _narrow(h[:1], 8) + bytes([width]) + _narrow(steps, width)


def unpack(x: bytes) -> np.ndarray:
    """The numbers that ``pack`` has packed."""
    return np.cumsum(np.concatenate([_widen(x[:8], 8), _widen(x[9:], x[8])]), dtype=np.uint64) if x else np.zeros(0, np.uint64)


def _cut(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending 64-bit hashes: the numbers of the equal ranges that they fall in, and where each range starts, and the end."""
    part = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(h) else np.zeros(0, np.int64)
    return part[starts].astype(np.int32), np.r_[starts, len(h)]


def _by(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[str | int, list[dict]]]:
    """Rows in groups of one key, from batches sorted by it."""
    at, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if r[key] != at:
                if held:
                    yield at, held
                at, held = r[key], []
            held.append(r)
    if held:
        yield at, held


class Rows:
    """Makes record batches of one schema from columns; the columns that are not given are null."""

    def __init__(self, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)

    def __call__(self, n: int, **columns) -> pa.RecordBatch:
        one = lambda f: pa.nulls(n, f.type) if f.name not in columns else columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
        return pa.RecordBatch.from_arrays([one(f) for f in self.schema], schema=self.schema)


def _lists(arrays: list[pa.Array]) -> pa.Array:
    """One list column of one row."""
    flat = pa.concat_arrays(arrays)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=8 + REST).digest()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row: id_col, n_words, n_removed, kept_sha256.

    Words stand between ASCII white space and are taken unchanged. Each word in a window that also
    starts elsewhere is removed, in all copies, judged on the input. Null, empty and short texts have no
    window and lose nothing; repeated rows are copies of each other and lose their windows. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n_bytes = text_bytes(rows)
    n, shards, buckets = tasks_for(rows, n_bytes), max(LEAST_RANGES, ceil_div(n_bytes, SHARD_BYTES)), max(partitions(spark), ceil_div(n_bytes, BUCKET_BYTES))
    unit_bytes = min(UNIT_BYTES, ceil_div(n_bytes, 4 * n))
    width = sketch_width(n_bytes)
    span = ceil_div(width, shards)  # cells of a range
    kind_id = schema_of(rows, "id")
    field = lambda name, kind: T.StructField(name, kind)
    # kind 0: a document that is done; 1: a page of a unit, or a block, with its documents' ids and texts;
    # 2: a unit's cells (a) in one range of a sketch row, or a block's digests (a, b) in one bucket, with marks (c) for those that hold more than one
    state = T.StructType([
        field("of", T.StringType()), field("at", T.IntegerType()), *(field(c, T.BinaryType()) for c in "abc"), field("ids", T.ArrayType(kind_id.dataType)), field("sizes", T.ArrayType(T.IntegerType())),
        kind_id, field("n_words", T.LongType()), field("n_removed", T.LongType()), field("kept_sha256", T.StringType()), field("kind", T.IntegerType()),
    ])
    out, done_names = Rows(state), ["id", "n_words", "n_removed", "kept_sha256"]

    def done(ids: list[pa.Array], words: list[list[bytes]], kept: list | None = None) -> pa.RecordBatch:
        """Documents of which the words marked in ``kept`` stay, or all."""
        left = words if kept is None else [list(compress(w, k)) for w, k in zip(words, kept, strict=True)]
        return out(len(words), id=pa.concat_arrays(ids), n_words=[len(w) for w in words], n_removed=[len(w) - len(x) for w, x in zip(words, left, strict=True)], kept_sha256=[_sha(x) for x in left], kind=[0] * len(words))

    def parts(of: str, head: np.ndarray, rest: np.ndarray | None, more: np.ndarray, ranges: int) -> pa.RecordBatch:
        """Distinct keys, ascending by their leading 64 bits, as one row per range of these."""
        at, cuts = _cut(head, ranges)
        cut = lambda f: [f(slice(i, j)) for i, j in zip(cuts, cuts[1:], strict=False)]
        return out(len(at), of=[of] * len(at), at=at, a=cut(lambda x: pack(head[x])), b=cut(lambda x: None if rest is None else _narrow(rest[x], REST)), c=cut(lambda x: np.packbits(more[x]).tobytes()), kind=[2] * len(at))

    def marks(rows: list[dict], sizes: list[int]) -> np.ndarray:
        return np.concatenate([np.unpackbits(np.frombuffer(r["c"], np.uint8))[:m] for r, m in zip(rows, sizes, strict=True)])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, serial, squeeze = WordHashes(), TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=LEVEL).compress
        ids, packed, held, in_page, in_unit, page = [], [], [], 0, 0, 0

        def put_page() -> pa.RecordBatch:
            return out(1, of=[f"{part}-{serial}"], at=[page], a=[squeeze(b"\n".join(packed))], ids=_lists(ids), kind=[1])

        def put_sketch() -> Iterator[pa.RecordBatch]:
            for row, (cells, more) in enumerate(sketch(*np.unique(np.concatenate(held), return_counts=True), width)):
                starts = np.searchsorted(cells, np.arange(shards + 1, dtype=np.uint64) * np.uint64(span))
                full = np.flatnonzero(np.diff(starts))
                cut = [slice(starts[k], starts[k + 1]) for k in full]
                yield out(len(full), of=[f"{part}-{serial}"] * len(full), at=(row * shards + full).astype(np.int32), a=[pack(cells[x]) for x in cut], c=[np.packbits(more[x]).tobytes() for x in cut], kind=[2] * len(full))

        for b in batches:
            short, short_words = [], []
            for k, text in enumerate(texts(b)):
                w = text.split()
                if len(w) < size:
                    short.append(b.column("id").slice(k, 1))
                    short_words.append(w)
                    continue
                held.append(anchors(w, hashes, size)[1])
                ids.append(b.column("id").slice(k, 1))
                packed.append(b" ".join(w))
                in_page, in_unit = in_page + len(packed[-1]), in_unit + len(packed[-1])
                if in_page >= PAGE_BYTES or in_unit >= unit_bytes:
                    yield put_page()
                    ids, packed, in_page, page = [], [], 0, page + 1
                if in_unit >= unit_bytes:
                    yield from put_sketch()
                    held, in_unit, page, serial = [], 0, 0, serial + 1
            if short:
                yield done(short, short_words)
        if ids:
            yield put_page()
        if held:
            yield from put_sketch()

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, units in _by(batches, "at"):
            base, merged, held = np.uint64(at % shards * span), np.zeros(span, np.uint8), [unpack(u["a"]) for u in units]
            for u, cells in zip(units, held, strict=True):
                here = (cells - base).astype(np.int64)
                merged[here] = np.minimum(merged[here] + 1 + marks([u], [len(cells)]), 2)
            told = [pack(cells[merged[(cells - base).astype(np.int64)] > 1]) for cells in held]
            yield out(len(units), of=[u["of"] for u in units], at=[at] * len(units), a=told, kind=[0] * len(units))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, loosen, squeeze = WordHashes(), zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=LEVEL).compress
        part, unit, told_, flagged, serial, held, n_held, in_block = TaskContext.get().partitionId(), None, [], None, 0, [], 0, 0

        def block() -> Iterator[pa.RecordBatch]:
            name, raw = f"{part}-{serial}", np.frombuffer(b"".join(raw for *_, raw in held), np.uint8).reshape(-1, 8 + REST)
            keys = np.stack([_widen(raw[:, :8].tobytes(), 8), _widen(raw[:, 8:].tobytes(), REST)], axis=1)
            order, first = _order(keys)
            number = np.cumsum(first) - 1
            place = np.empty(len(keys), np.uint32)
            place[order] = number
            steps = np.concatenate([np.diff(pos, prepend=0) for _, _, pos, _ in held]).astype(np.uint32)
            yield out(1, of=[name], a=[squeeze(b"\n".join(t for _, t, *_ in held))], b=[squeeze(steps.tobytes() + place.tobytes())], ids=_lists([i for i, *_ in held]), sizes=[[len(pos) for _, _, pos, _ in held]], kind=[1])
            distinct = keys[order][first]
            yield parts(name, distinct[:, 0], distinct[:, 1], np.bincount(number) > 1, buckets)

        for b in batches:
            for r in range(len(b)):
                if unit != b.column("of")[r].as_py():
                    unit, told_, flagged = b.column("of")[r].as_py(), [[] for _ in range(DEPTH)], None
                if b.column("kind")[r].as_py() == 0:
                    told_[b.column("at")[r].as_py() // shards].append(b.column("a")[r].as_py())
                    continue
                if flagged is None:  # in ascending order, as rows come by range
                    flagged = [np.concatenate([np.zeros(0, np.uint64), *map(unpack, x)]) for x in told_]
                ids, clean, clean_words = b.column("ids")[r].values, [], []
                for k, text in enumerate(loosen(b.column("a")[r].as_py()).split(b"\n")):
                    w = text.split()
                    anchor, inverse = np.unique(anchors(w, hashes, size)[0], return_inverse=True)
                    again = np.logical_and.reduce([_in(_cells(anchor, width, row), f) for row, f in enumerate(flagged)])
                    pos = np.flatnonzero(again[inverse])
                    if not len(pos):
                        clean.append(ids.slice(k, 1))
                        clean_words.append(w)
                        continue
                    lengths = np.fromiter(map(len, w), np.int64, len(w))
                    ends = np.cumsum(lengths + 1) - 1
                    raw = b"".join([_digest(text[x:y]) for x, y in zip((ends - lengths)[pos].tolist(), ends[pos + size - 1].tolist(), strict=True)])
                    held.append((ids.slice(k, 1), text, pos, raw))
                    n_held, in_block = n_held + len(pos), in_block + len(text)
                    if n_held >= BLOCK or in_block >= BLOCK_BYTES:
                        yield from block()
                        serial, held, n_held, in_block = serial + 1, [], 0, 0
                if clean:
                    yield done(clean, clean_words)
        if held:
            yield from block()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blocks in _by(batches, "at"):
            held = [unpack(x["a"]) for x in blocks]
            sizes = [len(x) for x in held]
            keys = np.stack([np.concatenate(held), _widen(b"".join(x["b"] for x in blocks), REST)], axis=1)
            order, first = _order(keys)
            group = np.cumsum(first) - 1
            times = np.bincount(group, weights=1 + marks(blocks, sizes)[order])
            twice = np.empty(len(keys), np.uint8)
            twice[order] = (times > 1)[group]
            told = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum(sizes)[:-1])]
            yield out(len(blocks), of=[x["of"] for x in blocks], at=[bucket] * len(blocks), a=told, sizes=[[m] for m in sizes], kind=[0] * len(blocks))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen, name, flags = zstandard.ZstdDecompressor().decompress, None, []
        for b in batches:
            for r in range(len(b)):
                if name != b.column("of")[r].as_py():
                    name, flags = b.column("of")[r].as_py(), []
                if b.column("kind")[r].as_py() == 0:
                    flags.append(np.unpackbits(np.frombuffer(b.column("a")[r].as_py(), np.uint8))[: b.column("sizes")[r].as_py()[0]])
                    continue
                twice = np.concatenate(flags).astype(bool)
                steps, place = np.frombuffer(loosen(b.column("b")[r].as_py()), np.uint32).reshape(2, -1)
                words, kept, ids = [t.split() for t in loosen(b.column("a")[r].as_py()).split(b"\n")], [], b.column("ids")[r].values
                ends = np.cumsum(b.column("sizes")[r].as_py())
                for w, x, y in zip(words, [0, *ends], ends, strict=False):
                    pos = np.cumsum(steps[x:y], dtype=np.int64)[twice[place[x:y]]]
                    edges = np.zeros(len(w) + 1, np.int32)
                    edges[pos] += 1
                    edges[pos + size] -= 1
                    kept.append(np.cumsum(edges[:-1]) == 0)
                yield done([ids], words, kept)

    def saved(made: DataFrame) -> DataFrame:
        path = shared_dir(spark)
        made.write.partitionBy("kind").option("compression", "zstd").parquet(path)
        return spark.read.schema(state).parquet(path)

    def told(held: DataFrame, answering, ranges: int) -> DataFrame:
        """What the ranges' answers say to each unit or block, followed by its own rows."""
        replies = held.filter("kind = 2").select("of", "at", "a", "b", "c").repartition(min(ranges, n), "at").sortWithinPartitions("at", "of").mapInArrow(answering, state)
        return replies.unionByName(held.filter("kind = 1")).repartition(n, "of").sortWithinPartitions("of", "kind", "at")

    first = saved(rows.mapInArrow(store, state))
    second = saved(told(first, estimate, DEPTH * shards).mapInArrow(candidates, state))
    cut = told(second, answer, buckets).mapInArrow(finish, state)
    return first.filter("kind = 0").unionByName(second.filter("kind = 0")).unionByName(cut).select(F.col("id").alias(id_col), *done_names[1:])
