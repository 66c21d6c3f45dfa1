"""BPE encoding by tree concatenation, and decoding.

A long text is cut in halves until a piece has at most LEAF characters, wherever the cut falls. The
pieces are encoded in parallel, and neighbours are joined up the tree. At a join the tokens around
it may be wrong on both sides, so a window of text around the join is encoded again. It starts at a
token boundary p of the left side and is searched for a boundary q after the join that the right
side has too. When the window's token at p is the left side's token there, and its token at q is the
right side's, the left tokens before p, the window's from p to q and the right side's from q on are
the tokens of the joined text; otherwise the window grows.

Why that is exact: a sequence of BPE tokens is the encoding of its bytes when each neighbouring pair
of tokens is, and every pair of the result stands in an encoding of the left side, the window or the
right side. p and q are only taken where the split into words in front of BPE goes on alike on
both sides whatever stands before: between two letters, between two digits, between two marks, or
before white space that follows something else. If there is no such place, the window grows to the whole text,
which is then encoded as such. A special token's text is cut out first; pieces never cross it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import schema_of, tasks_for, text_bytes, texts

LEAF, WINDOW = 8192, 48
#: The words in front of byte-level BPE: a fixed pattern of this kind of tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = " \t\n\r\x0b\x0c"


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoding and decoding for a byte-level BPE vocabulary file, with the rules of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.dtype = "<u2" if self.bpe.n_vocab <= 1 << 16 else "<u4"
        self.sizes = np.zeros(self.bpe.n_vocab, np.int64)
        for t, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.sizes[i] = len(t)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text in which a special token's text is not looked for."""
        return np.array(self.bpe.encode_ordinary(text), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        raw = self.bpe.decode_bytes(ids.tolist())
        return raw.decode("utf-8", "replace").encode()

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """(text, None) between special tokens and ("", id) for them, in order; of tokens that begin at one place the longest counts."""
        out, at = [], 0
        for m in self.marks.finditer(text) if self.special else ():
            out += [(text[at : m.start()], None)] if m.start() > at else []
            out.append(("", self.special[m[0]]))
            at = m.end()
        return [*out, (text[at:], None)] if at < len(text) else out


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def halves(text: str, leaf: int = LEAF) -> list[str]:
    """The leaves of the tree, in order."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf) + halves(text[mid:], leaf)


def _goes_on(x: str, y: str) -> bool:
    """Whether the split into words from y on does not depend on what stands before x."""
    if y in SPACE:
        return not x.isspace()
    if y.isascii() and x.isascii():
        return x.isalpha() and y.isalpha() or x.isdigit() and y.isdigit() or x.isprintable() and y.isprintable() and not (x.isalnum() or y.isalnum() or x == " ") and y != "'"
    return x.isalpha() and y.isalpha()


class Piece:
    """Text with its ids."""

    def __init__(self, text: str, ids: np.ndarray):
        self.text, self.ids = text, ids


def _boundaries(code: Codec, text: str, ids: np.ndarray) -> dict[int, int]:
    """Character places that are token boundaries, as place: number of tokens before."""
    at_byte = np.concatenate([[0], np.cumsum(code.sizes[ids])])
    width = np.frombuffer(text.encode(), np.uint8)
    starts = np.flatnonzero((width & 0xC0) != 0x80)
    place = np.searchsorted(starts, at_byte)
    exact = (place < len(starts)) & (starts[np.minimum(place, len(starts) - 1)] == at_byte) | (at_byte == len(width))
    return {int(p) if b < len(width) else len(text): int(t) for t, (p, b, e) in enumerate(zip(place, at_byte, exact, strict=True)) if e}


def _tail(code: Codec, piece: Piece, chars: int) -> tuple[int, int]:
    """Place and token count of the last good boundary at least ``chars`` before the end; (0, 0) if none."""
    need, k = len(piece.text[-chars:].encode()) if chars < len(piece.text) else 1 << 62, 0
    sizes = code.sizes[piece.ids]
    back = np.cumsum(sizes[::-1])
    k = int(np.searchsorted(back, need))
    data = piece.text
    while k < len(back):
        t = len(sizes) - 1 - k
        suffix = int(back[k])
        try:  # a boundary inside a character has no place in the text
            tail = code.bpe.decode_bytes(piece.ids[t : t + 1].tolist())
        except KeyError:
            break
        if tail and (tail[0] & 0xC0) != 0x80:
            at = len(data) - _chars_back(data, suffix)
            if at == 0:
                return 0, 0
            if _goes_on(data[at - 1], data[at]):
                return at, t
        k += 1
    return 0, 0


def _chars_back(text: str, n_bytes: int) -> int:
    """How many characters at the end have n_bytes of UTF-8."""
    lo, hi = (n_bytes + 3) // 4, min(n_bytes, len(text))
    while lo < hi:
        mid = (lo + hi) // 2
        if len(text[len(text) - mid :].encode()) < n_bytes:
            lo = mid + 1
        else:
            hi = mid
    return lo


def join(code: Codec, a: Piece, b: Piece) -> Piece:
    """The piece of a's and b's text."""
    if not a.text or not b.text:
        return a if a.text else b
    text, grow = a.text + b.text, WINDOW
    while True:
        start, before = _tail(code, a, grow)
        head = b.text[:grow]
        if start == 0 and len(head) == len(b.text):
            return Piece(text, code.encode(text))
        middle = a.text[start:] + head
        ids = code.encode(middle)
        if start == 0 or ids[0] == a.ids[before]:
            joint = len(a.text) - start
            right = b.ids[: len(head) * 4 + 1]
            right = right[: int(np.searchsorted(np.cumsum(code.sizes[right]), len(head.encode()), "right"))]
            ours = _boundaries(code, middle, ids)
            theirs = _boundaries(code, head, right)
            for place, t in ours.items():
                r = theirs.get(place - joint)
                if place <= joint or r is None or t >= len(ids) or r >= len(right) or ids[t] != right[r]:
                    continue
                if _goes_on(middle[place - 1], middle[place]):
                    return Piece(text, np.concatenate([a.ids[:before], ids[:t], b.ids[r:]]))
        grow *= 2


def fold(code: Codec, pieces: list[Piece]) -> np.ndarray:
    """Ids of neighbouring pieces, joined in pairs up the tree."""
    while len(pieces) > 1:
        pieces = [join(code, *pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0].ids


def _result(ids: np.ndarray, decoded: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row: id_col, n_tokens, ids_sha256, decoded_sha256 (and with keep_ids ids array<int> and decoded string).

    A text of at most LEAF characters is a tree of one leaf and stays where it is read. Longer texts
    become rows of one leaf each, which are dealt over all tasks, encoded, and joined per text (whose
    pieces' texts are the decoded ids); they are told apart by their place in the input, so repeated rows and null ids stay apart.
    Null and empty texts have no ids. An empty table gives an empty result. Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > LEAF
    kind, kind_id = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], schema_of(rows, "id")
    if keep_ids:
        kind += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    out = T.StructType([kind_id, *kind])

    def pack(ids_col: pa.Array, all_ids: list[np.ndarray], code: Codec) -> pa.RecordBatch:
        decoded = [code.decode(x) for x in all_ids]
        n, a, b = zip(*map(_result, all_ids, decoded), strict=True) if all_ids else ((), (), ())
        cols = [ids_col, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        if keep_ids:
            cols += [pa.array([x.tolist() for x in all_ids], pa.list_(pa.int32())), pa.array([d.decode() for d in decoded], pa.string())]
        return pa.RecordBatch.from_arrays(cols, [f.name for f in out])

    def whole(code: Codec, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(code.encode(s) if i is None else np.array([i], np.uint32) for s, i in code.segments(text))])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary)
        for b in batches:
            yield pack(b.column("id"), [whole(code, t.decode()) for t in texts(b)], code)

    leaf = T.StructType([kind_id, T.StructField("doc", T.StringType()), T.StructField("segment", T.IntegerType()), T.StructField("leaf", T.IntegerType()), T.StructField("special", T.IntegerType()), T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, row = codec(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            for k, text in enumerate(texts(b)):
                pieces = [(s, n, i, x) for s, (t, i) in enumerate(code.segments(text.decode())) for n, x in enumerate(halves(t) if i is None else [""])]
                s, n, i, x = zip(*pieces, strict=True)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column("id").slice(k, 1)] * len(x)), pa.array([f"{part}-{row}"] * len(x)), *(pa.array(v, pa.int32()) for v in (s, n, i)), pa.array(x, pa.string())], [f.name for f in leaf])
                row += 1

    coded = T.StructType([*leaf.fields[:4], T.StructField("leaf_ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary)
        for b in batches:
            ids = [np.array([i]) if i is not None else code.encode(t.decode()) for t, i in zip(texts(b), b.column("special").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in coded.fields[:-1]), pa.array([x.astype(code.dtype).tobytes() for x in ids], pa.binary())], [f.name for f in coded])

    def joined(table: pa.Table) -> pa.Table:
        code = codec(vocabulary)
        table = table.sort_by([("segment", "ascending"), ("leaf", "ascending")])
        parts: dict[int, list[Piece]] = {}
        for s, raw in zip(table.column("segment").to_pylist(), table.column("leaf_ids").to_pylist(), strict=True):
            ids = np.frombuffer(raw, code.dtype).astype(np.uint32)
            parts.setdefault(s, []).append(Piece(code.decode(ids).decode(), ids))
        ids = np.concatenate([fold(code, p) for p in parts.values()])
        return pa.Table.from_batches([pack(table.column("id").combine_chunks().slice(0, 1) if table.column("id").num_chunks else table.column("id"), [ids], code)])

    n = tasks_for(rows, text_bytes(rows))
    leaves = rows.filter(long).mapInArrow(cut, leaf).repartition(n, "doc", "segment", "leaf").mapInArrow(encode, coded)
    both = rows.filter(~long).mapInArrow(short, out).unionByName(leaves.groupBy("doc").applyInArrow(joined, out))
    return both.withColumnRenamed("id", id_col)
