"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is cut wherever no piece of the vocabulary holds the two characters on both sides of the
cut: merges only make pieces, so none can cross it, and the parts ("words") are encoded by
themselves. The words that a task has not met before are encoded together, as one flat array of
symbols. A round finds each word's best-ranked neighbouring pair by a segmented minimum,
merges it in all words at once, and compacts the arrays; words without a pair left drop out, and
the rounds end when none is left.

Where a word holds its best pair several times, a round merges all of them from the left, as one after the
other would be, up to the first whose new symbol makes a pair that ranks as well or better: there the
round stops for this word, since that pair is due first. Pieces that share one score (runs of
spaces do) would stop at every merge; such a word is merged by one scan from the left instead. So the result is that of merging the
best pair, the leftmost of equal ones, again and again.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import schema_of, texts

#: The mark that stands for a space, the kinds of pieces in a model file, and what an unknown piece decodes to: fixed values of the format.
SPACE, NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE, UNKNOWN_TEXT = "▁", 1, 2, 3, 4, 5, 6, " ⁇ "
#: Characters that are cut and encoded at once; characters of the words that a task remembers, and of the longest of them.
GROUP, REMEMBERED, LONGEST = 1 << 20, 1 << 22, 64
NONE = np.iinfo(np.int32).max


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message; values of fixed width and of messages as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + n]
        at += n


class Codec:
    """Encoding and decoding with a SentencePiece BPE model file whose texts are not normalised."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        trainer, norm = ({k: v for n, b in parts if n == part for k, v in fields(b)} for part in (2, 3))
        if trainer.get(3) != 2 or trainer.get(24) or norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError(f"{path}: only BPE models with the identity normaliser that keep all spaces can be read")
        self.prefix = SPACE if norm.get(3, 1) else ""
        rows = [dict(fields(b)) for n, b in parts if n == 1]
        self.pieces = [r.get(1, b"").decode() for r in rows]
        kinds = [r.get(3, NORMAL) for r in rows]
        if set(kinds) & {USER, UNUSED}:
            raise ValueError(f"{path}: models with user-defined or unused pieces can't be read")
        self.bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.controls = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.shown = [UNKNOWN_TEXT.encode() if k == UNKNOWN else b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.opens = [k == NORMAL and p.startswith(SPACE) for p, k in zip(self.pieces, kinds, strict=True)]
        self.digits = [str(i).encode() for i in range(len(rows))]
        self._tables({p: (i, -struct.unpack("<f", r.get(2, b"\0\0\0\0"))[0]) for i, (p, k, r) in enumerate(zip(self.pieces, kinds, rows, strict=True)) if k == NORMAL})
        self._forget()

    def _tables(self, normal: dict[str, tuple[int, float]]) -> None:
        """Symbols are pieces by their id, then characters that are in pieces but none themselves; ranks are those of the scores."""
        chars = sorted({c for p in normal for c in p})
        spare = [c for c in chars if c not in normal]
        symbol = {p: i for p, (i, _) in normal.items()} | {c: len(self.pieces) + k for k, c in enumerate(spare)}
        self.n_symbols = len(self.pieces) + len(spare)
        self.spare = {len(self.pieces) + k: c for k, c in enumerate(spare)}
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbol_of[[ord(c) for c in chars]] = [symbol[c] for c in chars]
        place = {c: k + 1 for k, c in enumerate(chars)}
        self.place_of = np.zeros(0x110000, np.int32)
        self.place_of[[ord(c) for c in chars]] = range(1, len(chars) + 1)
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        ranks, of = np.unique([s for _, s in normal.values()], return_inverse=True)
        self.tied = np.bincount(of, minlength=len(ranks)) > 1
        pairs = {}
        for (p, (i, _)), r in zip(normal.items(), of.tolist(), strict=True):
            for a, b in zip(p, p[1:]):
                self.together[place[a], place[b]] = True
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.n_symbols + b] = (i, r)
        keys = sorted(pairs)
        self.pair_keys = np.array([*keys, NONE * (NONE + 1)], np.int64)
        self.pair_symbol = np.array([*(pairs[k][0] for k in keys), -1], np.int32)
        self.pair_rank = np.array([*(pairs[k][1] for k in keys), NONE], np.int32)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_chars, self.offsets, self.sizes, self.pool = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged symbol, rank) of pairs of symbols; rank NONE where the pair is no piece. A symbol below zero pairs with none."""
        key = a.astype(np.int64) * self.n_symbols + b
        at = np.searchsorted(self.pair_keys, key)
        hit = (self.pair_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_symbol[at], -1), np.where(hit, self.pair_rank[at], NONE)

    def scan(self, symbols: list[int], rank: int) -> list[int]:
        """Merges pairs of one rank from the left, new pairs of that rank included, until one that ranks better turns up."""
        lookup = lambda a, b: tuple(int(x[0]) for x in self.pairs(np.array([a]), np.array([b])))
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        done: list[int] = []
        for k, s in enumerate(symbols):
            done.append(s)
            while len(done) > 1:
                pair = (done[-2], done[-1])
                merged, r = seen.get(pair) or seen.setdefault(pair, lookup(*pair))
                if r != rank:
                    break
                done[-2:] = [merged]
                right = (merged, symbols[k + 1]) if k + 1 < len(symbols) else None
                around = [p for p in ((done[-2], merged) if len(done) > 1 else None, right) if p]
                if any((seen.get(p) or seen.setdefault(p, lookup(*p)))[1] < rank for p in around):
                    return done + symbols[k + 1 :]
        return done

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, word of each, in order of the rounds in which the words were done; their words) after all merges of words laid end to end."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        last = np.append(word[1:] != word[:-1], True)
        after = np.append(symbols[1:], -1)
        _, rank = self.pairs(symbols, np.where(last, -1, after))
        out_symbols, out_word = [], []
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            n = np.diff(np.append(first, len(symbols)))
            least = np.minimum.reduceat(rank, first)
            open_ = np.repeat(least < NONE, n)
            if not open_.all():
                out_symbols.append(symbols[~open_])
                out_word.append(word[~open_])
                symbols, word, rank = symbols[open_], word[open_], rank[open_]
                continue
            symbols, word, rank = self._round(symbols, word, rank, np.repeat(least, n), first)
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *out_symbols]), np.concatenate([empty, *out_word])

    def _round(self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, least: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One round over words that all have a pair."""
        place = np.arange(len(symbols))
        best = rank == least
        begins = best & ~np.append(False, best[:-1])
        run = np.maximum.accumulate(np.where(begins, place, 0))
        chosen = np.flatnonzero(best & ((place - run) % 2 == 0))
        merged, _ = self.pairs(symbols[chosen], symbols[chosen + 1])
        # the neighbours as they are when all earlier merges of the round are done
        new = symbols.copy()
        new[chosen] = merged
        absorbed = np.zeros(len(symbols) + 1, bool)
        absorbed[chosen + 1] = True
        back = chosen - 1 - absorbed[np.maximum(chosen - 1, 0)]
        left = np.where((chosen > 0) & (word[np.maximum(back, 0)] == word[chosen]), new[np.maximum(back, 0)], -1)
        far = np.minimum(chosen + 2, len(symbols) - 1)
        right = np.where((chosen + 2 < len(symbols)) & (word[far] == word[chosen]), symbols[far], -1)
        stops = np.minimum(self.pairs(left, merged)[1], self.pairs(merged, right)[1]) <= least[chosen]
        tied: dict[int, list[int]] = {}
        if stops.any():
            limit = np.full(len(symbols), len(symbols))
            np.minimum.at(limit, np.searchsorted(first, chosen[stops], "right") - 1, chosen[stops])
            of = np.searchsorted(first, chosen, "right") - 1
            ends = np.append(first[1:], len(symbols))
            for w in np.unique(of[stops & self.tied[least[chosen]]]).tolist():
                tied[w] = self.scan(symbols[first[w] : ends[w]].tolist(), int(least[first[w]]))
            keep = chosen <= limit[of]
            for w in tied:
                keep &= of != w
            chosen, merged = chosen[keep], merged[keep]
        gone = np.zeros(len(symbols), bool)
        gone[chosen + 1] = True
        touched = np.zeros(len(symbols), bool)
        touched[chosen] = True
        new = symbols.copy()
        new[chosen] = merged
        for w, done in tied.items():
            at = first[w]
            new[at : at + len(done)] = done
            gone[at + len(done) : ends[w]] = True
            touched[at : at + len(done)] = True
        new, word, rank, touched = new[~gone], word[~gone], rank[~gone], touched[~gone]
        again = np.flatnonzero(touched | np.append(touched[1:], False))
        again_right = np.minimum(again + 1, len(new) - 1)
        same = (again + 1 < len(new)) & (word[again_right] == word[again])
        rank[again] = self.pairs(new[again], np.where(same, new[again_right], -1))[1]
        return new, word, rank

    def _learn(self, words: list[str]) -> None:
        """Encodes words that are not known."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols, word = self.merge(self.symbol_of[flat], np.array([len(w) for w in words]))
        odd = (symbols < 0) | (symbols >= len(self.pieces))
        if odd.any():  # a character without a piece is written as bytes; where none is among the pieces, as one unknown
            starts = np.cumsum([0, *(len(w) for w in words)])
            spelled = [[s] if 0 <= s < len(self.pieces) else self._spell(self.spare[s] if s >= 0 else chr(flat[starts[w]])) for s, w in zip(symbols.tolist(), word.tolist(), strict=True)]
            word = np.repeat(word, [len(x) for x in spelled])
            symbols = np.array([i for x in spelled for i in x])
        order = np.argsort(word, kind="stable")
        sizes = np.bincount(word, minlength=len(words))
        self.offsets = np.append(self.offsets, len(self.pool) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.pool = np.append(self.pool, symbols[order].astype(np.int32))

    def _spell(self, char: str) -> list[int]:
        return [self.bytes_at[b] for b in char.encode("utf-8", "surrogatepass")] if len(self.bytes_at) == 256 else [self.unknown]

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        group: list[str] = []
        chars = 0
        for text in batch:
            if chars and chars + len(text) > GROUP:
                out += self._encode(group)
                group, chars = [], 0
            if len(text) > GROUP:
                out.append(self._encode_long(text))
            else:
                group.append(text)
                chars += len(text)
        return out + (self._encode(group) if group else [])

    def _encode_long(self, text: str) -> np.ndarray:
        """A text longer than GROUP, in slices that end where a word does; a word beyond a slice makes it longer."""
        parts, text = [], self._marked(text)
        start, size = 0, GROUP
        while start < len(text):
            part = text[start : start + size]
            cuts = self._cuts(part)
            if start + size < len(text) and len(cuts) == 1:
                size *= 2
                continue
            end = len(part) if start + size >= len(text) else int(cuts[-1])
            parts += self._encode([part[:end]], marked=True)
            start, size = start + end, GROUP
        return np.concatenate(parts)

    def _marked(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def _cuts(self, text: str) -> np.ndarray:
        """Places where words begin."""
        place = self.place_of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        return np.append(0, np.flatnonzero(~self.together[place[:-1], place[1:]]) + 1) if len(text) else np.zeros(0, np.int64)

    def _encode(self, group: list[str], marked: bool = False) -> list[np.ndarray]:
        if self.known_chars > REMEMBERED:
            self._forget()
        group = group if marked else [self._marked(t) for t in group]
        joined = "".join(group)
        ends = np.cumsum([len(t) for t in group])
        cuts = np.union1d(self._cuts(joined), ends[ends < len(joined)]) if joined else np.zeros(0, np.int64)
        places = [*cuts.tolist(), len(joined)]
        words = [joined[a:b] for a, b in zip(places, places[1:])]
        known, fresh, base = self.known, [], len(self.sizes)
        long: dict[str, int] = {}
        numbers = []
        for w in words:
            k = known.get(w, -1)
            if k < 0:
                k = long.get(w, -1) if len(w) > LONGEST else -1
                if k < 0:
                    k = base + len(fresh)
                    fresh.append(w)
                    (long if len(w) > LONGEST else known)[w] = k
            numbers.append(k)
        if fresh:
            self.known_chars += sum(map(len, fresh))
            self._learn(fresh)
        at = np.array(numbers, np.int64)
        sizes, offsets = self.sizes[at], self.offsets[at]
        total = np.cumsum(sizes)
        from_ = np.repeat(offsets - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)
        ids = self.pool[from_]
        until = np.append(0, total)[np.searchsorted(cuts, ends)]
        return np.split(ids, until[:-1]) if group else []

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text: pieces end to end, without the space that was put in front; bytes that are no UTF-8 become U+FFFD each, and a control id ends a run of bytes."""
        shown = list(map(self.shown.__getitem__, ids))
        if self.prefix:
            first = next((k for k, x in enumerate(shown) if x), None)
            if first is not None and self.opens[ids[first]]:
                shown[first] = shown[first][1:]
        breaks = [k for k, i in enumerate(ids) if i in self.controls] if not self.controls.isdisjoint(ids) else []
        return b"".join(b"".join(shown[a:b]).decode("utf-8", "each_byte").encode() for a, b in zip([0, *breaks], [*breaks, len(ids)]))


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each_byte", _each_byte)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row: id_col, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (and with keep_ids ids array<int> and decoded string).

    Each row is encoded where it is read, in Arrow batches, so nothing is shuffled and a lost task only repeats its own rows; a text of
    more than GROUP characters is taken in slices. Null and empty texts have no ids; null and
    repeated ids and repeated rows stay rows of their own; an empty table gives an empty result.
    Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = [schema_of(rows, "id"), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        kind += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    out = T.StructType(kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for b in batches:
            ids = [x.tolist() for x in code.encode_batch([t.decode("utf-8", "replace") for t in texts(b)])]
            decoded = [code.decode(x) for x in ids]
            hashed = [hashlib.sha256(b",".join(map(code.digits.__getitem__, x))).hexdigest() for x in ids]
            cols = [b.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(hashed, pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())]
            if keep_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array([d.decode() for d in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in out])

    return rows.mapInArrow(encode, out).withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, model: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of each list of ids in ``name`` (a column of that name is replaced); a null list gives null, and a null or unknown id in it an error."""
    out = T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for b in batches:
            text = [None if x is None else code.decode(x).decode() for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in out.fields[:-1]), pa.array(text, pa.string())], [f.name for f in out])

    return df.mapInArrow(decode, out)
