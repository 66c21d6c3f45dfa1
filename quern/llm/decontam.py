"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments. A segment covers some documents of one Arrow batch, of a bounded
number of bytes where no single text is larger: their ids and word counts, and for each indexed term its
postings, the sorted (document, position) pairs. Segments are split by document, as a search engine's
are, so a phrase is intersected inside one segment, no postings are shuffled, and a word that every
document holds fills no single task. Only terms of the asked passages are stored, since no others can
take part in a match.

A passage is cut into windows, which are listed under their rarest term in the whole index. A segment
looks at the windows of its own terms only. For each of these the rarest term's list, less its offset in the
window, gives the possible starts, and each further list, from the next rarest term on and less its own
offset, is intersected with what is left. With slop 0 the result is the exact phrases; with slop s a start
is a match where each term of the window lies in the document up to s words from its place (proximity).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import ceil_div, schema_of, texts, written

WINDOW, SLOP = 13, 2
#: Bytes of passages that are asked at once (larger benchmarks go in blocks), and of texts in a segment.
BLOCK_BYTES, SEGMENT_BYTES = 16 << 20, 16 << 20
#: Words: what is left of lower-cased text without the ASCII characters other than letters and digits.
TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def build_index(df: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments: ids, n_words, terms (numbers in ``terms``), freqs, postings (sorted 64-bit document << 32 | position, by term)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    number = {t: i for i, t in enumerate(terms)}

    def segment(ids: pa.Array, docs: list[bytes]) -> pa.RecordBatch:
        get, counts, term, post = number.get, [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for d, text in enumerate(docs):
            w = words(text)
            counts.append(len(w))
            t = np.fromiter((get(x, -1) for x in w), np.int32, len(w))
            at = np.flatnonzero(t >= 0)
            term.append(t[at])
            post.append(at + (d << 32))
        term, post = np.concatenate(term), np.concatenate(post)
        order = np.argsort(term, kind="stable")
        has, n = np.unique(term, return_counts=True)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([one(ids), one(pa.array(counts, pa.int32())), one(pa.array(has.astype(np.int32))), one(pa.array(n.astype(np.int32))), pa.array([post[order].astype("<i8").tobytes()], pa.binary())], ["ids", "n_words", "terms", "freqs", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = texts(b)
            part = np.cumsum([len(t) for t in docs]) // SEGMENT_BYTES
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(docs)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                yield segment(b.column("id").slice(x, y - x), docs[x:y])

    ints = T.ArrayType(T.IntegerType())
    out = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("n_words", ints), T.StructField("terms", ints), T.StructField("freqs", ints), T.StructField("postings", T.BinaryType())])
    return rows.mapInArrow(run, out)


class Segment:
    """Postings of a segment by term number."""

    def __init__(self, terms: np.ndarray, freqs: np.ndarray, postings: bytes):
        ends = np.cumsum(freqs)
        keys = np.frombuffer(postings, "<i8")
        self.lists = {int(t): keys[e - n : e] for t, n, e in zip(terms, freqs, ends, strict=True)}

    def starts(self, window: list[tuple[int, int]], slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Where the window, (term, offset) from the rarest term on, occurs: documents, and document << 32 plus position.

        The document is that of the rarest term's place. With slop a start may lie before it or near its end.
        """
        term, offset = window[0]
        keys = self.lists[term]
        left = (keys[:, None] - offset + np.arange(-slop, slop + 1)).ravel()
        doc = np.repeat(keys >> 32, 2 * slop + 1)
        for term, offset in window[1:]:
            if not len(left):
                break
            keys = self.lists[term]
            at = np.searchsorted(keys, np.maximum(left + (offset - slop), doc << 32))
            near = keys[np.minimum(at, len(keys) - 1)]
            stay = (at < len(keys)) & (near <= left + (offset + slop)) & (near >> 32 == doc)
            left, doc = left[stay], doc[stay]
        return doc, left


class Windows:
    """The windows of asked passages, as places in one array of their term numbers, listed by their rarest term."""

    def __init__(self, asked: list[list[int]], rank: np.ndarray, size: int = WINDOW):
        """asked: each passage's term numbers; rank: place of each term by frequency in the whole index, the rarest first."""
        self.terms = np.array([t for p in asked for t in p], np.int32)
        base, starts, lengths, items, rarest = 0, [], [], [], []
        for i, p in enumerate(asked):
            if p:
                n, m = min(size, len(p)), max(1, len(p) - size + 1)
                runs = np.lib.stride_tricks.sliding_window_view(np.array(p, np.int32), n)
                rarest.append(runs[np.arange(m), rank[runs].argmin(axis=1)])
                starts.append(base + np.arange(m))
                lengths.append(np.full(m, n))
                items.append(np.full(m, i))
            base += len(p)
        flat = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
        rarest = flat(rarest)
        order = np.argsort(rarest, kind="stable")
        self.start, self.length, self.item, self.rank = flat(starts)[order], flat(lengths)[order], flat(items)[order], rank
        self.of_term = np.searchsorted(rarest[order], np.arange(len(rank) + 1))

    def of(self, term: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item, terms) of the windows whose rarest term this is."""
        for k in range(self.of_term[term], self.of_term[term + 1]):
            yield int(self.item[k]), self.terms[self.start[k] : self.start[k] + self.length[k]]

    def by_rank(self, window: np.ndarray) -> list[tuple[int, int]]:
        """(term, offset) of a window, the rarest term first."""
        return [(int(window[o]), int(o)) for o in np.argsort(self.rank[window], kind="stable")]


def matches(index: DataFrame, items: list[str], windows: Windows, slop: int = 0) -> DataFrame:
    """Per document: id, n_words, spans (start, end; merged, of exact phrases), items and near_items (ids, sorted as strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                ids, counts = b.column("ids")[r].values, b.column("n_words")[r].values
                terms = b.column("terms")[r].values.to_numpy()
                seg = Segment(terms, b.column("freqs")[r].values.to_numpy(), b.column("postings")[r].as_py())
                held = np.zeros(len(windows.rank), bool)
                held[terms] = True
                spans, found, near = ([{} for _ in range(3)])
                for term in terms.tolist():
                    for item, window in windows.of(term):
                        if not held[window].all():
                            continue
                        by_rank = windows.by_rank(window)
                        if slop:
                            docs, _ = seg.starts(by_rank, slop)
                            for d in np.unique(docs).tolist():
                                near.setdefault(d, set()).add(items[item])
                            if not len(docs):
                                continue
                        docs, starts = seg.starts(by_rank)
                        for d, s in zip(docs.tolist(), (starts & 0xFFFFFFFF).tolist(), strict=True):
                            spans.setdefault(d, []).append((s, s + len(window)))
                            found.setdefault(d, set()).add(items[item])
                n = len(ids)
                yield pa.RecordBatch.from_arrays([
                    ids, counts, pa.array([merge_spans(spans.get(d, [])) for d in range(n)], pa.list_(pa.list_(pa.int32()))),
                    *(pa.array([sorted(x.get(d, ())) for d in range(n)], pa.list_(pa.string())) for x in (found, near)),
                ], ["id", "n_words", "spans", "items", "near_items"])

    names = T.ArrayType(T.StringType())
    out = T.StructType([T.StructField("id", index.schema["ids"].dataType.elementType), T.StructField("n_words", T.IntegerType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", names), T.StructField("near_items", names)])
    return index.mapInArrow(run, out)


def merge_spans(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slop: int = SLOP) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, n_items, items, items_sha256, contaminated, spans, n_near_items.

    A word is hit inside any exact occurrence of a window; contaminated: some word is hit and at
    least one in twenty is. Null and wordless documents have no words and no hits; passages without
    words ask for nothing; a passage that is repeated under one id counts once, repeated documents are each judged alone; item ids are
    compared as strings, and a null item id is the string "null". An empty benchmark leaves every
    document clean; an empty table gives an empty result. Other columns are not read.

    The benchmark is the stated query set. It goes to the executors in blocks of about BLOCK_BYTES
    of different passages, each answered in one pass over the index of its terms. With several blocks the rows
    are first written with a key, by which the blocks' results are grouped. n_near_items counts the items of
    which some window has all its words in the document up to ``slop`` words from their places.
    """
    q = written(benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).cast("string").alias("text")).distinct())
    blocks = ceil_div(q.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BLOCK_BYTES)
    rows, parts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), []
    if blocks > 1:  # each row's key is written once, since no other order or number of rows holds from block to block
        rows = written(rows.select(F.struct(F.monotonically_increasing_id().alias("row"), "id").alias("id"), "text"))
    for k in range(blocks):
        asked = [(r.item, words((r.text or "").encode())) for r in q.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toLocalIterator()]
        if k and not asked:
            continue
        terms = sorted({t for _, w in asked for t in w})
        index = written(build_index(rows, terms, "id", "text"))
        freq = np.zeros(len(terms), np.int64)
        for r in index.select(F.explode(F.arrays_zip("terms", "freqs")).alias("p")).groupBy("p.terms").agg(F.sum("p.freqs").alias("n")).toLocalIterator():
            freq[r.terms] = r.n
        rank = np.argsort(np.argsort(freq, kind="stable"))
        number = {t: i for i, t in enumerate(terms)}
        part = matches(index, [i for i, _ in asked], Windows([[number[t] for t in w] for _, w in asked], rank), slop)
        parts.append(written(part.filter((F.size("spans") > 0) | (F.size("near_items") > 0) | F.lit(k == 0))) if blocks > 1 else part)
    found = parts[0] if blocks == 1 else _union(parts)
    found = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0]))
    return found.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans", F.size("near_items").cast("long").alias("n_near_items"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    """Results of several blocks, whose ids are (row, id), as one row per document row; the first block has all rows."""
    both = functools.reduce(DataFrame.unionAll, parts)
    one = lambda c: F.flatten(F.collect_list(c))
    found = both.groupBy("id.row").agg(F.first("id.id").alias("id"), F.first("n_words").alias("n_words"), one("spans").alias("spans"), *(F.array_sort(F.array_distinct(one(c))).alias(c) for c in ("items", "near_items")))
    return found.select("id", "n_words", _merged("spans").alias("spans"), "items", "near_items")


def _merged(spans):
    """Merged spans of an array of [start, end]."""
    step = lambda a, s: F.when((F.size(a) > 0) & (F.element_at(F.element_at(a, -1), 2) >= s[0]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.array(F.element_at(a, -1)[0], F.greatest(F.element_at(a, -1)[1], s[1]))))).otherwise(F.concat(a, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<array<int>>"), step)


def brute_force(text: str | None, items: list[tuple[str, str | None]], slop: int = SLOP) -> tuple[int, int, list[str], list[str]]:
    """n_words, n_hit, items and near items of one text, from the definition, for tests."""
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found, near = cut(text), set(), set(), set()
    for item, passage in items:
        p = cut(passage)
        for i in range(max(1, len(p) - 12) if p else 0):
            x = p[i : i + 13]
            for s in range(-slop - len(x), len(w) + slop + 1):
                if s >= 0 and w[s : s + len(x)] == x:
                    hit.update(range(s, s + len(x)))
                    found.add(item)
                if all(t in w[max(0, s + o - slop) : max(0, s + o + slop + 1)] for o, t in enumerate(x)):
                    near.add(item)
    return len(w), len(hit), sorted(found), sorted(near)
