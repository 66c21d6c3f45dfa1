"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades are ordered: 0 not toxic, 1 toxic, 2 severely toxic. The labels only tell toxic from
other rows, so a toxic row of the sample is graded by models that have not seen it: the sample is cut in folds,
each fold is scored by a model of the others, and the toxic rows that are scored above the median of
their kind are of grade 2. So the second threshold says how sure held-out models are, no more than that.
The model has one weight per term, shared by all thresholds: P(grade > k) = sigmoid(w . x - theta_k)
with theta_0 <= theta_1. Its expected severity is the sum of these over k. Features are the
presence, once, twice or more often, of terms (words and their beginnings), those that mark the toxic
documents of a bounded labelled sample more clearly than chance; their weights are never below
zero; the sample's counts are made by grouped aggregation, and only the chosen terms and the sample's sparse rows
reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import labelled, schema_of, texts, written

#: Labelled rows the model is fitted on, at most; folds of the sample; bytes of a word's beginning.
SAMPLE, FOLDS, BEGINNING = 6000, 5, 6
#: Words: lower-cased (A-Z) runs of letters and digits (of Latin-1, the first 128 of which are ASCII's), apostrophes and what is not ASCII.
TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() and not 0x41 <= c <= 0x5A or c == 0x27 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: bytes) -> set[bytes]:
    """A text's words and the first six bytes of longer ones, whole characters (marked ^, for inflected forms); marked 2 or 3 once more if it has them as often."""
    counts = Counter(text.translate(TABLE).split())
    for word, n in list(counts.items()):
        if len(word) > BEGINNING:
            counts[b"^" + word[:BEGINNING].decode(errors="ignore").encode()] += n
    out = set(counts)
    for least, mark in ((2, b"2 "), (3, b"3 ")):
        out.update([mark + t for t, n in counts.items() if n >= least])
    return out


class CumulativeLink:
    """Proportional-odds model: weights shared over ordered thresholds, with a normal prior on the weights."""

    def __init__(self, rows: list[list[int]], grades: np.ndarray, n_terms: int, rounds: int = 400, variance: float = 10.0, rate: float = 0.1):
        k = max(1, int(grades.max()))
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        term = np.fromiter((t for r in rows for t in r), np.int64, len(at))
        self.w, self.theta = np.zeros(n_terms), np.log(np.array([(grades <= j).sum() + 1.0 for j in range(k)]) / np.array([(grades > j).sum() + 1.0 for j in range(k)]))
        over = (grades[:, None] > np.arange(k)).astype(float)
        m = [np.zeros(n_terms + k) for _ in range(2)]
        for step in range(1, rounds + 1):
            score = np.bincount(at, self.w[term], len(rows))
            miss = 1 / (1 + np.exp(-np.clip(score[:, None] - self.theta, -30, 30))) - over
            g = np.concatenate([np.bincount(term, miss.sum(axis=1)[at], n_terms) / len(rows) + self.w / (variance * len(rows)), -miss.mean(axis=0)])
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            move = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
            self.w = np.maximum(self.w - move[:n_terms], 0.0)
            self.theta = np.maximum.accumulate(self.theta - move[n_terms:])

    def over(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.theta, -30, 30)))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, terms: int | None = None, least: int = 5, fewest: int = 20) -> tuple[dict[bytes, int], CumulativeLink] | None:
    """The vocabulary and the model, from at most ``sample`` labelled rows; None without toxic and other rows.

    terms: the clearest so many terms, or None for all that are clearer than chance; least: rows of the sample that
    a term needs; fewest: terms that are taken however clear they are.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("mark"), pa.array([sorted(terms_of(t)) for t in texts(b)], pa.list_(pa.binary()))], ["key", "toxic", "terms"])

    rows = labelled(df, labels, (F.col("toxic") > 0).cast("int"), id_col, text_col, sample)
    seen = written(rows.mapInArrow(words, "key long, toxic int, terms array<binary>").withColumn("row", F.monotonically_increasing_id()))
    n = {r.toxic: r.n for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    by_term = seen.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    pull = F.log((F.col("a") + 0.5) / (n[1] - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n[0] - F.col("b") + 0.5))
    z = pull / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    tested = written(by_term.filter(F.col("a") + F.col("b") >= least).select("term", z.alias("z")))
    bar = 0.75 * float(np.sqrt(2 * np.log(max(2, tested.count()))))  # three quarters of what the largest of so many chance differences reaches
    clear = tested.filter(F.col("z") >= bar).unionByName(tested.orderBy(F.col("z").desc(), "term").limit(fewest)).distinct()
    top = (clear if terms is None else clear.orderBy(F.col("z").desc(), "term").limit(terms)).collect()
    vocabulary = {t: i for i, t in enumerate(sorted(bytes(r.term) for r in top))}
    if not vocabulary:
        return None
    chosen = F.broadcast(df.sparkSession.createDataFrame(list(vocabulary.items()), "term binary, i int"))
    sparse = seen.select("row", "key", "toxic", F.explode_outer("terms").alias("term")).join(chosen, "term", "left").groupBy("row").agg(F.max("key").alias("key"), F.max("toxic").alias("toxic"), F.sort_array(F.collect_list("i")).alias("i")).orderBy("key", "toxic", "i").collect()
    held, toxic = [r.i for r in sparse], np.array([r.toxic for r in sparse])
    grades = severity(held, toxic, len(vocabulary), np.array([r.key % FOLDS for r in sparse]))
    return vocabulary, CumulativeLink(held, grades, len(vocabulary))


def severity(rows: list[list[int]], toxic: np.ndarray, n_terms: int, fold: np.ndarray) -> np.ndarray:
    """Grades of a sample: 0 for rows that are not toxic, 2 for toxic ones that models of the other folds score above their median, else 1. The fold of a row comes from its id, so that partitions don't matter."""
    scored = np.zeros(len(rows))
    for k in np.unique(fold):
        rest = np.flatnonzero(fold != k)
        if toxic[rest].min(initial=1) == toxic[rest].max(initial=0):
            continue
        model = CumulativeLink([rows[i] for i in rest], toxic[rest], n_terms)
        scored[fold == k] = [model.over(np.array([model.w[rows[i]].sum()]))[0, 0] for i in np.flatnonzero(fold == k)]
    return toxic + ((toxic > 0) & (scored > np.median(scored[toxic > 0])))


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE, terms: int | None = None, least: int = 5, fewest: int = 20) -> DataFrame:
    """One row per row: id_col, p_over_0, p_over_1, expected_severity, grade, toxic.

    grade is the number of k with P(grade > k) >= threshold; toxic: grade above 0. Null, empty and
    wordless texts have no features, so the intercepts alone decide. Without a model (labels of one
    kind, or none that name a row) all probabilities are null and nothing is toxic. Repeated rows
    get equal results; an empty table gives an empty result. Other columns are not read.
    """
    model = fit(df, labels, id_col, text_col, sample, terms, least, fewest)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["p_over_0", "p_over_1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, fitted = model
        known = vocabulary.keys()
        for b in batches:
            s = np.array([math.fsum(fitted.w[vocabulary[t]] for t in known & terms_of(x)) for x in texts(b)], float)
            p = fitted.over(s)
            p = np.column_stack([p, np.zeros((len(p), 2))])[:, :2]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(p[:, k]) for k in (0, 1))], ["id", *names])

    if model is None:
        got = rows.select("id", *(F.lit(None).cast("double").alias(c) for c in names))
    else:
        got = rows.mapInArrow(run, T.StructType([schema_of(rows, "id"), *(T.StructField(c, T.DoubleType()) for c in names)]))
    grade = sum(F.when(F.col(c) >= threshold, 1).otherwise(0) for c in names)
    return got.select(F.col("id").alias(id_col), *(F.round(c, 6).alias(c) for c in names), F.round(F.col(names[0]) + F.col(names[1]), 6).alias("expected_severity"), grade.alias("grade"), (grade > 0).alias("toxic"))
