"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

Each document gets evidence from a logistic model on its hashed byte trigrams, once of the lower-cased text
and once of its shape (letters, capitals, digits and white space as kinds, marks as themselves),
fitted on a bounded sample of labelled rows. A site's rate of good documents is estimated by grouped sums of
evidence: the global rate, then the host's rate shrunk toward it, then the path's rate shrunk toward its
host's. How strongly is itself estimated from the spread of the site rates (method of moments), so
sparse sites take their parent's rate and large ones keep their own. A document's own evidence is taken out
of the sums of its host and path before they become its prior, so that it counts once:

    host = (host sum - own + strength * global) / (host count - 1 + strength)
    path = (path sum - own + strength * host) / (path count - 1 + strength)
    logit(posterior) = logit(own) - logit(global) + logit(path)

A host is the source up to its first slash, a path the rest and the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import join_counted, labelled, texts, written

#: Labelled rows the model is fitted on, at most; cells of each kind of trigrams; bytes of a text that are counted, and texts that are scored, at once.
SAMPLE, CELLS, STEP, SCORED = 4000, 512, 1 << 20, 1024
LOWER_CASED = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
#: Kinds of bytes, below any mark: digits, capitals, other letters and what is not ASCII, white space, line ends.
SHAPES = np.array([1 if 0x30 <= b <= 0x39 else 2 if 0x41 <= b <= 0x5A else 3 if b >= 0x80 or 0x61 <= b <= 0x7A else 5 if b == 0x0A else 4 if b in b" \t\r\x0b\x0c" else b for b in range(256)], np.uint8)


def _counts(a: np.ndarray) -> np.ndarray:
    """How often the trigrams of some bytes fall in each cell (a multiplicative hash of the three bytes)."""
    out = np.zeros(CELLS, np.int64)
    for i in range(0, len(a) - 2, STEP):
        x = a[i : i + STEP + 2].astype(np.uint32)
        h = (x[:-2] | x[1:-1] << 8 | x[2:] << 16) * np.uint32(2654435761)
        out += np.bincount((h ^ h >> 13) * np.uint32(0x85EBCA6B) >> 16 & CELLS - 1, minlength=CELLS)
    return out


def features(text: bytes) -> np.ndarray:
    """Square roots of the trigram counts of the whole text and of its shape, each of length one; zero for texts under three bytes."""
    a = np.frombuffer(text, np.uint8)
    both = np.sqrt(np.stack([_counts(LOWER_CASED[a]), _counts(SHAPES[a])]).astype(np.float32))
    return (both / np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)).astype(np.float16).ravel()


class Logistic:
    """Logistic regression with a ridge, by Newton's method, on centred features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.03):
        self.mean = x.mean(axis=0)
        z, penalty = self._centred(x), np.r_[1e-6, np.full(x.shape[1], ridge)]
        self.w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def _centred(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), x - self.mean])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._centred(x) @ self.w


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Logistic | None:
    """The model from at most ``sample`` labelled rows; None if they are fewer than ten or not of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("mark"), pa.array([features(t).tobytes() for t in texts(b)], pa.binary())], ["good", "x"])

    got = labelled(df, labels, F.col("quality").cast("int"), id_col, text_col, sample).mapInArrow(run, "good int, x binary").collect()
    y = np.array([r.good for r in got], float)
    if len(got) < 10 or y.min() == y.max():
        return None
    return Logistic(np.frombuffer(b"".join(r.x for r in got), np.float16).reshape(len(got), -1).astype(np.float64), y)


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def strength(sites: DataFrame, prior: str) -> float:
    """How many documents the prior of a site counts for, from the spread of all sites' rates good / n around it.

    One number, found by a grouped sum over the sites of two documents or more. By the method of moments
    E[sum n (rate - prior)^2] = sum prior (1 - prior) + tau^2 sum n, and a Beta prior of variance
    tau^2 has the strength prior (1 - prior) / tau^2 - 1. It is held between 1 and a million; 50 without such sites.
    """
    rate, mean = F.col("good") / F.col("n"), F.col(prior)
    s = sites.filter("n >= 2").agg(F.sum(F.col("n") * (rate - mean) ** 2).alias("between"), F.sum(mean * (1 - mean)).alias("noise"), F.sum("n").alias("n"), F.sum(mean * (1 - mean) * F.col("n")).alias("var")).first()
    if not s.n:
        return 50.0
    return min(max(s["var"] / s.n / max((s.between - s.noise) / s.n, 1e-6) - 1, 1.0), 1e6)


def _posteriors(df: DataFrame, labels: DataFrame, columns: list[str], id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """One row per row: row (a struct of the ``columns`` as c0, c1, ...), evidence, host_rate, path_rate, p_quality."""
    model = fit(df, labels, id_col, text_col)
    host = F.regexp_extract(F.coalesce(F.col(source_col).cast("string"), F.lit("")), "^([^/]*)", 1)
    path = F.concat_ws("/", F.regexp_extract(F.coalesce(F.col(source_col).cast("string"), F.lit("")), "^[^/]*(/.*)?$", 1), F.coalesce(F.col(lang_col).cast("string"), F.lit("")))
    rows = df.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))).alias("row"), F.col(text_col).cast("string").alias("text"), host.alias("host"), path.alias("path"))
    out = T.StructType([rows.schema["row"], rows.schema["host"], rows.schema["path"], T.StructField("evidence", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logit = np.concatenate([model.logit(np.stack([features(t) for t in part])) for part in batched(texts(b), SCORED)]) if model is not None and len(b) else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("host"), b.column("path"), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], ["row", "host", "path", "evidence"])

    scored = written(rows.mapInArrow(score, out))
    paths = written(scored.groupBy("host", "path").agg(F.sum("evidence").alias("good"), F.count("*").alias("n")))
    mean = paths.agg(F.sum("good") / F.sum("n")).first()[0]
    mean = 0.5 if mean is None else mean
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    of_host = strength(hosts.select(F.col("host_good").alias("good"), F.col("host_n").alias("n"), F.lit(mean).alias("mean")), "mean")
    sites = paths.join(hosts, "host")
    of_path = strength(sites.withColumn("prior", (F.col("host_good") + of_host * mean) / (F.col("host_n") + of_host)), "prior")
    host_rate = (F.col("host_good") - F.col("evidence") + of_host * mean) / (F.col("host_n") - 1 + of_host)
    path_rate = (F.col("good") - F.col("evidence") + of_path * F.col("host_rate")) / (F.col("n") - 1 + of_path)
    got = join_counted(scored, sites, ["host", "path"], "n").withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    got = got.withColumn("p_quality", F.round(1 / (1 + F.exp(_logit(F.lit(mean)) - _logit(F.col("evidence")) - _logit(F.col("path_rate")))), 6))
    return got.select("row", *(F.round(c, 6).alias(c) for c in ("evidence", "host_rate", "path_rate")), "p_quality")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """One row per row: id_col, evidence, host_rate, path_rate, p_quality, kept (p_quality >= threshold).

    Null and empty texts have the evidence of a wordless text; a null source or language is a site
    of its own; host_rate and path_rate leave the row's own evidence out, so a site of one row has its
    parent's rate. Repeated rows count as often as they stand. Labels that name no row, or one kind of
    label only, give no model: evidence is then one half for all and every row is kept. An empty
    table gives an empty result. Other columns are not read.
    """
    got = _posteriors(df, labels, [id_col], id_col, text_col, source_col, lang_col)
    return got.select(F.col("row.c0").alias(id_col), "evidence", "host_rate", "path_rate", "p_quality", (F.col("p_quality") >= threshold).alias("kept"))


def drop_rejected(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that ``classify`` keeps, with all their columns, whatever their names."""
    got = _posteriors(df, labels, df.columns, id_col, text_col, source_col, lang_col)
    return got.filter(F.col("p_quality") >= threshold).select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)))
