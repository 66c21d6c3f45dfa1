"""A training-corpus pipeline in five stages, each of which calls one operator of ``quern.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and reads it again as the next stage's docs. All stages but the last return the
columns they were given; a stage's decision applies to the rows its predecessor kept.

Of documents, doc_id, text, source and lang are read; other columns go through as they are, whatever their
names. Null texts count as empty; a null doc_id is an id like any other; rows that repeat doc_id and text are
judged alike, and the exact stage leaves one of them; an empty table gives an empty one at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe_tree, decontam, exact_dedup, quality, simhash
from quern.llm.common import written
from quern.llm.queries import table, vocabulary


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, text): rows with one key have one id and one text, so a decision on the key is one on the row."""
    return docs.select(F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("key"), "text")


def _where(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows whose key is (left_semi) or isn't (left_anti) among ``keys``."""
    keys = keys.select(F.col("key.doc_id").alias("_id"), F.col("key.h").alias("_h"))
    return docs.join(keys, (F.xxhash64(docs["text"]) == keys["_h"]) & docs["doc_id"].eqNullSafe(keys["_id"]), how)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_repeats(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the row with the smallest key stays."""
    found = simhash.near_duplicates(_keyed(docs), "key")
    return _where(docs, found.filter(F.col("key") == F.col("component_id")), "left_semi")


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    found = decontam.decontaminate(_keyed(docs), table(spark, sf_dir, "benchmark"), "key", slop=0)
    return _where(docs, found.filter("contaminated"), "left_anti")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: doc_id, n_tokens, ids_sha256, decoded_sha256, one row per row; null and empty texts have no tokens."""
    return bpe_tree.encode_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("simhash near-dedup", near_stage), ("benchmark decontamination", decontam_stage), ("bpe encoding", bpe_stage)]
#: Fingerprints, the fitted classifier and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
