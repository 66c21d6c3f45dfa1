"""The shared folder, text files, gold manifests and reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = """kind string, status string, documents array<struct<id string, file string, sha256 string>>, questions array<struct<id string, question string, referenceAnswer string, category string, difficulty string, split string,
  leakageGroup string, answerable boolean, supportingSpans array<struct<documentId string, page int, start int, `end` int, quote string>>>>"""


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A new folder name below the checkpoint folder, which driver and executors share; in local mode a temporary folder will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` from a new table in the shared folder, so that it is computed once however often it is read."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def has_pdf_magic(content: Column) -> Column:
    """Whether bytes start as a PDF file does."""
    return F.startswith(content, F.lit(b"%PDF-"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, problem) of text files: strict UTF-8, no NUL; a file with a problem has no text."""
    raw = spark.read.format("binaryFile").load(path)
    problem = F.when(~F.expr("is_valid_utf8(CAST(content AS STRING))"), "INVALID_UTF8").when(F.expr("position(X'00' IN content) > 0"), "BINARY_CONTENT").when(has_pdf_magic(F.col("content")), "PDF")
    return raw.select("path", problem.alias("problem"), "content").select("path", F.when(F.col("problem").isNull(), F.decode("content", "UTF-8")).alias("text"), "problem")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line, content, file_bytes) of text files, read by byte ranges, so that a large file is read by many tasks.

    A line ends at a line feed and belongs to the range that it begins in; ``line`` orders the lines of a block, a task's share of a
    file, which begins at byte ``block``. No character stands in two lines, so strict decoding needs no look across borders.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("file_bytes"))


def text_file_report(lines: DataFrame) -> DataFrame:
    """(path, n_lines, n_chars, problem) of files' lines: the problems of ``read_text_files``, found line by line and added up.

    Characters include line feeds, of which there are as many as the file has bytes beyond its lines'. A file with a problem has no
    characters. An empty file has no line, so it isn't in the report.
    """
    flags = [F.bool_or(~F.expr("is_valid_utf8(content)")).alias("_a"), F.bool_or(F.contains("content", F.lit("\0"))).alias("_b"), F.bool_or((F.col("block") == 0) & (F.col("line") == F.col("_first")) & F.startswith("content", F.lit("%PDF-"))).alias("_c")]
    first = lines.filter("block = 0").groupBy("path").agg(F.min("line").alias("_first"))
    by = lines.join(first, "path", "left").groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("content").cast("long")).alias("_n"), F.sum(F.octet_length("content").cast("long")).alias("_o"), F.max("file_bytes").alias("_size"), *flags)
    problem = F.when(F.col("_a"), "INVALID_UTF8").when(F.col("_b"), "BINARY_CONTENT").when(F.col("_c"), "PDF")
    return by.select("path", "n_lines", F.when(problem.isNull(), F.col("_n") + F.col("_size") - F.col("_o")).alias("n_chars"), problem.alias("problem"))


def load_gold_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions with their spans exploded, violations) of nested JSON manifests, one to a file."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    q = m.select(F.explode("questions").alias("q")).select("q.*")
    spans = q.select("id", "question", "category", "difficulty", "split", F.explode_outer("supportingSpans").alias("s")).select("id", "question", "category", "difficulty", "split", "s.*")
    docs = m.select(F.explode("documents").alias("d")).select(F.col("d.id").alias("documentId"), "d.sha256")
    dup = lambda df, c, name: df.groupBy(c).count().filter("count > 1").select(F.lit(name).alias("violation"), F.col(c).alias("id"))
    bad = dup(q, "id", "DUPLICATE_QUESTION_ID").unionByName(dup(docs, "documentId", "DUPLICATE_DOCUMENT_ID")).unionByName(dup(docs, "sha256", "DUPLICATE_DOCUMENT_CONTENT"))
    lost = spans.filter("documentId IS NOT NULL").join(docs.select("documentId"), "documentId", "left_anti").select(F.lit("UNKNOWN_DOCUMENT").alias("violation"), "id")
    return spans, bad.unionByName(lost)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
