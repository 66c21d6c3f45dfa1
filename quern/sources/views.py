"""The library's tables, bound to the given ones, and the same as DuckDB SQL for the checks.

Columns that the given tables lack (states, versions, file names) follow from the ids by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Room for the chunks of a document in chunk ids: more than the longest string a column can hold has windows of 1,000 characters.
CHUNK_IDS = 1 << 22
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else c for c, t in df.dtypes))


def kb_documents(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Documents with tenant, hash, size, file name, state, versions, model and creation time; of a stream of documents if one is given."""
    return (read(spark, sf_dir, "documents") if documents is None else documents).selectExpr(
        "doc_id AS document_id", "source AS tenant", "sha2(text, 256) AS content_hash", "CAST(octet_length(text) AS BIGINT) AS byte_size",
        "concat('file_', doc_id, '.', element_at(array('pdf','docx','txt','md','csv','html','xlsx','pptx'), CAST(1 + doc_id % 8 AS INT))) AS filename",
        "CASE WHEN doc_id % 10 < 7 THEN 'ready' WHEN doc_id % 10 = 7 THEN 'processing' WHEN doc_id % 10 = 8 THEN 'failed' ELSE 'deleting' END AS status",
        "1 + doc_id % 2 AS version", "1 + doc_id % 3 AS parser_version", "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'm1' ELSE 'm2' END AS model",
        "timestamp'2024-01-01 00:00:00' + doc_id * interval '1' minute AS created_at", "lang", "text",
    )


def kb_chunks(spark: SparkSession, sf_dir: str, size: int = 1000, documents: DataFrame | None = None) -> DataFrame:
    """Fixed windows of the documents' text, without overlap; one chunk in seven is of an older version."""
    from quern.operators.chunking import windows

    kept = ("document_id", "tenant", "filename", "status", "version", "parser_version", "model")
    return kb_documents(spark, sf_dir, documents).select(*kept, F.posexplode(windows("text", size)).alias("i", "content")).selectExpr(
        f"document_id * {CHUNK_IDS} + i AS chunk_id", *kept, "CAST(i AS BIGINT) AS chunk_index", "CAST(i DIV 2 + 1 AS BIGINT) AS page", "content",
        "CASE WHEN (document_id + i) % 7 = 0 THEN version - 1 ELSE version END AS chunk_version",
    )


def kb_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


def kb_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: every fiftieth vector, asked with the first words of its document."""
    return (
        read(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").join(read(spark, sf_dir, "documents"), F.expr("doc_id = vec_id"))
        .selectExpr("vec_id AS query_id", "embedding AS query_embedding", "array_join(slice(split(text, '\\\\s+'), 1, 12), ' ') AS question", "label AS query_label")
    )


def kb_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions (variant 0), and as variant 1 their first two words with the vector after theirs."""
    q = kb_questions(spark, sf_dir).select("query_id", "question", "query_embedding")
    after = read(spark, sf_dir, "embeddings").selectExpr("vec_id - 1 AS query_id", "embedding AS query_embedding")
    short = q.selectExpr("query_id", "array_join(slice(split(question, ' '), 1, 2), ' ') AS question").join(after, "query_id", "left")
    return q.withColumn("variant", F.lit(0)).unionByName(short.withColumn("variant", F.lit(1)))


def kb_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages for full-text search: every document is one; sixty parents hold them. Some parents aren't ready, some are slides, and one passage in 29 is of an older version."""
    return (
        read(spark, sf_dir, "documents").withColumn("document_id", F.expr("doc_id % 60"))
        .selectExpr("doc_id AS chunk_id", "document_id", "doc_id % 3 + 1 AS page", "doc_id AS chunk_index", "concat('file_', document_id, CASE WHEN document_id % 8 = 7 THEN '.pptx' ELSE '.pdf' END) AS filename", "text AS content", "source AS tenant",
                    "CASE WHEN document_id % 15 = 14 THEN 'processing' ELSE 'ready' END AS status", "1 + document_id % 2 AS version", "1 + document_id % 3 AS parser_version", "1 + document_id % 2 - CASE WHEN doc_id % 29 = 3 THEN 1 ELSE 0 END AS chunk_version")
    )


def kb_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that have a vector, for dense search."""
    return kb_passages(spark, sf_dir).join(read(spark, sf_dir, "embeddings").selectExpr("vec_id AS chunk_id", "embedding", "label"), "chunk_id")


def kb_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "event_type AS event", "value AS latency_ms", "props AS attributes", "CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 11 = 0 THEN 'refused' ELSE 'ok' END AS status")


def kb_jobs(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Ingestion jobs: an order is a job, its lines are attempts; of a stream of orders if one is given."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("attempts"), F.min("l_shipdate").alias("started_at"), F.max("l_shipdate").alias("ended_at"))
    return (read(spark, sf_dir, "orders") if orders is None else orders).join(lines, F.expr("o_orderkey = l_orderkey"), "left").selectExpr(
        "o_orderkey AS job_id", "o_custkey AS owner", "o_orderkey % 1000 AS document_id", "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'retrying' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'running' WHEN o_orderkey % 3 = 1 THEN 'queued' ELSE 'failed' END END AS status",
        "coalesce(attempts, 0) AS attempt_count", "o_orderdate AS available_at", "started_at", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE started_at END AS locked_at", "CASE WHEN o_orderstatus = 'F' THEN ended_at END AS completed_at", "o_totalprice AS size_kb",
    )


def kb_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").selectExpr("conv_id AS thread_id", "turn", "role", "text")


def kb_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers: the assistant's turns, with markers and some structure put in by turn."""
    return read(spark, sf_dir, "conversations").filter("role = 'assistant'").selectExpr("conv_id * 100 + turn AS answer_id", """concat(text, CASE (conv_id + turn) % 8
      WHEN 0 THEN '' WHEN 1 THEN ' [source_1]' WHEN 2 THEN ' [source_02]\n\n- item [source_01]\n- more [source_3]' WHEN 3 THEN ' [source_123]' WHEN 4 THEN ' [ source_ 3x ]' WHEN 5 THEN ' [source_02]\n```\ncode [source_77]\n```\n# Head\n| a | b |\n|---|---|\n| c [source_1] | d |'
      WHEN 6 THEN ' [source_07] \\"quoted words\\"' ELSE ' [source_03]\n> quote [source_02]\n> more\n\n---\n[source_01]' END) AS answer""")


SQL = {
    "kb_documents": """SELECT doc_id AS document_id, source AS tenant, sha256(text) AS content_hash, strlen(text)::BIGINT AS byte_size,
      'file_' || doc_id || '.' || (['pdf','docx','txt','md','csv','html','xlsx','pptx'])[1 + doc_id % 8] AS filename,
      CASE WHEN doc_id % 10 < 7 THEN 'ready' WHEN doc_id % 10 = 7 THEN 'processing' WHEN doc_id % 10 = 8 THEN 'failed' ELSE 'deleting' END AS status,
      1 + doc_id % 2 AS version, 1 + doc_id % 3 AS parser_version, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'm1' ELSE 'm2' END AS model,
      TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, lang, text FROM documents""",
    "kb_chunks": f"""SELECT document_id * {CHUNK_IDS} + i AS chunk_id, document_id, tenant, filename, status, version, parser_version, model, i AS chunk_index, i // 2 + 1 AS page, substr(text, i * 1000 + 1, 1000) AS content,
      CASE WHEN (document_id + i) % 7 = 0 THEN version - 1 ELSE version END AS chunk_version FROM (SELECT *, unnest(range(0, (length(text) - 1) // 1000 + 1)) AS i FROM kb_documents WHERE length(text) > 0)""",
    "kb_questions": """SELECT vec_id AS query_id, embedding AS query_embedding, array_to_string((regexp_split_to_array(text, '\\s+'))[1:12], ' ') AS question, label AS query_label FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0""",
    "kb_variants": """SELECT query_id, 0 AS variant, question, query_embedding FROM kb_questions UNION ALL
      SELECT query_id, 1, array_to_string((string_split(question, ' '))[1:2], ' '), embedding FROM kb_questions LEFT JOIN embeddings ON vec_id = query_id + 1""",
    "kb_passages": """SELECT doc_id AS chunk_id, document_id, doc_id % 3 + 1 AS page, doc_id AS chunk_index, 'file_' || document_id || CASE WHEN document_id % 8 = 7 THEN '.pptx' ELSE '.pdf' END AS filename, text AS content, source AS tenant,
      CASE WHEN document_id % 15 = 14 THEN 'processing' ELSE 'ready' END AS status, 1 + document_id % 2 AS version, 1 + document_id % 3 AS parser_version,
      1 + document_id % 2 - CASE WHEN doc_id % 29 = 3 THEN 1 ELSE 0 END AS chunk_version FROM (SELECT *, doc_id % 60 AS document_id FROM documents)""",
    "kb_corpus": """SELECT kb_passages.*, embedding, label FROM kb_passages JOIN embeddings ON chunk_id = vec_id""",
    "kb_events": """SELECT event_id, ts, user_id, event_type AS event, value AS latency_ms, props AS attributes, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 11 = 0 THEN 'refused' ELSE 'ok' END AS status FROM events""",
    "kb_jobs": """SELECT o_orderkey AS job_id, o_custkey AS owner, o_orderkey % 1000 AS document_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'retrying' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'running' WHEN o_orderkey % 3 = 1 THEN 'queued' ELSE 'failed' END END AS status,
      coalesce(attempts, 0) AS attempt_count, o_orderdate AS available_at, started_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE started_at END AS locked_at, CASE WHEN o_orderstatus = 'F' THEN ended_at END AS completed_at, o_totalprice AS size_kb
      FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS attempts, min(l_shipdate) AS started_at, max(l_shipdate) AS ended_at FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "kb_messages": "SELECT conv_id AS thread_id, turn, role, text FROM conversations",
    "kb_answers": """SELECT conv_id * 100 + turn AS answer_id, text || CASE (conv_id + turn) % 8 WHEN 0 THEN '' WHEN 1 THEN ' [source_1]' WHEN 2 THEN ' [source_02]\n\n- item [source_01]\n- more [source_3]' WHEN 3 THEN ' [source_123]' WHEN 4 THEN ' [ source_ 3x ]'
      WHEN 5 THEN ' [source_02]\n```\ncode [source_77]\n```\n# Head\n| a | b |\n|---|---|\n| c [source_1] | d |' WHEN 6 THEN ' [source_07] "quoted words"' ELSE ' [source_03]\n> quote [source_02]\n> more\n\n---\n[source_01]' END AS answer FROM conversations WHERE role = 'assistant'""",
}
NEEDS = {"kb_chunks": ["kb_documents"], "kb_corpus": ["kb_passages"], "kb_variants": ["kb_questions"]}


def with_views(sql: str) -> str:
    """``sql`` (a query, or CTEs and a query after ``;``) with the views that it names in front."""
    named = [v for v in SQL if v in sql]
    named = list(dict.fromkeys(x for v in named for x in [*NEEDS.get(v, []), v]))
    ctes, _, body = sql.rpartition(";;")
    parts = [f"{v} AS ({SQL[v]})" for v in named] + ([ctes.strip()] if ctes.strip() else [])
    return (f"WITH {', '.join(parts)} " if parts else "") + body.strip()
