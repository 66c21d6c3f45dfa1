"""Queries that run as streams over the given tables, and their batch twins in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import policy as po
from quern.operators import chunking as ch
from quern.operators.embed import embed_batches
from quern.plans.registry import query
from quern.sources import views as v
from quern.streaming import streams as st


@query("str_01_document_ingest", """SELECT doc_id, i AS chunk_index, substr(text, i * 1000 + 1, 1000) AS content, 64 AS dim FROM (SELECT *, unnest(range(0, (length(text) - 1) // 1000 + 1)) AS i
    FROM documents WHERE length(text) > 0)""")
def ingest(spark, d):
    """Documents are cut, their chunks embedded, and both kept by document."""
    chunk = lambda b: embed_batches(ch.window_chunks(b, "doc_id", "text"), "content")
    return st.ingest(st.source(spark, d, "documents", files=3), chunk, "doc_id").select("doc_id", "chunk_index", "content", F.size("embedding").alias("dim"))


@query("str_02_telemetry_rollup", """SELECT floor(epoch(ts))::BIGINT - floor(epoch(ts))::BIGINT % 86400 AS start, event_type, count(*) AS requests,
    count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def rollup(spark, d):
    return st.drain(st.telemetry_rollup(st.source(spark, d, "events")), "update", ["start", "event_type"])


@query("str_03_exact_limiter", """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, []::BIGINT[] AS held, NULL::BIGINT AS event_id, false AS admitted FROM e UNION ALL
 SELECT user_id, k, CASE WHEN len(held) < 5 THEN list_append(held, us) ELSE held END, event_id, len(held) < 5
    FROM (SELECT e.user_id, e.k, e.us, e.event_id, list_filter(r.held, lambda t: t > e.us - 86400000000) AS held FROM r
    JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT event_id, user_id, admitted FROM r WHERE k > 0""")
def limiter(spark, d):
    return st.limit_all(st.source(spark, d, "events"), 5, 86400)


@query("str_04_fixed_window", "SELECT user_id, floor(epoch(ts))::BIGINT - floor(epoch(ts))::BIGINT % 3600 AS window_start, count(*) AS request_count FROM events GROUP BY 1, 2")
def fixed(spark, d):
    return st.drain(st.fixed_window_counts(st.source(spark, d, "events"), 3600), "update", ["user_id", "window_start"])


@query("str_05_lease_sweep", """SELECT job_id, CASE WHEN count(*) >= 4 THEN 'failed' ELSE 'retrying' END AS status FROM kb_jobs JOIN lineitem ON l_orderkey = job_id WHERE kb_jobs.status = 'running'
    GROUP BY job_id HAVING max(l_shipdate) + INTERVAL 300 SECOND <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 1 HOUR""")
def sweep(spark, d):
    """A stream of lines, each a sign of life of its job; those of running jobs renew the job's lease."""
    running = v.kb_jobs(spark, d).filter("status = 'running'").select("job_id")
    lines = st.source(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.lit(True).alias("running"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return st.drain(st.lease_sweep(lines.withWatermark("ts", st.RETENTION).join(running, "job_id", "left_semi"), po.LEASE_SECONDS, po.MAX_ATTEMPTS, late=None))


@query("str_06_pruned_windows", """SELECT floor(epoch(ts))::BIGINT - floor(epoch(ts))::BIGINT % 86400 AS start, count(*) AS n FROM events
    WHERE floor(epoch(ts))::BIGINT - floor(epoch(ts))::BIGINT % 86400 + 86400 <= (SELECT floor(epoch(max(ts))) - 3600 FROM events) GROUP BY 1""")
def pruned(spark, d):
    """Windows that the watermark has closed; their state is gone."""
    w = st.source(spark, d, "events").withWatermark("ts", st.RETENTION).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return st.drain(w.select(F.unix_seconds("window.start").alias("start"), "n"))


@query("str_07_without_repeats", "SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def repeats(spark, d):
    """Documents come within an hour, whatever their number, and repeats are looked for within two."""
    docs = st.source(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), F.timestamp_seconds(F.col("doc_id") % 3600 + 1704067200).alias("ts"))
    return st.drain(st.without_repeats(docs, "content_hash", "ts", "2 hours")).select("content_hash")


@query("str_08_published_view", """p AS (SELECT document_id, count(*) FILTER (chunk_version = version AND model IS NOT NULL) = max(chunk_index) + 1 AS complete FROM kb_chunks
    GROUP BY 1),
  l AS (SELECT document_id, arg_max(status, job_id) AS s FROM kb_jobs GROUP BY 1)
;; SELECT document_id, complete AND coalesce(s, 'succeeded') = 'succeeded' AS published FROM p LEFT JOIN l USING (document_id)""")
def published(spark, d):
    """A stream of chunks and one of jobs, which all come within an hour."""
    at = lambda c: F.timestamp_seconds(F.col(c) % 60 * 60 + 1704067200).alias("ts")
    chunks = v.kb_chunks(spark, d, documents=st.source(spark, d, "documents", files=3))
    good = (F.col("chunk_version") == F.col("version")) & F.col("model").isNotNull()
    jobs = v.kb_jobs(spark, d, st.source(spark, d, "orders")).select("document_id", F.col("job_id").alias("job"), "status", at("job_id"))
    return st.drain(st.published_view(chunks.select("document_id", "chunk_index", good.alias("good"), at("document_id")), jobs), "update", ["document_id"])
