"""Queries of rollups, windows, sorts and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import evaluation as ev
from quern.operators import retrieval as rt
from quern.operators import rollups as ro
from quern.operators.chunking import windows
from quern.plans.registry import query
from quern.sources import files
from quern.sources import views as v

API = ("click", "view", "error")
_api = """count(*) AS requests, count(*) FILTER (status = 'error') AS errors, round(count(*) FILTER (status = 'error')::DOUBLE / count(*), 4) AS error_rate, coalesce(quantile_disc(latency_ms, 0.5), 0) AS p50_ms, coalesce(quantile_disc(latency_ms, 0.95), 0) AS p95_ms, coalesce(quantile_disc(latency_ms, 0.99), 0) AS p99_ms"""


@query("agg_01_api_rollup", f"SELECT {_api} FROM kb_events WHERE ts >= (SELECT max(ts) FROM kb_events) - INTERVAL 10080 MINUTE AND event IN {API}")
def api(spark, d):
    return ro.api_rollup(ro.since(v.kb_events(spark, d), 100_000), list(API))


@query("agg_02_rag_rollup", """e AS (SELECT *, (attributes->>'$.k')::BIGINT AS k FROM kb_events WHERE event IN ('view', 'purchase', 'error'))
;; SELECT coalesce(quantile_disc(k, 0.5) FILTER (event = 'view'), 0) AS retrieval_p50, coalesce(quantile_disc(k, 0.95) FILTER (event = 'view'), 0) AS retrieval_p95, count(*) FILTER (event = 'purchase') AS answers, count(*) FILTER (k > 40) AS grounded, count(*) FILTER (status = 'refused') AS refusals, round(avg(k), 2) AS avg_hits FROM e""")
def rag(spark, d):
    e = v.kb_events(spark, d).filter("event IN ('view', 'purchase', 'error')").withColumn("k", F.get_json_object("attributes", "$.k").cast("long"))
    sums = e.agg(F.count_if(F.col("event") == "purchase").alias("answers"), F.count_if(F.col("k") > 40).alias("grounded"), F.count_if(F.col("status") == "refused").alias("refusals"), F.round(F.avg("k"), 2).alias("avg_hits"))
    ranked = ro.exact_percentiles(e.filter("event = 'view'"), "k", {"retrieval_p50": 0.5, "retrieval_p95": 0.95})
    return sums.join(ranked, F.lit(True), "left").select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("retrieval_p50", "retrieval_p95")), "answers", "grounded", "refusals", "avg_hits")


@query("agg_03_ingestion_rollup", """SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running,
    count(*) FILTER (status = 'retrying') AS retrying, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'succeeded') AS succeeded, sum(greatest(attempt_count - 1, 0))::BIGINT AS retries,
    round(avg((epoch(completed_at) - epoch(started_at)) * 1000), 0) AS avg_duration_ms FROM kb_jobs""")
def ingestion(spark, d):
    return ro.ingestion_rollup(v.kb_jobs(spark, d))


@query("agg_04_cost_rollup", "SELECT event, count(*) AS calls, sum((attributes->>'$.k')::BIGINT)::BIGINT AS tokens FROM kb_events GROUP BY 1")
def cost(spark, d):
    return v.kb_events(spark, d).groupBy("event").agg(F.count("*").alias("calls"), F.sum(F.get_json_object("attributes", "$.k").cast("long")).alias("tokens"))


@query("agg_05_nearest_rank_percentile", "SELECT user_id, quantile_disc(latency_ms, 0.9) AS p90 FROM kb_events GROUP BY 1")
def nearest(spark, d):
    return ro.exact_percentiles(v.kb_events(spark, d), "latency_ms", {"p90": 0.9}, ["user_id"])


@query("agg_06_latency_summary", """SELECT event, count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99, max(latency_ms) AS max, round(avg(latency_ms), 4) AS mean FROM kb_events GROUP BY 1""")
def latency(spark, d):
    return ro.latency_summary(v.kb_events(spark, d), "latency_ms", ["event"])


@query("agg_07_safe_rate", """SELECT user_id, CASE WHEN count(*) FILTER (event = 'view') <= 0 THEN 0 ELSE round(count(*) FILTER (event = 'purchase')::DOUBLE /
    count(*) FILTER (event = 'view'), 6) END AS rate FROM kb_events GROUP BY 1""")
def rate(spark, d):
    from quern.functions.policy import safe_rate

    t = v.kb_events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event") == "purchase").alias("n"), F.count_if(F.col("event") == "view").alias("d"))
    return t.select("user_id", F.round(safe_rate(F.col("n"), F.col("d")), 6).alias("rate"))


@query("agg_08_score_histogram", """b AS (SELECT floor(least(greatest(latency_ms / 100, 0), 0.9999) * 10)::BIGINT AS bin, count(*) AS n FROM kb_events GROUP BY 1)
;; SELECT r AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS r) LEFT JOIN b ON r = bin""")
def histogram(spark, d):
    return ro.score_histogram(v.kb_events(spark, d).withColumn("s", F.col("latency_ms") / 100), "s")


@query("agg_09_throughput", "SELECT owner, round(count(*) / (sum(size_kb) / 1000), 2) AS per_second FROM kb_jobs GROUP BY 1")
def throughput(spark, d):
    return v.kb_jobs(spark, d).groupBy("owner").agg(F.round(F.count("*") / (F.sum("size_kb") / 1000), 2).alias("per_second"))


@query("agg_10_queue_depth", "SELECT status, count(*) AS n FROM kb_jobs GROUP BY 1")
def depth(spark, d):
    return v.kb_jobs(spark, d).groupBy("status").agg(F.count("*").alias("n"))


ADMIT = """d AS (SELECT document_id, tenant, CASE WHEN document_id % 3 = 0 THEN 'ready' ELSE 'processing' END AS status, byte_size * 5000 AS byte_size
    FROM kb_documents),
  a AS (SELECT *, count(*) OVER w AS n_before, coalesce(sum(byte_size) OVER w, 0) AS bytes_before FROM d
    WHERE status = 'processing' WINDOW w AS (PARTITION BY tenant ORDER BY document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("agg_11_admission_check", ADMIT + """
;; SELECT document_id, tenant, n_before, bytes_before::BIGINT AS bytes_before, NOT (n_before >= 20 OR bytes_before + byte_size > 209715200) AS admitted FROM a""")
def admission(spark, d):
    """Sizes are taken as 5,000 times as large, so that the byte limit binds too."""
    t = v.kb_documents(spark, d).selectExpr("document_id", "tenant", "CASE WHEN document_id % 3 = 0 THEN 'ready' ELSE 'processing' END AS status", "byte_size * 5000 AS byte_size")
    return ro.admission_check(t).select("document_id", "tenant", "n_before", "bytes_before", "admitted")


@query("agg_12_free_capacity", "SELECT greatest(0, 400 - count(*)) AS capacity FROM kb_jobs WHERE status = 'running' AND locked_at >= TIMESTAMP '1996-06-01'")
def capacity(spark, d):
    return v.kb_jobs(spark, d).filter("status = 'running' AND locked_at >= timestamp'1996-06-01'").agg(F.greatest(F.lit(0), 400 - F.count("*")).alias("capacity"))


@query("agg_13_publication_check", """SELECT document_id, count(*) FILTER (chunk_version = version AND model IS NOT NULL) AS indexed, max(chunk_index) + 1 AS expected,
    count(*) FILTER (chunk_version = version AND model IS NOT NULL) = max(chunk_index) + 1 AS complete FROM kb_chunks GROUP BY 1""")
def publication(spark, d):
    return ro.publication_check(v.kb_chunks(spark, d))


# Categories with the questions that a full collection needs of each.
TARGETS = {"factual": 15, "semantic": 10, "exact": 10, "multi-hop": 10, "unanswerable": 10, "adversarial": 5}
_CASES = f"""cases AS (SELECT doc_id AS id, ([{','.join(map(repr, TARGETS))}])[1 + doc_id % 6] AS category, CASE WHEN doc_id % 3 = 0 THEN 'held-out'
    ELSE 'development' END AS split, (['easy', 'medium', 'hard'])[1 + doc_id % 3] AS difficulty, quality = 0 AS expect_refusal, toxic = 1 OR doc_id % 11 = 0 AS refused, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 10) / 10.0 END AS score FROM labels)"""


def kb_cases(spark, d):
    return v.read(spark, d, "labels").selectExpr("doc_id AS id", f"element_at(array({','.join(map(repr, TARGETS))}), CAST(1 + doc_id % 6 AS INT)) AS category", "CASE WHEN doc_id % 3 = 0 THEN 'held-out' ELSE 'development' END AS split", "element_at(array('easy', 'medium', 'hard'), CAST(1 + doc_id % 3 AS INT)) AS difficulty", "quality = 0 AS expect_refusal", "toxic = 1 OR doc_id % 11 = 0 AS refused", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 10) / CAST(10 AS DOUBLE) END AS score")


@query("agg_14_collection_progress", _CASES + """
;; SELECT category, count(*) AS total, count(*) FILTER (split = 'development') AS development, count(*) FILTER (split = 'held-out') AS held_out,
    CASE category """ + " ".join(f"WHEN '{k}' THEN {n}" for k, n in TARGETS.items()) + " END AS target FROM cases GROUP BY 1")
def progress(spark, d):
    by = kb_cases(spark, d).groupBy("category").pivot("split", ["development", "held-out"]).count().fillna(0)
    target = F.element_at(F.create_map(*(F.lit(x) for kv in TARGETS.items() for x in kv)), F.col("category"))
    return by.select("category", (F.col("development") + F.col("held-out")).alias("total"), "development", F.col("held-out").alias("held_out"), target.alias("target"))


SPLITS = {"development": 40, "held-out": 20}


@query("agg_15_readiness_issues", _CASES + f""",
  ct AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {n})" for k, n in TARGETS.items())}) t(category, target)),
  st AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {n})" for k, n in SPLITS.items())}) t(split, m)),
  c AS (SELECT category, any_value(target) AS target, count(id) AS n FROM ct LEFT JOIN cases USING (category) GROUP BY 1),
  s AS (SELECT split, any_value(m) AS m, count(id) AS n FROM st LEFT JOIN cases USING (split) GROUP BY 1)""" + """
;; SELECT 'REQUIRES_60_REVIEWED_QUESTIONS' AS issue FROM cases HAVING count(*) <> 60
  UNION ALL SELECT 'INSUFFICIENT_CATEGORY:' || category FROM c WHERE n < target
  UNION ALL SELECT CASE WHEN n > m THEN 'EXCESS' ELSE 'INSUFFICIENT' END || '_SPLIT:' || split || ':' || m FROM s WHERE n <> m""")
def readiness(spark, d):
    return ev.readiness_issues(kb_cases(spark, d), TARGETS, SPLITS)


@query("agg_16_aggregate_measurements", _CASES + ";; SELECT category, count(score) AS measured, count(*) - count(score) AS missing, round(avg(score), 6) AS mean FROM cases GROUP BY 1")
def measurements(spark, d):
    return kb_cases(spark, d).groupBy("category").agg(F.count("score").alias("measured"), F.count_if(F.col("score").isNull()).alias("missing"), F.round(F.avg("score"), 6).alias("mean"))


@query("agg_17_summary_by", _CASES + ";; SELECT category, difficulty, count(*) AS n, round(avg(score), 6) AS mean FROM cases GROUP BY GROUPING SETS ((), (category), (difficulty))")
def summary(spark, d):
    return kb_cases(spark, d).groupingSets([[], ["category"], ["difficulty"]], "category", "difficulty").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean")).select("category", "difficulty", "n", "mean")


@query("agg_18_answer_shares", """e AS (SELECT *, (attributes->>'$.k')::BIGINT AS k FROM kb_events WHERE event = 'purchase')
;; SELECT round(count(*) FILTER (k > 40)::DOUBLE / count(*), 6) AS grounded, round(count(*) FILTER (status = 'refused')::DOUBLE /
    count(*), 6) AS refused FROM e""")
def shares(spark, d):
    e = v.kb_events(spark, d).filter("event = 'purchase'").withColumn("k", F.get_json_object("attributes", "$.k").cast("long"))
    return e.agg(F.round(F.count_if(F.col("k") > 40) / F.count("*"), 6).alias("grounded"), F.round(F.count_if(F.col("status") == "refused") / F.count("*"), 6).alias("refused"))


@query("agg_19_readiness_status", """SELECT user_id, CASE WHEN bool_or(status = 'error' AND latency_ms > 90) THEN 'unhealthy' WHEN bool_or(status = 'error') THEN 'degraded'
    ELSE 'healthy' END AS status FROM kb_events GROUP BY 1""")
def health(spark, d):
    """A check is an event: a slow error is critical, any other error is not."""
    bad = F.col("status") == "error"
    return v.kb_events(spark, d).groupBy("user_id").agg(F.when(F.bool_or(bad & (F.col("latency_ms") > 90)), "unhealthy").when(F.bool_or(bad), "degraded").otherwise("healthy").alias("status"))


@query("agg_20_distinct_documents", "SELECT owner, count(DISTINCT document_id) AS documents FROM kb_jobs GROUP BY 1")
def distinct_documents(spark, d):
    return v.kb_jobs(spark, d).groupBy("owner").agg(F.count_distinct("document_id").alias("documents"))


@query("agg_21_batch_admission", """b AS (SELECT document_id, tenant, row_number() OVER w AS files, sum(byte_size * 20000) OVER w AS bytes
    FROM kb_documents WINDOW w AS (PARTITION BY tenant ORDER BY document_id ROWS UNBOUNDED PRECEDING))
;; SELECT document_id, files, bytes::BIGINT AS bytes, files <= 20 AND bytes <= 209715200 AS admitted FROM b""")
def batch_admission(spark, d):
    w = Window.partitionBy("tenant").orderBy("document_id").rowsBetween(Window.unboundedPreceding, 0)
    return v.kb_documents(spark, d).select("document_id", F.count("*").over(w).alias("files"), F.sum(F.col("byte_size") * 20000).over(w).alias("bytes")).withColumn("admitted", (F.col("files") <= 20) & (F.col("bytes") <= 200 * 1024 * 1024))


@query("win_01_rank_in_document", "SELECT chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY length(content) DESC, chunk_id) AS r FROM kb_chunks")
def rank(spark, d):
    return v.kb_chunks(spark, d).select("chunk_id", F.row_number().over(Window.partitionBy("document_id").orderBy(F.length("content").desc(), "chunk_id")).alias("r"))


@query("win_02_positions", "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 6) DESC, vec_id) AS position FROM embeddings")
def positions(spark, d):
    return v.kb_vectors(spark, d).select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy(F.round(F.col("embedding")[0].cast("double"), 6).desc(), "vec_id")).alias("position"))


@query("win_03_latest_job", "SELECT document_id, arg_max(job_id, job_id) AS job_id, arg_max(status, job_id) AS status FROM kb_jobs GROUP BY 1")
def latest(spark, d):
    return v.kb_jobs(spark, d).groupBy("document_id").agg(F.max("job_id").alias("job_id"), F.max_by("status", "job_id").alias("status"))


SLIDE = """s AS (SELECT event_id, user_id, ts, count(*) OVER w AS n_recent, min(ts) OVER w AS oldest
    FROM kb_events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 172800 SECOND PRECEDING AND CURRENT ROW))"""


@query("win_04_sliding_rate", SLIDE + ";; SELECT event_id, user_id, n_recent, n_recent > 5 AS over_limit FROM s")
def sliding(spark, d):
    """Two days and five events, as these events are sparse."""
    return ro.sliding_rate(v.kb_events(spark, d), 172800, ["user_id"]).select("event_id", "user_id", "n_recent", (F.col("n_recent") > 5).alias("over_limit"))


@query("win_05_retry_after", SLIDE + ";; SELECT event_id, greatest(1, ceil(172800 - (epoch_us(ts) - epoch_us(oldest)) / 1000000))::BIGINT AS retry_after FROM s WHERE n_recent > 5")
def retry(spark, d):
    return ro.sliding_rate(v.kb_events(spark, d), 172800, ["user_id"]).filter("n_recent > 5").select("event_id", ro.retry_after(172800).alias("retry_after"))


@query("win_06_fixed_window_rate", """s AS (SELECT event_id, user_id, ts, floor(epoch(ts))::BIGINT - floor(epoch(ts))::BIGINT % 86400 AS window_start FROM kb_events),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) AS request_count FROM s)
;; SELECT event_id, window_start, request_count, request_count <= 2 AS allowed, CASE WHEN request_count <= 2 THEN 0
    ELSE window_start + 86400 - floor(epoch(ts))::BIGINT END AS retry_after FROM r""")
def fixed(spark, d):
    return ro.fixed_window_rate(v.kb_events(spark, d), 86400, 2, "user_id").select("event_id", "window_start", "request_count", "allowed", "retry_after")


_states = "(['uploaded','validating','stored','processing','ready','failed','deleting'])[1 + (event_id * 5 + user_id) % 7]"


def _pairs() -> str:
    from quern.functions.policy import TRANSITIONS

    return ",".join(f"('{a}','{b}')" for a, bs in TRANSITIONS.items() for b in bs)


@query("win_07_illegal_transitions", f"""s AS (SELECT user_id, event_id, {_states} AS after, lag({_states}) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM kb_events)
;; SELECT user_id, event_id, before, after FROM s WHERE before <> after AND (before, after) NOT IN ({_pairs()})""")
def transitions(spark, d):
    log = v.kb_events(spark, d).selectExpr("user_id", "event_id", "element_at(array('uploaded','validating','stored','processing','ready','failed','deleting'), CAST(1 + (event_id * 5 + user_id) % 7 AS INT)) AS status")
    return ro.illegal_transitions(log, "user_id", "event_id").select("user_id", "event_id", "before", "after")


@query("win_08_stage_share", """SELECT user_id, event, round(sum(latency_ms), 4) AS ms, round(100 * sum(latency_ms) / greatest(sum(sum(latency_ms)) OVER (PARTITION BY user_id), 1), 4) AS share FROM kb_events GROUP BY 1, 2""")
def stage_share(spark, d):
    t = v.kb_events(spark, d).groupBy("user_id", "event").agg(F.sum("latency_ms").alias("ms"))
    return t.select("user_id", "event", F.round("ms", 4).alias("ms"), F.round(100 * F.col("ms") / F.greatest(F.sum("ms").over(Window.partitionBy("user_id")), F.lit(1)), 4).alias("share"))


MERGE = 's AS (SELECT DISTINCT l_orderkey AS key, l_partkey % 200 AS s, l_partkey % 200 + l_quantity::BIGINT AS e FROM lineitem), o AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o), u AS (SELECT key, min(s) AS "start", max(e) AS "end" FROM i GROUP BY key, island)'


def _spans(spark, d):
    return v.read(spark, d, "lineitem").selectExpr("l_orderkey AS key", "l_partkey % 200 AS start", "l_partkey % 200 + CAST(l_quantity AS BIGINT) AS end")


@query("win_10_merge_spans", MERGE + ';; SELECT key, "start", "end" FROM u')
def merge(spark, d):
    return ro.merge_spans(_spans(spark, d), ["key"])


@query("win_11_adjoining_runs", """g AS (SELECT document_id, page, chunk_index, chunk_index - row_number() OVER (PARTITION BY document_id, page ORDER BY chunk_index) AS island
    FROM kb_chunks WHERE chunk_version = version)
;; SELECT document_id, page, min(chunk_index) AS first, max(chunk_index) AS last, count(*) AS n FROM g GROUP BY document_id, page, island""")
def runs(spark, d):
    return ro.adjoining_runs(v.kb_chunks(spark, d).filter("chunk_version = version"), ["document_id", "page"], "chunk_index")


@query("win_13_char_budget", """p AS (SELECT document_id, page, sum(length(content)) AS n FROM kb_chunks GROUP BY 1, 2)
;; SELECT document_id, page, greatest(0, 5000 - coalesce(sum(n) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0))::BIGINT AS left_over FROM p""")
def budget(spark, d):
    w = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    p = v.kb_chunks(spark, d).groupBy("document_id", "page").agg(F.sum(F.length("content")).alias("n"))
    return p.select("document_id", "page", F.greatest(F.lit(0), 5000 - F.coalesce(F.sum("n").over(w), F.lit(0))).alias("left_over"))


@query("win_14_last_user_turns", """SELECT thread_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn DESC) AS r FROM kb_messages WHERE role = 'user')
    WHERE r <= 10""")
def last_turns(spark, d):
    w = Window.partitionBy("thread_id").orderBy(F.col("turn").desc())
    return v.kb_messages(spark, d).filter("role = 'user'").withColumn("r", F.row_number().over(w)).filter("r <= 10").select("thread_id", "turn", "text")


@query("win_15_latest_question", """SELECT thread_id, CASE WHEN length(trim(arg_max(text, turn))) = 0 OR length(arg_max(text, turn)) > 400 THEN NULL
    ELSE arg_max(text, turn) END AS question FROM kb_messages WHERE role = 'user' GROUP BY 1""")
def latest_question(spark, d):
    """A bound of 400 characters (4,000 in use), so that it binds here."""
    m = v.kb_messages(spark, d).filter("role = 'user'").groupBy("thread_id").agg(F.max_by("text", "turn").alias("q"))
    return m.select("thread_id", F.when((F.length(F.trim("q")) == 0) | (F.length("q") > 400), F.lit(None)).otherwise(F.col("q")).alias("question"))


@query("srt_01_order_limit", "SELECT event_id, latency_ms FROM kb_events ORDER BY latency_ms DESC, event_id LIMIT 60")
def ordered(spark, d):
    return v.kb_events(spark, d).orderBy(F.col("latency_ms").desc(), "event_id").limit(60).select("event_id", "latency_ms")


@query("srt_02_keyset_page", """SELECT document_id, created_at FROM kb_documents WHERE (created_at, document_id) < (TIMESTAMP '2024-01-01 08:00:00', 100000) ORDER BY created_at DESC, document_id DESC LIMIT 25""")
def keyset(spark, d):
    at = F.lit("2024-01-01 08:00:00").cast("timestamp")
    page = v.kb_documents(spark, d).filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("document_id") < 100000)))
    return page.orderBy(F.col("created_at").desc(), F.col("document_id").desc()).limit(25).select("document_id", "created_at")


@query("srt_03_newest_first", "SELECT thread_id, max(turn) AS last_turn FROM kb_messages GROUP BY 1 ORDER BY last_turn DESC, thread_id DESC LIMIT 50")
def newest(spark, d):
    return v.kb_messages(spark, d).groupBy("thread_id").agg(F.max("turn").alias("last_turn")).orderBy(F.col("last_turn").desc(), F.col("thread_id").desc()).limit(50)


@query("srt_04_claim_order", """c AS (SELECT greatest(0, 3 - count(*) FILTER (locked_at > TIMESTAMP '1998-11-01')) + 2 AS n FROM kb_jobs WHERE status = 'running'),
  j AS (SELECT job_id, available_at, row_number() OVER (ORDER BY available_at, job_id) AS r FROM kb_jobs WHERE status = 'queued')
;; SELECT job_id, r FROM j, c WHERE r <= least(n, 5)""")
def claim(spark, d):
    jobs = v.kb_jobs(spark, d)
    n = jobs.filter("status = 'running'").agg((F.greatest(F.lit(0), 3 - F.count_if(F.col("locked_at") > F.lit("1998-11-01").cast("timestamp"))) + 2).alias("n")).first().n
    first = jobs.filter("status = 'queued'").orderBy("available_at", "job_id").limit(min(n, 5))
    return first.select("job_id", F.row_number().over(Window.orderBy("available_at", "job_id")).alias("r"))


@query("srt_05_reading_order", "SELECT thread_id, string_agg(turn::VARCHAR || ':' || role, ' ' ORDER BY turn) AS sequence FROM kb_messages GROUP BY 1")
def reading(spark, d):
    m = v.kb_messages(spark, d).groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    return m.select("thread_id", F.array_join(F.transform("m", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])), " ").alias("sequence"))


RUN = """sim AS (SELECT q.query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.query_embedding::DOUBLE[]), 6) AS similarity, c.label = q.query_label AS rel FROM kb_questions q JOIN embeddings c ON c.vec_id <> q.query_id),
  run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS position FROM sim
    WHERE similarity >= -1) WHERE position <= 20),
  nrel AS (SELECT query_id, count(*) FILTER (rel) AS n FROM sim GROUP BY 1)"""


def _run(spark, d):
    """Questions, their twenty nearest vectors, those of these with the question's label, and how many vectors have it.

    Labels are counted, not joined: a question's total is its label's count without itself.
    """
    q, e = v.kb_questions(spark, d), v.kb_vectors(spark, d)
    c = e.selectExpr("vec_id AS chunk_id", "embedding", "label")
    found = rt.top(rt.similarities(q, c, -1.0, 21).filter("chunk_id <> query_id"), "similarity", 20)
    run = files.written(found.join(q.select("query_id", "query_label"), "query_id").select("query_id", "chunk_id", "position", "similarity", (F.col("label") == F.col("query_label")).alias("rel")))
    totals = q.select("query_id", F.col("query_label").alias("label")).join(e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant")), "label").filter("n_relevant > 0").select("query_id", "n_relevant")
    return q, run.drop("rel"), run.filter("rel").select("query_id", "chunk_id"), totals


def _metric(name: str, column: str, k: int, sql: str):
    @query(name, RUN + f""",
  m AS (SELECT query_id, count(*) FILTER (rel AND position <= {k}) AS hits,
    count(*) FILTER (position <= {k}) AS ret, min(position) FILTER (rel) AS fr, sum(CASE WHEN rel AND position <= {k} THEN 1 / log2(position + 1)
    ELSE 0 END) AS dcg FROM run GROUP BY 1)
;; SELECT query_id, round({sql}, 6) AS {column} FROM m JOIN nrel USING (query_id)""")
    def f(spark, d):
        q, run, relevant, totals = _run(spark, d)
        return ev.ranking_metrics(run, relevant, q, k, totals).select("query_id", column)

    return f


_metric("evl_01_recall_at_k", "recall", 10, "CASE WHEN n = 0 THEN 1 ELSE hits::DOUBLE / n END")
_metric("evl_02_precision_returned", "precision_returned", 5, "hits::DOUBLE / ret")
_metric("evl_03_precision_k", "precision_k", 5, "hits::DOUBLE / 5")
_metric("evl_04_reciprocal_rank", "reciprocal_rank", 20, "coalesce(1.0::DOUBLE / fr, 0)")
_metric("evl_05_ndcg_at_k", "ndcg", 10, "CASE WHEN n = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) END")


@query("jn_10_ranked_labels", RUN + ";; SELECT query_id, chunk_id, position, rel::INT AS relevant FROM run")
def labelled(spark, d):
    _, run, relevant, _ = _run(spark, d)
    return ev.judged(run, relevant)


@query("win_12_first_relevant_rank", RUN + ";; SELECT query_id, min(position) AS first_rank FROM run WHERE rel GROUP BY 1")
def first_rank(spark, d):
    _, run, relevant, _ = _run(spark, d)
    return ev.judged(run, relevant).filter("relevant = 1").groupBy("query_id").agg(F.min("position").alias("first_rank"))


@query("evl_06_citation_precision", RUN + ";; SELECT query_id, round(count(*) FILTER (rel)::DOUBLE / count(*), 6) AS precision FROM run WHERE position % 2 = 1 AND position <= 12 GROUP BY 1")
def citation_precision(spark, d):
    """The odd places of the first twelve are taken as cited."""
    _, run, relevant, _ = _run(spark, d)
    return ev.judged(run, relevant).filter("position % 2 = 1 AND position <= 12").groupBy("query_id").agg(F.round(F.avg("relevant"), 6).alias("precision"))


@query("evl_07_refusal_metrics", _CASES + """
;; SELECT round(count(*) FILTER (NOT refused)::DOUBLE / count(*), 6) AS answer_rate, round(count(*) FILTER (refused AND expect_refusal)::DOUBLE /
    count(*) FILTER (expect_refusal), 6) AS refusal_accuracy, round(count(*) FILTER (refused AND NOT expect_refusal)::DOUBLE /
    count(*) FILTER (NOT expect_refusal), 6) AS false_refusal_rate FROM cases""")
def refusals(spark, d):
    return ev.refusal_metrics(kb_cases(spark, d))


@query("evl_08_locate_chunk", r"""pg AS (SELECT document_id, page, string_agg(content, '' ORDER BY chunk_index) AS text FROM kb_chunks GROUP BY 1, 2),
  n AS (SELECT c.document_id, chunk_index, regexp_replace(lower(p.text), '\s+', '', 'g') AS p, regexp_replace(lower(c.content), '\s+', '', 'g') AS c
    FROM kb_chunks c JOIN pg p USING (document_id, page)),
  f AS (SELECT *, strpos(p, c) AS place FROM n)
;; SELECT document_id, chunk_index, CASE WHEN c <> '' AND place > 0 AND strpos(substr(p, place + 1), c) = 0 THEN place END AS position FROM f""")
def located(spark, d):
    """The place of a chunk in its page's text without white space, if it occurs once; a page holds two chunks."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    chunks = v.kb_chunks(spark, d).select("document_id", "page", "chunk_index", "content")
    pages = chunks.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("x")).select("document_id", "page", squeeze(F.array_join(F.transform("x", lambda e: e["content"]), "")).alias("p"))
    n = chunks.select("document_id", "page", "chunk_index", squeeze("content").alias("c")).join(pages, ["document_id", "page"]).withColumn("at", F.expr("position(c, p)"))
    once = (F.col("c") != "") & (F.col("at") > 0) & (F.expr("position(c, substring(p, at + 1))") == 0)
    return n.select("document_id", "chunk_index", F.when(once, F.col("at")).alias("position"))


@query("evl_09_span_coverage", MERGE + ', g AS (SELECT DISTINCT l_orderkey AS key, l_suppkey % 200 AS s, l_suppkey % 200 + 10 AS e FROM lineitem);; SELECT key, count(*) AS spans, count(*) FILTER (c) AS covered FROM (SELECT g.key, g.s, g.e, bool_or(coalesce(u."start" <= g.s AND u."end" >= g.e, false)) AS c FROM g LEFT JOIN u USING (key) GROUP BY 1, 2, 3) GROUP BY 1')
def coverage(spark, d):
    gold = v.read(spark, d, "lineitem").selectExpr("l_orderkey AS key", "l_suppkey % 200 AS start", "l_suppkey % 200 + 10 AS end").distinct()
    return ev.span_coverage(gold, _spans(spark, d))


@query("evl_10_retrieval_metrics", RUN + """
;; SELECT q.query_id, CASE WHEN n = 0 THEN 'skipped' ELSE 'measured' END AS status, CASE WHEN n > 0 THEN round(count(*) FILTER (rel
    AND position <= 10)::DOUBLE / n, 6) END AS value FROM kb_questions q JOIN nrel USING (query_id) LEFT JOIN run USING (query_id)
    GROUP BY q.query_id, n""")
def retrieval_metrics(spark, d):
    q, run, relevant, totals = _run(spark, d)
    m = ev.ranking_metrics(run, relevant, q, 10, totals).join(totals.select("query_id", F.lit(True).alias("has")), "query_id", "left")
    return m.select("query_id", F.when(F.col("has"), "measured").otherwise("skipped").alias("status"), F.when(F.col("has"), F.col("recall")).alias("value"))


@query("evl_11_answer_metrics", _CASES + """
;; SELECT id, CASE WHEN expect_refusal THEN NULL ELSE refused::INT END AS false_refusal, CASE
    WHEN expect_refusal THEN refused::INT END AS refusal_accuracy FROM cases""")
def answer_metrics(spark, d):
    return kb_cases(spark, d).select("id", F.when(~F.col("expect_refusal"), F.col("refused").cast("int")).alias("false_refusal"), F.when(F.col("expect_refusal"), F.col("refused").cast("int")).alias("refusal_accuracy"))


@query("evl_12_supporting_documents", RUN + """
;; SELECT query_id, count(DISTINCT chunk_id % 60) FILTER (rel AND position <= 10) AS found, (SELECT count(DISTINCT s.chunk_id % 60) FROM sim s
    WHERE s.query_id = run.query_id AND s.rel) AS needed FROM run GROUP BY 1""")
def supporting(spark, d):
    """Documents are counted by label; a question's own counts only if another vector of its label is in it."""
    q, run, relevant, _ = _run(spark, d)
    doc = lambda c: F.col(c) % 60
    held = v.kb_vectors(spark, d).groupBy("label", doc("vec_id").alias("doc")).agg(F.count("*").alias("n"))
    alone = q.select("query_id", F.col("query_label").alias("label"), doc("query_id").alias("doc")).join(held, ["label", "doc"]).select("query_id", "label", (F.col("n") == 1).cast("int").alias("alone"))
    needed = alone.join(held.groupBy("label").agg(F.count("*").alias("docs")), "label").select("query_id", (F.col("docs") - F.col("alone")).alias("needed"))
    found = ev.judged(run, relevant).groupBy("query_id").agg(F.count_distinct(F.when((F.col("relevant") == 1) & (F.col("position") <= 10), doc("chunk_id"))).alias("found"))
    return found.join(needed, "query_id").select("query_id", "found", "needed")


@query("evl_13_evaluation_report", _CASES + """
;; SELECT category, count(*) AS n, round(avg(refused::INT), 6) AS refused, round(avg(score), 6) AS score FROM cases
    GROUP BY GROUPING SETS ((), (category))""")
def report(spark, d):
    return kb_cases(spark, d).groupingSets([[], ["category"]], "category").agg(F.count("*").alias("n"), F.round(F.avg(F.col("refused").cast("int")), 6).alias("refused"), F.round(F.avg("score"), 6).alias("score")).select("category", "n", "refused", "score")


@query("evl_14_validate_cases", _CASES + """,
  dup AS (SELECT id % 150 AS id FROM cases GROUP BY 1 HAVING count(*) > 1)
;; SELECT id, 'DUPLICATE_ID' AS violation FROM dup
  UNION ALL SELECT id, 'CONTRADICTION' FROM cases WHERE expect_refusal AND score > 0.5
  UNION ALL SELECT id, 'UNKNOWN_LABEL' FROM cases WHERE id NOT IN (SELECT vec_id FROM embeddings)""")
def validated(spark, d):
    cases = kb_cases(spark, d)
    dup = cases.groupBy((F.col("id") % 150).alias("id")).count().filter("count > 1").select("id", F.lit("DUPLICATE_ID").alias("violation"))
    both = cases.filter("expect_refusal AND score > 0.5").select("id", F.lit("CONTRADICTION").alias("violation"))
    none = cases.join(v.kb_vectors(spark, d).selectExpr("vec_id AS id"), "id", "left_anti").select("id", F.lit("UNKNOWN_LABEL").alias("violation"))
    return dup.unionByName(both).unionByName(none)


# Floors and ceilings of the quality gate.
THRESHOLDS = [("recall_at_5", "min", 0.8), ("recall_at_10", "min", 0.9), ("mrr", "min", 0.7), ("ndcg_at_10", "min", 0.7), ("evidence_precision", "min", 0.3), ("cases", "min", 13.0), ("false_refusal_rate", "max", 0.15)]


@query("evl_15_threshold_gate", RUN + """,
  m AS (SELECT query_id, count(*) FILTER (rel AND position <= 5) AS h5, count(*) FILTER (rel
    AND position <= 10) AS h10, min(position) FILTER (rel) AS fr FROM run GROUP BY 1),
  a AS (SELECT avg(CASE WHEN n = 0 THEN 1 ELSE h5::DOUBLE / n END) AS r5, avg(CASE WHEN n = 0 THEN 1
    ELSE h10::DOUBLE / n END) AS r10, avg(coalesce(1.0::DOUBLE / fr, 0)) AS mrr, count(*) AS cases FROM m JOIN nrel USING (query_id)),
  u AS (SELECT 'recall_at_5' AS metric, r5 AS value, 0.8 AS threshold FROM a
  UNION ALL SELECT 'recall_at_10', r10, 0.9 FROM a
  UNION ALL SELECT 'mrr', mrr, 0.7 FROM a
  UNION ALL SELECT 'cases', cases, 13 FROM a)
;; SELECT metric, round(value, 5) AS value, threshold::DOUBLE AS threshold FROM u WHERE value < threshold""")
def threshold(spark, d):
    q, run, relevant, totals = _run(spark, d)
    m5, m10 = (ev.ranking_metrics(run, relevant, q, k, totals) for k in (5, 10))
    a = m5.select("query_id", F.col("recall").alias("recall_at_5")).join(m10.select("query_id", F.col("recall").alias("recall_at_10"), F.col("reciprocal_rank").alias("mrr")), "query_id").agg(F.avg("recall_at_5").alias("recall_at_5"), F.avg("recall_at_10").alias("recall_at_10"), F.avg("mrr").alias("mrr"), F.count("*").cast("double").alias("cases"))
    metrics = a.unpivot([], ["recall_at_5", "recall_at_10", "mrr", "cases"], "metric", "value")
    return ev.threshold_gate(metrics, THRESHOLDS).select("metric", F.round("value", 5).alias("value"), "threshold")


ASKED = """qs AS (SELECT thread_id * 100 + turn AS id, CASE WHEN (thread_id + turn) % 3 = 0 THEN 'held-out' ELSE 'development' END AS split, text
    FROM kb_messages
  UNION ALL SELECT thread_id * 100 + turn + 50, CASE WHEN (thread_id + turn) % 3 = 0 THEN 'development' ELSE 'held-out' END, CASE
    WHEN thread_id % 10 = 0 THEN upper(replace(text, 'ß', 'SS')) ELSE text || ' please' END FROM kb_messages WHERE thread_id % 5 = 0)"""
LEAK = ASKED + r""",
  q AS (SELECT id, split, list_distinct(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS w FROM qs),
  e AS (SELECT id, split, len(w) AS n, unnest(w) AS t FROM q WHERE w[1] <> ''),
  p AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.t = b.t AND a.split < b.split
    GROUP BY 1, 2)"""


@query("evl_16_split_leakage", LEAK + ";; SELECT a, b, round(c::DOUBLE / (na + nb - c), 6) AS similarity FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.8")
def leakage(spark, d):
    return ev.split_leakage(_split(spark, d))


def _split(spark, d):
    """Questions of two splits: the messages, and for one thread in five each message once more in the other split, in capitals or with a word more."""
    m = v.kb_messages(spark, d)
    more = m.filter("thread_id % 5 = 0").selectExpr("thread_id * 100 + turn + 50 AS id", "CASE WHEN (thread_id + turn) % 3 = 0 THEN 'development' ELSE 'held-out' END AS split", "CASE WHEN thread_id % 10 = 0 THEN upper(text) ELSE concat(text, ' please') END AS text")
    return m.selectExpr("thread_id * 100 + turn AS id", "CASE WHEN (thread_id + turn) % 3 = 0 THEN 'held-out' ELSE 'development' END AS split", "text").unionByName(more)


@query("evl_16_leakage_checks", ASKED + r""",
  t AS (SELECT id, split, 'g' || (id // 100) % 40 AS grp, id // 100 AS document_id, id % 50 * 10 AS s, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS n FROM qs)

;; SELECT 'DUPLICATE_QUESTION_TEXT' AS violation, min(id)::VARCHAR AS key, count(*) AS questions FROM t GROUP BY n HAVING count(*) > 1
  UNION ALL SELECT 'CROSS_SPLIT_LEAKAGE_GROUP', grp, count(*) FROM t GROUP BY grp HAVING count(DISTINCT split) > 1

  UNION ALL SELECT 'CROSS_SPLIT_SUPPORT_OVERLAP', a.document_id::VARCHAR, count(DISTINCT a.id) FROM t a JOIN t b ON a.document_id = b.document_id
    AND a.split <> b.split AND greatest(a.s, b.s) < least(a.s + 15, b.s + 15) GROUP BY a.document_id""")
def leakage_checks(spark, d):
    """A thread stands for a document, and forty groups of threads for leakage groups; each question has a span of fifteen characters."""
    q = _split(spark, d).selectExpr("id", "split", "text", "concat('g', id DIV 100 % 40) AS leakage_group", "id DIV 100 AS document_id", "1 AS page", "id % 50 * 10 AS start", "id % 50 * 10 + 15 AS end")
    return ev.leakage_checks(q)


@query("jn_08_cross_split_pairs", LEAK + ";; SELECT a, b FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.6")
def cross_split(spark, d):
    return ev.split_leakage(_split(spark, d), 0.6).select("a", "b")


@query("evl_17_integrity_check", """SELECT 'DUPLICATE_DOCUMENT_CONTENT' AS violation, min(document_id) AS id FROM kb_documents GROUP BY content_hash HAVING count(*) > 1
  UNION ALL SELECT 'SOURCE_SPAN_MISMATCH', chunk_id FROM kb_chunks c JOIN kb_documents d USING (document_id)
    WHERE substr(d.text, (chunk_index * 1000 + CASE WHEN chunk_id % 9 = 0 THEN 2 ELSE 1 END)::BIGINT, 1000) <> content""")
def integrity(spark, d):
    docs = v.kb_documents(spark, d)
    dup = docs.groupBy("content_hash").agg(F.min("document_id").alias("id"), F.count("*").alias("n")).filter("n > 1").select(F.lit("DUPLICATE_DOCUMENT_CONTENT").alias("violation"), "id")
    # one chunk in nine is held against its document's text a character further on
    source = docs.select("document_id", F.posexplode(F.arrays_zip(windows("text").alias("at"), windows(F.expr("substring(text, 2)")).alias("next"))).alias("chunk_index", "w")).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("w.at").alias("at"), F.coalesce("w.next", F.lit("")).alias("next"))
    c = v.kb_chunks(spark, d).select("chunk_id", "document_id", "chunk_index", "content").join(source, ["document_id", "chunk_index"])
    bad = c.filter(F.col("content") != F.when(F.col("chunk_id") % 9 == 0, F.col("next")).otherwise(F.col("at"))).select(F.lit("SOURCE_SPAN_MISMATCH").alias("violation"), F.col("chunk_id").alias("id"))
    return dup.unionByName(bad)
