"""Queries of scans, filters, joins, scalar functions and set operations."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import policy as po
from quern.functions import text as tx
from quern.functions import vectors as vx
from quern.operators import rollups as ro
from quern.operators.rollups import overlapping
from quern.plans.registry import query
from quern.sources import files
from quern.sources import views as v
from quern.sources.files import new_folder

_ext = lambda c: f"lower(list_last(string_split({c}, '.')))"
_exts = "(" + ",".join(f"'{e}'" for e in tx.EXTENSIONS) + ")"
_formats = " ".join(f"WHEN ext IN ({','.join(repr(e) for e in es)}) AND (mime IS NULL OR mime = '' OR mime = 'application/octet-stream' OR mime IN ({','.join(repr(m) for m in ms)})) THEN '{n}'" for n, (ms, es) in tx.FORMATS.items())


@query("src_01_scan_chunks", "SELECT chunk_id, document_id, chunk_index, page, length(content) AS n_chars, chunk_version, model FROM kb_chunks")
def chunks(spark, d):
    return v.kb_chunks(spark, d).selectExpr("chunk_id", "document_id", "chunk_index", "page", "length(content) AS n_chars", "chunk_version", "model")


@query("src_02_scan_documents", """SELECT document_id, filename, status, r.job_id FROM kb_documents LEFT JOIN (SELECT document_id, max(job_id) AS job_id FROM kb_jobs
    WHERE status = 'running' GROUP BY 1) r USING (document_id) WHERE tenant = 'src1' ORDER BY created_at DESC LIMIT 50""")
def listing(spark, d):
    running = v.kb_jobs(spark, d).filter("status = 'running'").groupBy("document_id").agg(F.max("job_id").alias("job_id"))
    return v.kb_documents(spark, d).filter("tenant = 'src1'").orderBy(F.col("created_at").desc()).limit(50).join(running, "document_id", "left").select("document_id", "filename", "status", "job_id")


@query("src_04_extract_html", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(html, 1, 200000), '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '\s{2,}', ' ', 'g')) AS text FROM pages""")
def html(spark, d):
    return v.read(spark, d, "pages").select("page_id", tx.extract_html("html").alias("text"))


@query("src_05_json_attr", "SELECT event_id, (attributes->>'$.k')::BIGINT AS k, (attributes->>'$.none') AS missing FROM kb_events")
def attr(spark, d):
    return v.kb_events(spark, d).select("event_id", F.get_json_object("attributes", "$.k").cast("long").alias("k"), F.get_json_object("attributes", "$.none").alias("missing"))


@query("src_07_upsert_chunks", """n AS (SELECT document_id, chunk_index, 'new ' || content AS content FROM kb_chunks WHERE document_id % 3 = 0),
  o AS (SELECT document_id, chunk_index, content FROM kb_chunks WHERE document_id % 2 = 0)
;; SELECT * FROM n
  UNION ALL SELECT * FROM o ANTI JOIN n USING (document_id, chunk_index)""")
def upserted(spark, d):
    c = v.kb_chunks(spark, d).select("document_id", "chunk_index", "content")
    return ro.upsert(c.filter("document_id % 2 = 0"), c.filter("document_id % 3 = 0").withColumn("content", F.concat(F.lit("new "), "content")), ["document_id", "chunk_index"])


@query("src_10_route_format", f"""t AS (SELECT document_id, {_ext('filename')} AS ext, CASE document_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'application/octet-stream'
    WHEN 2 THEN 'text/plain' ELSE 'application/pdf' END AS mime FROM kb_documents)
;; SELECT document_id, CASE {_formats} END AS format FROM t""")
def routed(spark, d):
    mime = F.expr("CASE document_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN ' Text/Plain; charset=utf-8' ELSE 'application/pdf' END")
    return v.kb_documents(spark, d).select("document_id", tx.route_format("filename", mime).alias("format"))


@query("src_11_content_fingerprint", "SELECT document_id, content_hash FROM kb_documents")
def hashes(spark, d):
    return v.kb_documents(spark, d).select("document_id", "content_hash")


@query("src_12_vector_literal", "SELECT vec_id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS total, embedding[64]::DOUBLE AS last FROM embeddings")
def literals(spark, d):
    """Vectors written as literals and read from them again."""
    back = F.from_json(vx.literal(F.col("embedding")), "array<float>")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return v.kb_vectors(spark, d).select("vec_id", back.alias("v")).select("vec_id", F.size("v").alias("dim"), F.round(total, 4).alias("total"), F.element_at("v", 64).cast("double").alias("last"))


@query("src_13_validate_upload", f"""u AS (SELECT document_id, CASE WHEN document_id % 17 = 0 THEN 0 WHEN document_id % 19 = 0 THEN 30000000
    ELSE byte_size END AS size, byte_size AS reserved, content_hash AS h, CASE WHEN document_id % 13 = 0 THEN 'x'
    ELSE content_hash END AS rh, {_ext('filename')} <> 'html' AS typed FROM kb_documents)
;; SELECT document_id, CASE WHEN size < 1 THEN 'EMPTY_FILE' WHEN size > 26214400 THEN 'TOO_LARGE' WHEN NOT typed THEN 'BAD_CONTENT_TYPE'
    WHEN size <> reserved THEN 'SIZE_MISMATCH' WHEN h <> rh THEN 'HASH_MISMATCH' ELSE 'ok' END AS verdict FROM u""")
def uploads(spark, d):
    u = v.kb_documents(spark, d).withColumn("size", F.expr("CASE WHEN document_id % 17 = 0 THEN 0 WHEN document_id % 19 = 0 THEN 30000000 ELSE byte_size END")).withColumn("rh", F.expr("CASE WHEN document_id % 13 = 0 THEN 'x' ELSE content_hash END"))
    return u.select("document_id", po.validate_upload(F.col("size"), F.col("byte_size"), F.col("content_hash"), F.col("rh"), tx.extension_of("filename") != "html").alias("verdict"))


@query("src_03_read_text_files", "SELECT doc_id // 100 AS part, sum(length(text) + 1)::BIGINT AS n_chars, NULL::VARCHAR AS problem FROM documents GROUP BY 1")
def text_files(spark, d):
    """The documents' texts, written as text files of a hundred each and read back whole."""
    path = new_folder(spark)
    v.kb_documents(spark, d).selectExpr("document_id DIV 100 AS part", "text").repartition("part").write.partitionBy("part").text(path)
    return files.read_text_files(spark, f"{path}/*/*").select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part"), F.length("text").cast("long").alias("n_chars"), "problem")


@query("src_03_read_text_lines", "SELECT doc_id // 100 AS part, sum(length(text) + 1)::BIGINT AS n_chars, NULL::VARCHAR AS problem FROM documents GROUP BY 1")
def text_lines(spark, d):
    """The same files, read by byte ranges."""
    path = new_folder(spark)
    v.kb_documents(spark, d).selectExpr("document_id DIV 100 AS part", "text").repartition("part").write.partitionBy("part").text(path)
    report = files.text_file_report(files.read_text_lines(spark, f"{path}/*/*"))
    return report.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part"), "n_chars", "problem")


@query("src_06_load_gold_manifest", """q AS (SELECT item_id // 10 AS part, item_id % 39 AS id, item_id * 53 % 1500 AS document_id FROM benchmark),
  a AS (SELECT DISTINCT part, document_id, content_hash FROM q JOIN kb_documents USING (document_id))

;; SELECT 'DUPLICATE_QUESTION_ID' AS violation, id::VARCHAR AS id FROM q GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'DUPLICATE_DOCUMENT_ID', document_id::VARCHAR FROM a GROUP BY 2 HAVING count(*) > 1

  UNION ALL SELECT 'DUPLICATE_DOCUMENT_CONTENT', content_hash FROM a GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'UNKNOWN_DOCUMENT', q.id::VARCHAR FROM q ANTI JOIN a USING (document_id)""")
def manifest(spark, d):
    """Gold manifests of ten of the benchmark's passages each as questions, supported by a document each, written as JSON and loaded."""
    path = new_folder(spark)
    asked = v.read(spark, d, "benchmark").selectExpr("item_id DIV 10 AS part", "item_id % 39 AS id", "item_id * 53 % 1500 AS document_id", "text")
    held = asked.select("part", "document_id").distinct().join(v.kb_documents(spark, d).select("document_id", "filename", "content_hash"), "document_id")
    docs = held.groupBy("part").agg(F.collect_list(F.struct(F.col("document_id").cast("string").alias("id"), F.col("filename").alias("file"), F.col("content_hash").alias("sha256"))).alias("documents"))
    span = F.array(F.struct(F.col("document_id").cast("string").alias("documentId"), F.lit(1).alias("page"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.substring("text", 1, 9).alias("quote")))
    questions = asked.groupBy("part").agg(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), F.col("text").alias("question"), F.lit("exact").alias("category"), span.alias("supportingSpans"))).alias("questions"))
    questions.join(docs, "part", "left").withColumn("kind", F.lit("real")).write.partitionBy("part").json(path)
    return files.load_gold_manifest(spark, f"{path}/*")[1]


@query("src_08_append_events", "SELECT event_id, event, status FROM kb_events")
def appended(spark, d):
    path = new_folder(spark)
    e = v.kb_events(spark, d).select("event_id", "event", "status")
    files.append_events(e.filter("event = 'error'"), path)
    files.append_events(e.filter("event <> 'error'"), path)
    return spark.read.parquet(path)


@query("src_09_write_report", "SELECT event, count(*) AS n FROM kb_events GROUP BY 1")
def reported(spark, d):
    path = new_folder(spark)
    files.write_report(v.kb_events(spark, d).groupBy("event").agg(F.count("*").alias("n")), path)
    return spark.read.schema("event string, n long").json(path)


@query("src_14_magic_bytes", "SELECT document_id, document_id % 3 = 0 AS is_pdf FROM kb_documents")
def magic(spark, d):
    content = F.encode(F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), "text")).otherwise(F.col("text")), "UTF-8")
    return v.kb_documents(spark, d).select("document_id", files.has_pdf_magic(content).alias("is_pdf"))


@query("src_15_clip_extraction", """t AS (SELECT document_id, page, least(sum(length(content)), 1500) AS n FROM kb_chunks GROUP BY 1, 2),
  b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
;; SELECT document_id, page, greatest(0, least(n, 6000 - before))::BIGINT AS kept FROM b""")
def clipped(spark, d):
    """Caps of 1,500 characters a page and 6,000 in all (smaller than in use, so that they bind here)."""
    w = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    t = v.kb_chunks(spark, d).groupBy("document_id", "page").agg(F.least(F.sum(F.length("content")), F.lit(1500)).alias("n"))
    return t.select("document_id", "page", F.greatest(F.lit(0), F.least(F.col("n"), 6000 - F.coalesce(F.sum("n").over(w), F.lit(0)))).cast("long").alias("kept"))


@query("src_16_dataset_fingerprint", """r AS (SELECT doc_id AS k, sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') AS h FROM labels),
  a AS (SELECT k // 4096 AS k, sha256(string_agg(h, '' ORDER BY k, h)) AS h FROM r GROUP BY 1),
  b AS (SELECT k // 4096 AS k, sha256(string_agg(h, '' ORDER BY k, h)) AS h FROM a GROUP BY 1)

;; SELECT sha256(string_agg(h, '' ORDER BY k, h)) AS fingerprint, (SELECT count(*) FROM labels) AS n FROM b""")
def dataset_hash(spark, d):
    return ro.fingerprint(v.read(spark, d, "labels"), "doc_id")


@query("flt_01_tenant_scope", "SELECT tenant, count(*) AS n FROM kb_chunks WHERE tenant IN ('src1', 'src2') GROUP BY 1")
def tenant(spark, d):
    return v.kb_chunks(spark, d).filter(F.col("tenant").isin("src1", "src2")).groupBy("tenant").agg(F.count("*").alias("n"))


@query("flt_02_visible_chunks", """SELECT chunk_id, document_id, chunk_index FROM kb_chunks WHERE status = 'ready' AND chunk_version = version AND model = 'm2'
    AND (filename NOT LIKE '%.pptx' OR parser_version >= 2)""")
def visible(spark, d):
    return visible_chunks(v.kb_chunks(spark, d), "m2").select("chunk_id", "document_id", "chunk_index")


def visible_chunks(chunks, model: str):
    """Chunks that may be searched: ready, of the document's version and the model, slides only of a parser that keeps their order."""
    return chunks.filter((F.col("status") == "ready") & (F.col("chunk_version") == F.col("version")) & (F.col("model") == model) & (~F.endswith("filename", F.lit(".pptx")) | (F.col("parser_version") >= 2)))


@query("flt_03_document_scope", "SELECT chunk_id FROM kb_chunks WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def scope(spark, d):
    return v.kb_chunks(spark, d).join(v.read(spark, d, "labels").filter("quality = 1").selectExpr("doc_id AS document_id"), "document_id", "left_semi").select("chunk_id")


@query("flt_04_similarity_floor", """SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE
    round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) >= 0.25""")
def floor(spark, d):
    from quern.operators.retrieval import similarities

    e = v.kb_vectors(spark, d)
    return similarities(e.filter("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS query_embedding"), e.selectExpr("vec_id", "embedding")).select("query_id", "vec_id", "similarity")


@query("flt_05_list_traces", """t AS (SELECT event_id, ts, (attributes->>'$.k')::BIGINT AS k FROM kb_events ORDER BY ts DESC, event_id LIMIT 100)
;; SELECT event_id, k FROM t WHERE k > 50""")
def traces(spark, d):
    return v.kb_events(spark, d).orderBy(F.col("ts").desc(), "event_id").limit(100).withColumn("k", F.get_json_object("attributes", "$.k").cast("long")).filter("k > 50").select("event_id", "k")


@query("flt_06_list_events", "SELECT event_id, event, status FROM kb_events WHERE event = 'error' ORDER BY ts DESC, event_id LIMIT 200")
def events(spark, d):
    return v.kb_events(spark, d).filter("event = 'error'").orderBy(F.col("ts").desc(), "event_id").limit(200).select("event_id", "event", "status")


@query("flt_07_reindex_candidates", """SELECT document_id FROM kb_documents WHERE status <> 'deleting' AND model IS DISTINCT FROM 'm2' AND document_id NOT IN (SELECT document_id
    FROM kb_jobs WHERE status IN ('queued', 'running', 'retrying') AND available_at >= TIMESTAMP '1998-01-01')""")
def reindex(spark, d):
    """Jobs that have waited since before 1998 are taken as given up."""
    live = v.kb_jobs(spark, d).filter("status IN ('queued', 'running', 'retrying') AND available_at >= timestamp'1998-01-01'").select("document_id").distinct()
    return v.kb_documents(spark, d).filter("status <> 'deleting' AND NOT model <=> 'm2'").join(live, "document_id", "left_anti").select("document_id")


@query("flt_08_due_jobs", """SELECT job_id FROM kb_jobs WHERE ((status IN ('queued', 'retrying') AND available_at <= TIMESTAMP '1996-06-01') OR (status = 'running'
    AND (locked_at IS NULL OR locked_at < TIMESTAMP '1996-06-01' - INTERVAL 300 SECOND))) AND attempt_count < 4""")
def due(spark, d):
    return ro.due_jobs(v.kb_jobs(spark, d), F.lit("1996-06-01").cast("timestamp")).select("job_id")


@query("flt_09_prune_expired", "SELECT event_id FROM kb_events WHERE ts >= (SELECT max(ts) FROM kb_events) - INTERVAL 60 MINUTE")
def pruned(spark, d):
    return ro.since(v.kb_events(spark, d), 60).select("event_id")


@query("flt_10_prune_stale_chunks", "SELECT chunk_id FROM kb_chunks WHERE chunk_version = version AND chunk_index <= 3")
def stale(spark, d):
    return v.kb_chunks(spark, d).filter("chunk_version = version AND chunk_index <= 3").select("chunk_id")


# Keys that may not carry content.
FORBIDDEN = r"(?i)^(password|secret|api_?key|authorization|cookie|bearer|token|email|prompt|question|answer|content|body|snippet|passage|evidence|chunk)$|(_|^)(text|preview|snippet|passage|content|body|prompt|secret|password|email)$"
REDACTED = r"(?i)content|snippet|filename|question|answer|prompt|text|preview"


def sanitize(attributes, cut: int = 120):
    """A map without forbidden keys, values cut, numbers that aren't finite as null."""
    kept = F.map_filter(attributes, lambda k, _: ~F.rlike(k, F.lit(FORBIDDEN)))
    return F.transform_values(kept, lambda _, x: F.when(x.isin("NaN", "Infinity", "-Infinity"), F.lit(None).cast("string")).otherwise(F.substring(x, 1, cut)))


@query("flt_11_sanitize_attributes", """SELECT event_id, ['k', 'note', 'rate'] AS keys, least(60 * length(event), 120) AS note_length, CASE WHEN event_id % 5 <> 0 THEN '1' END AS rate
    FROM kb_events""")
def sanitized(spark, d):
    m = F.create_map(F.lit("k"), F.get_json_object("attributes", "$.k"), F.lit("prompt"), F.lit("secret words"), F.lit("user_text"), F.col("event"), F.lit("note"), F.repeat("event", F.lit(60)), F.lit("rate"), F.when(F.col("event_id") % 5 == 0, "NaN").otherwise("1"))
    return v.kb_events(spark, d).select("event_id", sanitize(m).alias("m")).selectExpr("event_id", "map_keys(m) AS keys", "length(m['note']) AS note_length", "m['rate'] AS rate")


@query("flt_12_redact_trace", """SELECT event_id, '{"event":"' || event || '","stage":{"ms":1,"items":[{"score":"' || status || '"}]}}' AS trace FROM kb_events""")
def redacted(spark, d):
    trace = F.to_json(F.struct("event", F.struct(F.lit(1).alias("ms"), F.col("attributes").alias("content"), F.array(F.struct(F.col("status").alias("score"), F.col("event").alias("snippet"))).alias("items")).alias("stage"), F.col("attributes").alias("question")))
    return v.kb_events(spark, d).select("event_id", redact_json(trace).alias("trace"))


def redact_json(c):
    """JSON text without the keys that name content, at any depth; null where the text is no JSON."""
    bad = re.compile(REDACTED)

    def clean(x):
        if isinstance(x, list):
            return [clean(y) for y in x]
        return {k: clean(y) for k, y in x.items() if not bad.search(k)} if isinstance(x, dict) else x

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(clean(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(c)


@query("flt_13_usable_fragment", r"SELECT document_id, chunk_index, regexp_matches(regexp_replace(content, '[a-z ]+', '', 'g'), '[\p{L}\p{N}]') AS usable FROM kb_chunks")
def usable(spark, d):
    """The fragments are what is left of chunks without the letters from a to z and spaces."""
    return v.kb_chunks(spark, d).select("document_id", "chunk_index", tx.usable(F.regexp_replace("content", "[a-z ]+", "")).alias("usable"))


@query("flt_14_ocr_suspect", """p AS (SELECT document_id, page, sum(length(content)) AS n FROM kb_chunks GROUP BY 1, 2),
  t AS (SELECT document_id, sum(n)::BIGINT AS total, count(*) AS pages FROM p GROUP BY 1)
;; SELECT document_id, CASE WHEN total = 0 THEN 'NO_TEXT' WHEN total / pages < 100 AND total < 500 THEN 'OCR_SUSPECT' ELSE 'ok' END AS verdict FROM t""")
def ocr(spark, d):
    pages = v.kb_chunks(spark, d).groupBy("document_id", "page").agg(F.sum(F.length("content")).alias("n"))
    t = pages.groupBy("document_id").agg(F.sum("n").alias("total"), F.count("*").alias("pages"))
    return t.select("document_id", F.when(F.col("total") == 0, "NO_TEXT").when((F.col("total") / F.col("pages") < 100) & (F.col("total") < 500), "OCR_SUSPECT").otherwise("ok").alias("verdict"))


@query("jn_01_chunk_document", "SELECT c.chunk_id, d.filename, d.lang FROM kb_chunks c JOIN kb_documents d USING (document_id)")
def chunk_document(spark, d):
    return v.kb_chunks(spark, d).select("chunk_id", "document_id").join(v.kb_documents(spark, d).select("document_id", "filename", "lang"), "document_id").select("chunk_id", "filename", "lang")


@query("jn_02_query_chunks", """SELECT query_id, count(*) AS n, round(max(list_cosine_similarity(embedding::DOUBLE[], query_embedding::DOUBLE[])), 6) AS best
    FROM kb_corpus, kb_questions GROUP BY 1""")
def query_chunks(spark, d):
    from quern.operators.retrieval import similarity_summary

    return similarity_summary(v.kb_questions(spark, d), v.kb_corpus(spark, d))


@query("jn_04_documents_running_job", """SELECT document_id, j.job_id FROM kb_documents LEFT JOIN (SELECT document_id, max(job_id) AS job_id FROM kb_jobs WHERE status = 'running'
    GROUP BY 1) j USING (document_id)""")
def running(spark, d):
    j = v.kb_jobs(spark, d).filter("status = 'running'").groupBy("document_id").agg(F.max("job_id").alias("job_id"))
    return v.kb_documents(spark, d).select("document_id").join(j, "document_id", "left")


@query("jn_05_role_semi_join", "SELECT job_id, owner FROM kb_jobs WHERE owner IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def roles(spark, d):
    return v.kb_jobs(spark, d).select("job_id", "owner").join(v.read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS owner"), "owner", "left_semi").select("job_id", "owner")


@query("jn_06_no_live_job", """SELECT document_id FROM kb_documents ANTI JOIN (SELECT document_id FROM kb_jobs WHERE status IN ('queued', 'running', 'retrying')
    AND available_at >= TIMESTAMP '1998-01-01') USING (document_id)""")
def idle(spark, d):
    return v.kb_documents(spark, d).select("document_id").join(v.kb_jobs(spark, d).filter("status IN ('queued', 'running', 'retrying') AND available_at >= timestamp'1998-01-01'").select("document_id"), "document_id", "left_anti")


SPANS = """a AS (SELECT l_orderkey AS doc, l_linenumber AS id, l_partkey % 100 AS s, l_partkey % 100 + l_quantity::BIGINT AS e FROM lineitem
    WHERE l_linenumber % 2 = 0),
  b AS (SELECT l_orderkey AS doc, l_linenumber AS id, l_suppkey % 100 AS s, l_suppkey % 100 + l_quantity::BIGINT AS e FROM lineitem
    WHERE l_linenumber % 2 = 1)"""


@query("jn_07_span_overlap", SPANS + """
;; SELECT a.doc, a.id AS a, b.id AS b, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM a JOIN b ON a.doc = b.doc
    AND greatest(a.s, b.s) < least(a.e, b.e)""")
def spans(spark, d):
    line = v.read(spark, d, "lineitem")
    a = line.filter("l_linenumber % 2 = 0").selectExpr("l_orderkey AS doc", "l_linenumber AS a", "l_partkey % 100 AS s", "l_partkey % 100 + CAST(l_quantity AS BIGINT) AS e")
    b = line.filter("l_linenumber % 2 = 1").selectExpr("l_orderkey AS doc", "l_linenumber AS b", "l_suppkey % 100 AS s2", "l_suppkey % 100 + CAST(l_quantity AS BIGINT) AS e2")
    return overlapping(a, b, ["doc"], ("s", "e"), ("s2", "e2")).selectExpr("doc", "a", "b", "least(e, e2) - greatest(s, s2) AS overlap")


@query("jn_09_requested_all_ready", """r AS (SELECT l_orderkey AS request, l_partkey % 200 AS document_id FROM lineitem)
;; SELECT request, count(DISTINCT r.document_id) AS wanted, count(DISTINCT d.document_id) = count(DISTINCT r.document_id) AS all_ready FROM r
    LEFT JOIN (SELECT document_id FROM kb_documents WHERE status = 'ready') d USING (document_id) GROUP BY 1""")
def division(spark, d):
    r = v.read(spark, d, "lineitem").selectExpr("l_orderkey AS request", "l_partkey % 200 AS document_id").distinct()
    ready = v.kb_documents(spark, d).filter("status = 'ready'").select("document_id", F.lit(1).alias("ok"))
    return r.join(ready, "document_id", "left").groupBy("request").agg(F.count("*").alias("wanted"), (F.count("ok") == F.count("*")).alias("all_ready"))


@query("jn_12_apply_reviews", """a AS (SELECT thread_id, turn, sha256(text) AS h FROM kb_messages WHERE role = 'assistant'),
  j AS (SELECT thread_id, turn, CASE WHEN thread_id % 4 = 0 THEN 'stale' ELSE h END AS h, thread_id % 2 = 0 AS good FROM a WHERE thread_id % 3 <> 0)
;; SELECT a.thread_id, a.turn, CASE WHEN j.h IS NULL THEN 'pending' WHEN j.h <> a.h THEN 'stale' WHEN good THEN 'accepted'
    ELSE 'rejected' END AS review FROM a LEFT JOIN j USING (thread_id, turn)""")
def reviews(spark, d):
    a = v.kb_messages(spark, d).filter("role = 'assistant'").selectExpr("thread_id", "turn", "sha2(text, 256) AS h")
    j = a.filter("thread_id % 3 <> 0").selectExpr("thread_id", "turn", "CASE WHEN thread_id % 4 = 0 THEN 'stale' ELSE h END AS jh", "thread_id % 2 = 0 AS good")
    return a.join(j, ["thread_id", "turn"], "left").selectExpr("thread_id", "turn", "CASE WHEN jh IS NULL THEN 'pending' WHEN jh <> h THEN 'stale' WHEN good THEN 'accepted' ELSE 'rejected' END AS review")


@query("set_02_stale_difference", "SELECT chunk_id FROM kb_chunks EXCEPT SELECT chunk_id FROM kb_chunks WHERE chunk_version = version")
def difference(spark, d):
    c = v.kb_chunks(spark, d)
    return c.select("chunk_id").join(c.filter("chunk_version = version").select("chunk_id"), "chunk_id", "left_anti")


@query("set_03_shared_terms", """w AS (SELECT DISTINCT lang, unnest(string_split(lower(text), ' ')) AS t FROM kb_documents)
;; SELECT t AS term FROM w WHERE lang = 'en' INTERSECT SELECT t FROM w WHERE lang = 'de'""")
def shared(spark, d):
    """Texts are read once, and each task brings a term once, however often it has it."""
    w = v.kb_documents(spark, d).filter("lang IN ('en', 'de')").select("lang", F.explode(F.split(F.lower("text"), " ")).alias("term"))
    return w.groupBy("term").agg(F.min("lang").alias("a"), F.max("lang").alias("b")).filter("a < b").select("term")


@query("set_04_distinct_ids", "SELECT DISTINCT owner, document_id FROM kb_jobs")
def distinct(spark, d):
    return v.kb_jobs(spark, d).select("owner", "document_id").dropDuplicates()


@query("set_05_duplicate_content", "SELECT tenant, content_hash, count(*) AS n, min(document_id) AS keep FROM kb_documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, d):
    return v.kb_documents(spark, d).groupBy("tenant", "content_hash").agg(F.count("*").alias("n"), F.min("document_id").alias("keep")).filter("n > 1")


@query("set_06_keep_lowest_chunk", "SELECT min(chunk_id) AS chunk_id FROM kb_chunks GROUP BY sha256(content)")
def lowest(spark, d):
    w = Window.partitionBy(F.sha2("content", 256)).orderBy("chunk_id")
    return v.kb_chunks(spark, d).withColumn("r", F.row_number().over(w)).filter("r = 1").select("chunk_id")


@query("set_07_violation_rows", """SELECT document_id, 'NO_MODEL' AS violation FROM kb_documents WHERE model IS NULL
  UNION ALL SELECT document_id, 'NOT_READY' FROM kb_documents WHERE status <> 'ready'
  UNION ALL SELECT document_id, 'OLD_PARSER' FROM kb_documents WHERE parser_version < 2""")
def violations(spark, d):
    t = v.kb_documents(spark, d)
    return t.select("document_id", F.explode(F.array_compact(F.array(F.when(F.col("model").isNull(), "NO_MODEL"), F.when(F.col("status") != "ready", "NOT_READY"), F.when(F.col("parser_version") < 2, "OLD_PARSER")))).alias("violation"))


@query("set_08_cascade_delete", """gone AS (SELECT document_id FROM kb_documents WHERE status = 'deleting')
;; SELECT 'chunk' AS kind, chunk_id AS id, NULL AS status FROM kb_chunks ANTI JOIN gone USING (document_id)
  UNION ALL SELECT 'job', job_id, CASE WHEN gone.document_id IS NOT NULL AND status IN ('queued', 'running', 'retrying') THEN 'cancelled'
    ELSE status END FROM kb_jobs LEFT JOIN gone USING (document_id)""")
def cascade(spark, d):
    gone = v.kb_documents(spark, d).filter("status = 'deleting'").select("document_id")
    left = v.kb_chunks(spark, d).select("chunk_id", "document_id").join(gone, "document_id", "left_anti").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), F.lit(None).cast("string").alias("status"))
    j = v.kb_jobs(spark, d).join(gone.withColumn("gone", F.lit(True)), "document_id", "left")
    live = F.col("status").isin("queued", "running", "retrying")
    return left.unionByName(j.select(F.lit("job").alias("kind"), F.col("job_id").alias("id"), F.when(F.coalesce("gone", F.lit(False)) & live, "cancelled").otherwise(F.col("status")).alias("status")))


@query("fn_03_normalize_question", r"SELECT thread_id, turn, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS q FROM kb_messages")
def nq(spark, d):
    return v.kb_messages(spark, d).select("thread_id", "turn", tx.normal_question("text").alias("q"))


@query("fn_04_normalize_answer", r"SELECT answer_id, lower(trim(regexp_replace(regexp_replace(answer, '\[source_\d+\]', '', 'g'), '\s+', ' ', 'g'))) AS a FROM kb_answers")
def na(spark, d):
    return v.kb_answers(spark, d).select("answer_id", tx.normal_answer("answer").alias("a"))


from quern.plans.retrieval import CONTENT, TERMS  # noqa: E402


@query("fn_01_content_terms", f"SELECT document_id, chunk_index, {CONTENT('content')} AS terms FROM kb_chunks")
def fn_content(spark, d):
    return v.kb_chunks(spark, d).select("document_id", "chunk_index", tx.content_terms("content").alias("terms"))


@query("fn_02_terms", f"SELECT document_id, chunk_index, array_to_string({TERMS('content')}, ' ') AS terms FROM kb_chunks")
def fn_terms(spark, d):
    return v.kb_chunks(spark, d).select("document_id", "chunk_index", F.array_join(tx.terms("content"), " ").alias("terms"))


_safe = "trim(regexp_replace(regexp_replace(list_last(regexp_split_to_array(n, '[\\\\/]')), '[\\x00-\\x1f]', '', 'g'), '[^A-Za-z0-9._ ()-]+', '_', 'g'))"


@query("fn_05_safe_filename", f"""t AS (SELECT p_partkey, 'dir/' || p_name || '*?' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.exe' ELSE '' END AS n FROM part),
  c AS (SELECT p_partkey, {_safe} AS c FROM t)
;; SELECT p_partkey, CASE WHEN {_ext('c')} IN {_exts} THEN c ELSE CASE WHEN c = '' THEN 'document' ELSE c END || '.pdf' END AS name FROM c""")
def fn_safe(spark, d):
    n = F.expr("concat('dir/', p_name, '*?', p_brand, CASE p_partkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.exe' ELSE '' END)")
    return v.read(spark, d, "part").select("p_partkey", tx.safe_filename(n).alias("name"))


@query("fn_06_extension_of", f"SELECT document_id, {_ext('filename')} AS ext FROM kb_documents")
def fn_ext(spark, d):
    return v.kb_documents(spark, d).select("document_id", tx.extension_of("filename").alias("ext"))


@query("fn_07_owner_path", f"""t AS (SELECT document_id, tenant, tenant || '/' || document_id || '.' || CASE WHEN {_ext('filename')} IN {_exts} THEN {_ext('filename')}
    ELSE 'pdf' END AS path FROM kb_documents)
;; SELECT document_id, path, starts_with(path, 'src1/') AND NOT contains(path, '..') AS mine FROM t""")
def fn_path(spark, d):
    return v.kb_documents(spark, d).withColumn("path", tx.owner_path("tenant", "document_id", "filename")).select("document_id", "path", tx.is_owner_path("path", F.lit("src1")).alias("mine"))


@query("fn_08_is_sha256", """SELECT document_id, regexp_matches(CASE WHEN document_id % 3 = 0 THEN upper(content_hash) ELSE content_hash END, '^[a-f0-9]{64}$') AS ok
    FROM kb_documents""")
def fn_sha(spark, d):
    return v.kb_documents(spark, d).select("document_id", tx.is_sha256(F.when(F.col("document_id") % 3 == 0, F.upper("content_hash")).otherwise(F.col("content_hash"))).alias("ok"))


_STATUS = "CASE event_id % 7 WHEN 0 THEN 402 WHEN 1 THEN 401 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 404 END"
_MESSAGE = "CASE event_id % 9 WHEN 0 THEN 'Socket closed' WHEN 1 THEN 'Daily quota reached' WHEN 2 THEN 'API key not valid' WHEN 3 THEN 'width mismatch' WHEN 4 THEN 'timed out' ELSE event END"
_CODE = "CASE event_id % 5 WHEN 0 THEN 'rate_limit_exceeded' WHEN 1 THEN 'ZERO_COST_AI_BLOCKED' END"
_has = lambda ws: "(" + " OR ".join(f"contains(lower(concat_ws(' ', m, coalesce(lower(c), ''), '')), '{w}')" for w in ws) + ")"
CLASSIFY = f"""f AS (SELECT event_id, {_STATUS} AS s, {_CODE} AS c, {_MESSAGE} AS m FROM kb_events),
  k AS (SELECT *, CASE WHEN c = 'ZERO_COST_AI_BLOCKED' THEN ['PERMANENT', 'AI_DISABLED']
    WHEN s = 402 OR {_has(po.QUOTA[2])} THEN ['PERMANENT', 'CREDITS_EXHAUSTED']
    WHEN s IN (401, 403) OR {_has(po.CREDENTIALS[2])} THEN ['PERMANENT', 'INVALID_CREDENTIALS']
 WHEN s = 429 OR c = 'rate_limit_exceeded' THEN ['RESOURCE_LIMIT', 'RATE_LIMITED'] WHEN s >= 500 THEN ['DEPENDENCY', 'UPSTREAM_ERROR']
    WHEN s >= 400 THEN ['PERMANENT', 'UPSTREAM_REJECTED'] WHEN regexp_matches(m, '(?i)timed? ?out|network|fetch failed|socket|econnreset|econnrefused') THEN ['DEPENDENCY', 'UPSTREAM_TIMEOUT'] WHEN regexp_matches(m, '(?i)dimensions?, expected|width mismatch') THEN ['PERMANENT', 'UPSTREAM_REJECTED'] ELSE ['TRANSIENT', 'UNEXPECTED'] END AS k FROM f)"""


def _failures(spark, d):
    e = v.kb_events(spark, d).select("event_id", F.expr(_STATUS).alias("s"), F.expr(_CODE).alias("c"), F.expr(_MESSAGE).alias("m"))
    return e.select("event_id", po.classify_failure(F.col("s"), F.col("c"), F.lit(None).cast("string"), F.col("m")).alias("k"))


@query("fn_09_classify_failure", CLASSIFY + ";; SELECT event_id, k[1] AS class, k[2] AS code FROM k")
def fn_classify(spark, d):
    return _failures(spark, d).select("event_id", "k.class", "k.code")


@query("fn_10_backoff", CLASSIFY + """
;; SELECT event_id, k[1] <> 'PERMANENT' AND event_id % 6 < 4 AS retryable, least(CASE WHEN k[1] = 'RESOURCE_LIMIT' THEN 30
    ELSE 5 END * pow(2, greatest(event_id % 6 - 1, 0)), 600)::BIGINT AS seconds FROM k""")
def fn_backoff(spark, d):
    n = F.col("event_id") % 6
    return _failures(spark, d).select("event_id", po.is_retryable(F.col("k.class"), n).alias("retryable"), po.backoff_seconds(n, F.col("k.class")).alias("seconds"))


@query("fn_11_lease_state", """SELECT job_id, CASE WHEN status <> 'running' THEN 'not_running'
    WHEN locked_at IS NULL OR epoch(TIMESTAMP '1996-06-01') - epoch(locked_at) >= 300 THEN 'expired' ELSE 'active' END AS lease FROM kb_jobs""")
def fn_lease(spark, d):
    return v.kb_jobs(spark, d).select("job_id", po.lease_state(F.col("status"), F.col("locked_at"), F.lit("1996-06-01")).alias("lease"))


@query("fn_12_phase_progress", f"""p AS (SELECT document_id, ([{','.join(repr(p) for p in po.PHASES)}, 'failed'])[1 + document_id % 9] AS phase FROM kb_documents)
;; SELECT document_id, phase, CASE WHEN phase = 'failed' THEN 0 ELSE 1 + document_id % 9 END AS step FROM p""")
def fn_phase(spark, d):
    p = v.kb_documents(spark, d).withColumn("phase", F.element_at(F.array(*map(F.lit, [*po.PHASES, "failed"])), (1 + F.col("document_id") % 9).cast("int")))
    return p.select("document_id", "phase", po.phase_step(F.col("phase")).alias("step"))


@query("fn_13_exact_match", r"""n AS (SELECT thread_id, turn, role, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM kb_messages)
;; SELECT a.thread_id, a.turn, bool_or(coalesce(a.t = b.t, false)) AS matched FROM n a LEFT JOIN n b ON b.thread_id = a.thread_id AND b.role = 'user'
    WHERE a.role = 'assistant' GROUP BY 1, 2""")
def fn_exact(spark, d):
    m = v.kb_messages(spark, d).withColumn("t", tx.normal_answer("text"))
    refs = m.filter("role = 'user'").groupBy("thread_id").agg(F.collect_list("t").alias("refs"))
    return m.filter("role = 'assistant'").join(refs, "thread_id", "left").select("thread_id", "turn", F.coalesce(F.exists("refs", lambda r: r == F.col("t")), F.lit(False)).alias("matched"))


@query("fn_14_title_from_question", "SELECT thread_id, turn, CASE WHEN turn = 0 THEN substr(text, 1, 60) ELSE 'Kept' END AS title FROM kb_messages WHERE role = 'user'")
def fn_title(spark, d):
    title = F.when(F.col("turn") == 0, tx.DEFAULT_TITLE).otherwise("Kept")
    return v.kb_messages(spark, d).filter("role = 'user'").select("thread_id", "turn", tx.title_from(title, "text").alias("title"))


@query("fn_15_window_start", "SELECT event_id, floor(epoch(ts))::BIGINT - floor(epoch(ts))::BIGINT % 300 AS start FROM kb_events")
def fn_window(spark, d):
    return v.kb_events(spark, d).select("event_id", (F.unix_seconds("ts") - F.unix_seconds("ts") % 300).alias("start"))


@query("fn_16_vector_dims", "SELECT vec_id, len(embedding)::BIGINT AS dims FROM embeddings")
def fn_dims(spark, d):
    return v.kb_vectors(spark, d).select("vec_id", F.size("embedding").cast("long").alias("dims"))


@query("fn_17_progress_percent", "SELECT document_id, 40 + round(count(*) FILTER (chunk_version = version)::DOUBLE / count(*) * 45)::BIGINT AS percent FROM kb_chunks GROUP BY 1")
def fn_progress(spark, d):
    t = v.kb_chunks(spark, d).groupBy("document_id").agg(F.count_if(F.col("chunk_version") == F.col("version")).alias("done"), F.count("*").alias("total"))
    return t.select("document_id", po.progress_percent(F.col("done"), F.col("total")).alias("percent"))


@query("fn_18_format_bytes", """SELECT document_id, CASE WHEN byte_size < 1024 THEN format('{:d} B', byte_size) WHEN byte_size < 1048576 THEN format('{:.1f} KB',
    round(byte_size / 1024, 1)) ELSE format('{:.1f} MB', round(byte_size / 1048576, 1)) END AS size, format('{:.1f}%', (document_id % 7) * 12.5) AS share FROM kb_documents""")
def fn_bytes(spark, d):
    return v.kb_documents(spark, d).select("document_id", tx.format_bytes("byte_size").alias("size"), tx.percent(F.col("document_id") % 7 * 0.125).alias("share"))


@query("fn_19_safe_error_code", """e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'PGRST202' WHEN 1 THEN '42883' WHEN 2 THEN 'bad code' WHEN 3 THEN '42703'
    WHEN 4 THEN upper(event) END AS c FROM kb_events)
;; SELECT event_id, CASE WHEN regexp_matches(c, '^[A-Z0-9_]{1,64}$') THEN c ELSE 'OPERATION_FAILED' END AS code, CASE c
    WHEN 'PGRST202' THEN 'function_not_resolved' WHEN '42883' THEN 'undefined_function' WHEN '42703' THEN 'undefined_column' END AS kind FROM e""")
def fn_code(spark, d):
    c = F.expr("CASE event_id % 6 WHEN 0 THEN 'PGRST202' WHEN 1 THEN '42883' WHEN 2 THEN 'bad code' WHEN 3 THEN '42703' WHEN 4 THEN upper(event) END")
    return v.kb_events(spark, d).select("event_id", po.safe_error_code(c).alias("code"), po.schema_error_kind(c).alias("kind"))


@query("fn_20_severity", "SELECT event_id, CASE status WHEN 'error' THEN 'error' WHEN 'refused' THEN 'warn' ELSE 'info' END AS level FROM kb_events")
def fn_severity(spark, d):
    return v.kb_events(spark, d).select("event_id", po.severity(F.col("status")).alias("level"))


@query("fn_21_question_history", "SELECT thread_id, string_agg(trim(text), chr(10) ORDER BY turn) AS history, count(*) AS n FROM kb_messages WHERE role = 'user' GROUP BY 1")
def fn_history(spark, d):
    m = v.kb_messages(spark, d).filter("role = 'user'").groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("t")))).alias("p"), F.count("*").alias("n"))
    return m.select("thread_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("history"), "n")
