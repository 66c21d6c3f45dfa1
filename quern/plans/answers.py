"""Queries of answer auditing and evidence packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import citations as ct
from quern.operators import context as cx
from quern.operators import retrieval as rt
from quern.plans.registry import query
from quern.plans.retrieval import GATE, RANKED, ranked_passages
from quern.sources import files
from quern.sources import views as v

KNOWN = [f"source_{i:02d}" for i in range(1, 8)]


def _evidence(spark, d):
    """Each answer's evidence: three sources, whose texts are the thread's user turns."""
    m = v.kb_messages(spark, d).filter("role = 'user'").withColumn("n", F.row_number().over(Window.partitionBy("thread_id").orderBy("turn")))
    texts = m.filter("n <= 3").select("thread_id", "n", F.col("text").alias("snippet"))
    ids = spark.createDataFrame([(i, f"source_{i:02d}") for i in (1, 2, 3)], "n int, source_id string")
    answers = v.kb_answers(spark, d).select("answer_id", F.expr("answer_id DIV 100").alias("thread_id"), F.explode(F.array(*(F.lit(i) for i in (1, 2, 3)))).alias("n"))
    return answers.join(F.broadcast(ids), "n").join(texts, ["thread_id", "n"], "left").select("answer_id", "source_id", "snippet")


_F, _H, _R, _L, _T, _S = (p.replace("'", "''") for p in (ct.FENCE, ct.HEADING, ct.RULE, ct.LIST, ct.TABLE, ct.SEPARATOR))
LINES = rf"""ln0 AS (SELECT answer_id, unnest(string_split(trim(answer), chr(10))) AS line, generate_subscripts(string_split(trim(answer), chr(10)), 1) AS i
    FROM ans),
  ln1 AS (SELECT *, regexp_matches(line, '{_F}') AS fence FROM ln0),
  ln AS (SELECT *, fence OR coalesce(sum(fence::INT) OVER (PARTITION BY answer_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) % 2 = 1 AS code FROM ln1)"""
NORM = r"ans AS (SELECT answer_id, regexp_replace(answer, '\[source_(\d)\]', '[source_0\1]', 'g') AS answer FROM kb_answers)"
RAW = "ans AS (SELECT answer_id, answer FROM kb_answers)"
BLOCKS = rf"""b0 AS (SELECT *, NOT code AND regexp_matches(line, '{_T}') AND regexp_matches(line, '{_S}') AS sep FROM ln),
  b1 AS (SELECT *, coalesce(lead(sep) OVER w, false) AS next_sep FROM b0 WINDOW w AS (PARTITION BY answer_id ORDER BY i)),
 b2 AS (SELECT *, CASE WHEN code THEN 'code' WHEN NOT regexp_matches(line, '\S') THEN 'blank' WHEN regexp_matches(line, '{_H}') THEN 'heading'
    WHEN regexp_matches(line, '{_R}') THEN 'rule' WHEN regexp_matches(line, '\[source_\d{{1,2}}\]')
    AND trim(regexp_replace(line, '\[source_\d{{1,2}}\]', '', 'g')) = '' THEN 'citation-only'
  WHEN regexp_matches(line, '{_T}') THEN CASE WHEN sep OR next_sep THEN 'table-header' ELSE 'table-row' END
    WHEN regexp_matches(line, '^\s{{0,3}}>') THEN 'blockquote' WHEN regexp_matches(line, '{_L}') THEN 'list-item'
    WHEN regexp_matches(line, '^\s+\S') THEN 'indented' ELSE 'paragraph' END AS raw FROM b1),
 b3 AS (SELECT *, last_value(CASE WHEN raw <> 'indented' THEN raw END IGNORE NULLS) OVER (PARTITION BY answer_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS held FROM b2),
  b4 AS (SELECT *, coalesce(raw = 'indented' AND held IN ('list-item', 'blockquote'), false) AS joins FROM b3),
 b5 AS (SELECT *, CASE WHEN joins THEN held WHEN raw = 'indented' THEN 'paragraph' ELSE raw END AS kind FROM b4),
  b6 AS (SELECT *, CASE WHEN joins OR coalesce(kind IN ('paragraph', 'blockquote')
    AND lag(kind) OVER (PARTITION BY answer_id ORDER BY i) = kind, false) THEN 0 ELSE 1 END AS new FROM b5),
 b7 AS (SELECT *, sum(new) OVER (PARTITION BY answer_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS blk FROM b6),
  b8 AS (SELECT answer_id, blk, kind, string_agg(line, chr(10) ORDER BY i) AS text FROM b7 WHERE kind <> 'blank' GROUP BY 1, 2, 3),
  blocks AS (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY blk) AS block, kind, text FROM b8)"""
REAL = r"kind IN ('paragraph', 'list-item', 'blockquote', 'table-row') AND regexp_matches(regexp_replace(regexp_replace(text, '\[source_\d{1,2}\]', '', 'g'), '[*_`~#>|\-+:]', '', 'g'), '[\p{L}\p{N}]')"
SCAN = r"""runs AS (SELECT answer_id, i, unnest(regexp_extract_all(line, '\[[^\]\[\n]{1,48}\]')) AS run, generate_subscripts(regexp_extract_all(line, '\[[^\]\[\n]{1,48}\]'), 1) AS j FROM ln WHERE NOT code),
 sc AS (SELECT *, CASE WHEN regexp_matches(run, '^\[source_(\d{1,2})\]$') THEN 'source_' || lpad(regexp_extract(run, '(\d{1,2})', 1), 2, '0') END AS id FROM runs),
 off AS (SELECT *, CASE WHEN id IN ('source_01', 'source_02', 'source_03') THEN NULL
    WHEN id IN ('source_04', 'source_05', 'source_06', 'source_07') THEN 'citation_outside_evidence_set' WHEN id IS NOT NULL THEN 'unknown_citation'
    WHEN regexp_matches(run, '(?i)^\[\s*source_\s*(\d{3,})\s*\]$') THEN 'unknown_citation'
    WHEN regexp_matches(run, '(?i)^\[\s*source_[^\]\[\n]{0,40}\]$') THEN 'malformed_citation' END AS reason,
  CASE WHEN id IS NOT NULL THEN id WHEN regexp_matches(run, '(?i)^\[\s*source_\s*(\d{3,})\s*\]$') THEN 'source_' || regexp_extract(run, '(\d{3,})', 1)
    ELSE run END AS citation_id FROM sc),
 scan AS (SELECT answer_id, arg_min(reason, i * 10000 + j) AS reason, arg_min(citation_id, i * 10000 + j) AS citation_id FROM off
    WHERE reason IS NOT NULL GROUP BY 1)"""
VALID = (
    RAW + ", " + LINES + ", " + SCAN + ", "
    + NORM.replace("ans AS", "ansn AS") + ", " + LINES.replace("ln0", "nl0").replace("ln1", "nl1").replace("ln AS", "nl AS").replace("FROM ans)", "FROM ansn)") + ", "
    + BLOCKS.replace("FROM ln)", "FROM nl)")
    + rf""",
  br AS (SELECT *, {REAL} AS isreal, regexp_matches(text, '\[source_\d{{1,2}}\]') AS cites FROM blocks),
  bn AS (SELECT *, sum(isreal::INT) OVER (PARTITION BY answer_id ORDER BY block ROWS UNBOUNDED PRECEDING) - 1 AS n FROM br),
  byb AS (SELECT answer_id, count(*) FILTER (isreal) AS n_real, min(n) FILTER (isreal AND NOT cites) AS uncited FROM bn GROUP BY 1),
 prose AS (SELECT answer_id, string_agg(line, chr(10) ORDER BY i) AS p FROM nl WHERE NOT code GROUP BY 1),
  ci0 AS (SELECT answer_id, regexp_extract_all(p, '\[source_(\d{{1,2}})\]', 1) AS ids FROM prose),
  ci AS (SELECT answer_id, list_transform(list_filter(ids, lambda x, k: list_position(ids, x) = k), lambda x: 'source_' || x) AS cited FROM ci0),
 va AS (SELECT a.answer_id, CASE WHEN trim(a.answer) = '' THEN 'no_citations' WHEN scan.reason IS NOT NULL THEN scan.reason
    WHEN coalesce(len(cited), 0) = 0 AND coalesce(n_real, 0) > 0 THEN 'no_citations'
    WHEN uncited IS NOT NULL THEN 'uncited_substantive_block' END AS reason, uncited, scan.citation_id, cited FROM ans a
    LEFT JOIN byb USING (answer_id) LEFT JOIN ci USING (answer_id) LEFT JOIN scan USING (answer_id)),
 valid AS (SELECT answer_id, reason IS NULL AS valid, reason, CASE reason WHEN 'no_citations' THEN 0
    WHEN 'uncited_substantive_block' THEN uncited END::BIGINT AS block, citation_id, CASE
    WHEN reason IS NULL THEN coalesce(array_to_string(cited, ','), '') ELSE '' END AS cited FROM va)"""
)


@query("cit_01_normalize_markers", r"SELECT answer_id, regexp_replace(answer, '\[source_(\d)\]', '[source_0\1]', 'g') AS answer FROM kb_answers")
def normalized(spark, d):
    return v.kb_answers(spark, d).select("answer_id", ct.normalize_markers(F.col("answer")).alias("answer"))


@query("cit_02_extract_citations", r"""m AS (SELECT answer_id, regexp_extract_all(answer, '\[source_(\d{1,2})\]', 1) AS ids FROM kb_answers)
;; SELECT answer_id, 'source_' || lpad(unnest(ids), 2, '0') AS source_id, generate_subscripts(ids, 1) AS place FROM m""")
def extracted(spark, d):
    return v.kb_answers(spark, d).select("answer_id", F.posexplode(ct.markers(F.col("answer"))).alias("place", "source_id")).select("answer_id", "source_id", (F.col("place") + 1).alias("place"))


@query("cit_03_fence_segments", RAW + ", " + LINES + ";; SELECT answer_id, count(*) FILTER (code) AS code_lines, count(*) FILTER (NOT code) AS prose_lines FROM ln GROUP BY 1")
def fences(spark, d):
    return ct.lines(v.kb_answers(spark, d)).groupBy("answer_id").agg(F.count_if("code").alias("code_lines"), F.count_if(~F.col("code")).alias("prose_lines"))


@query("cit_04_split_blocks", RAW + ", " + LINES + ", " + BLOCKS + ";; SELECT answer_id, block, kind, text FROM blocks")
def blocks(spark, d):
    return ct.blocks(v.kb_answers(spark, d))


@query("cit_05_is_substantive", RAW + ", " + LINES + ", " + BLOCKS + f";; SELECT answer_id, block, {REAL} AS substantive FROM blocks")
def substantive(spark, d):
    return ct.blocks(v.kb_answers(spark, d)).select("answer_id", "block", ct.substantive(F.col("kind"), F.col("text")).alias("substantive"))


@query("cit_06_scan_markers", RAW + ", " + LINES + ", " + SCAN + ";; SELECT answer_id, reason, citation_id FROM scan")
def scanned(spark, d):
    return ct.scan_markers(v.kb_answers(spark, d), _evidence(spark, d), KNOWN)


def _validated(spark, d):
    return ct.validate(v.kb_answers(spark, d), _evidence(spark, d), KNOWN)


@query("cit_07_validate_answer", VALID + ";; SELECT * FROM valid")
def validated(spark, d):
    return _validated(spark, d).withColumn("cited", F.array_join("cited", ","))


@query("cit_08_plan_delivery", VALID + r";; SELECT answer_id, CASE WHEN valid THEN trim(regexp_replace(answer, '\[source_(\d)\]', '[source_0\1]', 'g')) ELSE '" + ct.REFUSAL.replace("'", "''") + "' END AS text, NOT valid AS refused, CASE WHEN cited = '' THEN 0 ELSE len(string_split(cited, ',')) END AS n_citations FROM valid JOIN ans USING (answer_id)")
def delivery(spark, d):
    return ct.plan_delivery(_validated(spark, d), v.kb_answers(spark, d))


@query("cit_09_emission_chunks", r"""WITH RECURSIVE k AS (SELECT answer_id, regexp_extract_all(answer, '\s+|\S+') AS w FROM (KB)),
  t AS (SELECT answer_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM k),
 r AS (SELECT answer_id, 0::BIGINT AS i, 0 AS at, 0::BIGINT AS size, 0 AS piece FROM k UNION ALL
 SELECT answer_id, i, CASE WHEN size + n >= 240 AND NOT cut OR cut AND n >= 240 THEN piece + 1 ELSE piece END, CASE WHEN cut THEN CASE
    WHEN n >= 240 THEN 0 ELSE n END WHEN size + n >= 240 THEN 0 ELSE size + n END, piece
 FROM (SELECT r.answer_id, t.i, r.size, length(t.x) AS n, r.size > 0 AND r.size + length(t.x) > 240 AS cut, CASE WHEN r.size > 0
    AND r.size + length(t.x) > 240 THEN r.at + 1 ELSE r.at END AS piece FROM r JOIN t ON t.answer_id = r.answer_id AND t.i = r.i + 1))
SELECT answer_id, piece AS i, string_agg(x, '' ORDER BY r.i) AS piece FROM r JOIN t USING (answer_id, i) GROUP BY 1, 2""".replace("(KB)", f"({v.SQL['kb_answers']})"))
def emission(spark, d):
    return v.kb_answers(spark, d).select("answer_id", F.posexplode(ct.emission_chunks(F.col("answer"))).alias("i", "piece"))


@query("cit_10_validation_telemetry", VALID + ";; SELECT coalesce(reason, 'ok') AS reason, count(*) AS n, count(*) FILTER (valid) AS ok FROM valid GROUP BY 1")
def validation_telemetry(spark, d):
    return _validated(spark, d).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.count_if("valid").alias("ok"))


@query("cit_11_strip_citations", r"""s AS (SELECT answer_id, regexp_replace(answer, '(?i)\[\s*source_(\d{1,3})\s*\]', '[source_\1]', 'g') AS a, list_distinct(regexp_extract_all(lower(answer), '\[\s*(source_\d{1,3})\s*\]', 1)) AS ids FROM kb_answers)
;; SELECT answer_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '\[source_(01|02|03)\]', '<<\1>>', 'g'), '\[source_\d{1,3}\]', '', 'g'), '<<(01|02|03)>>', '[source_\1]', 'g'), '[ \t]{2,}', ' ', 'g')) AS text, coalesce(array_to_string(list_sort(list_filter(ids, lambda x: x IN ('source_01', 'source_02', 'source_03'))), ','), '') AS good, coalesce(array_to_string(list_sort(list_filter(ids, lambda x: x NOT IN ('source_01', 'source_02', 'source_03'))), ','), '') AS bad FROM s""")
def stripped(spark, d):
    text, good, bad = ct.strip_citations(F.col("answer"), KNOWN[:3])
    return v.kb_answers(spark, d).select("answer_id", text.alias("text"), F.array_join(good, ",").alias("good"), F.array_join(bad, ",").alias("bad"))


EVIDENCE = """evd AS (SELECT answer_id, 'source_0' || k AS source_id, u.text AS snippet
    FROM (SELECT answer_id, answer_id // 100 AS thread_id, unnest([1, 2, 3]) AS k FROM kb_answers) LEFT JOIN (SELECT thread_id, text,
    row_number() OVER (PARTITION BY thread_id ORDER BY turn) AS k FROM kb_messages WHERE role = 'user') u USING (thread_id, k))"""


@query("cit_12_check_quotes", NORM + ", " + LINES + ", " + BLOCKS + ", " + EVIDENCE + r""",
  qt AS (SELECT answer_id, block, list_transform(regexp_extract_all(text, '\[source_(\d{1,2})\]', 1), lambda x: 'source_' || x) AS ids, unnest(regexp_extract_all(text, '"([^"\n]+)"', 1)) AS quote, generate_subscripts(regexp_extract_all(text, '"([^"\n]+)"', 1), 1) AS j FROM blocks),
  h AS (SELECT q.answer_id, q.block, q.j, bool_or(coalesce(contains(e.snippet, q.quote), false)) AS hit FROM qt q
    LEFT JOIN evd e ON e.answer_id = q.answer_id AND list_contains(q.ids, e.source_id) GROUP BY 1, 2, 3)
;; SELECT answer_id, count(*) AS quotes, count(*) FILTER (hit) AS found FROM h GROUP BY 1""")
def quotes(spark, d):
    return ct.check_quotes(v.kb_answers(spark, d), _evidence(spark, d))


@query("cit_13_phrase_tests", r"""SELECT thread_id, turn, regexp_matches(text, '(?i)\b(all (?:the )?documents agree|no (?:conflicts|contradictions)|comprehensive summary|complete summary of (?:the |all )?documents)\b') AS complete, regexp_matches(text, '(?i)\b(summari[sz]e|summary|overview|key findings)\b') AS summary FROM kb_messages""")
def phrases(spark, d):
    return v.kb_messages(spark, d).select("thread_id", "turn", F.rlike("text", F.lit(r"(?i)\b(all (?:the )?documents agree|no (?:conflicts|contradictions)|comprehensive summary|complete summary of (?:the |all )?documents)\b")).alias("complete"), F.rlike("text", F.lit(r"(?i)\b(summari[sz]e|summary|overview|key findings)\b")).alias("summary"))


@query("cit_14_is_refusal", VALID + ";; SELECT answer_id, NOT valid AS refusal FROM valid")
def refusal(spark, d):
    shown = ct.plan_delivery(_validated(spark, d), v.kb_answers(spark, d))
    return shown.select("answer_id", (F.trim("text") == ct.REFUSAL).alias("refusal"))


@query("cit_15_local_context", """SELECT thread_id, string_agg('[' || k || '] ' || text, chr(10) || '---' || chr(10) ORDER BY k) AS context FROM (SELECT *,
    row_number() OVER (PARTITION BY thread_id ORDER BY turn) AS k FROM kb_messages) GROUP BY 1""")
def local_context(spark, d):
    m = v.kb_messages(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("thread_id").orderBy("turn")))
    g = m.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("["), F.col("k").cast("string"), F.lit("] "), "text").alias("t")))).alias("x"))
    return g.select("thread_id", F.array_join(F.transform("x", lambda e: e["t"]), "\n---\n").alias("context"))


@query("jn_11_cited_sources", VALID + """,
  ord AS (SELECT answer_id, unnest(string_split(cited, ',')) AS source_id, generate_subscripts(string_split(cited, ','), 1) AS place FROM valid
    WHERE cited <> ''), """ + EVIDENCE + ";; SELECT o.answer_id, o.source_id, o.place, length(snippet) AS n FROM ord o JOIN evd USING (answer_id, source_id)")
def cited_sources(spark, d):
    c = _validated(spark, d).select("answer_id", F.posexplode("cited").alias("place", "source_id")).withColumn("place", F.col("place") + 1)
    return c.join(_evidence(spark, d), ["answer_id", "source_id"]).select("answer_id", "source_id", "place", F.length("snippet").alias("n"))


# Evidence packing over the flagship's ranked passages.
PACK = RANKED + """,
  pk AS (SELECT r.query_id, r.chunk_id, r.document_id, c.page, c.filename, r.rerank_score, r.final_position, c.content, substr(c.content, 1, 1800) AS snippet FROM ranked r JOIN kb_passages c USING (chunk_id))"""


def _ranked(spark, d):
    """The ranked passages, from a written table, with where they stand and their snippets; of texts only these are dealt."""
    c = v.kb_passages(spark, d).withColumn("snippet", F.substring("content", 1, cx.SNIPPET))
    return rt.with_chunks(files.written(ranked_passages(spark, d).drop("document_id")), c.select("chunk_id", "document_id", "page", "chunk_index", "filename", "snippet"))


@query("ev_02_comparison_coverage", PACK + r""",
  rep AS (SELECT query_id, count(DISTINCT document_id % 3) AS got FROM pk GROUP BY 1)
;; SELECT q.query_id, NOT regexp_matches(question || CASE WHEN q.query_id % 100 = 0 THEN ' versus'
    ELSE '' END, '(?i)\b(compar\w*|contrast\w*|versus|vs|each document)\b') OR coalesce(got, 0) = 3 AS covered FROM kb_questions q
    LEFT JOIN rep USING (query_id)""")
def comparison(spark, d):
    """Each query selects three groups of documents; half of the questions compare."""
    got = _ranked(spark, d).groupBy("query_id").agg(F.count_distinct(F.col("document_id") % 3).alias("got"))
    asked = F.concat("question", F.when(F.col("query_id") % 100 == 0, " versus").otherwise(""))
    compares = F.rlike(asked, F.lit(r"(?i)\b(compar\w*|contrast\w*|versus|vs|each document)\b"))
    return v.kb_questions(spark, d).join(got, "query_id", "left").select("query_id", (~compares | (F.coalesce("got", F.lit(0)) == 3)).alias("covered"))


@query("ev_03_diversity_first", PACK + """,
  dv AS (SELECT *, CASE WHEN rerank_score >= 0.3 AND row_number() OVER (PARTITION BY query_id, document_id, rerank_score >= 0.3 ORDER BY final_position) = 1 THEN 0 ELSE 1 END AS late FROM pk)
;; SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY late, final_position) AS place FROM dv""")
def diversity(spark, d):
    return cx.diversity_first(_ranked(spark, d), "rerank_score", "final_position").select("query_id", "chunk_id", "place")


@query("ev_04_per_page_cap", PACK + """
;; SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, page ORDER BY final_position) AS r FROM pk)
    WHERE r <= 2""")
def page_cap(spark, d):
    return cx.per_page_cap(_ranked(spark, d), "final_position").select("query_id", "chunk_id")


_SH = "list_distinct(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [array_to_string(w, ' ')] END)"
SHINGLES = rf"""sh0 AS (SELECT chunk_id, string_split(trim(regexp_replace(lower(content), '\s+', ' ', 'g')), ' ') AS w FROM kb_chunks),
  sh AS (SELECT chunk_id, {_SH} AS s FROM sh0)"""


@query("ev_05_shingles_jaccard", SHINGLES + """
;; SELECT a.chunk_id AS a, len(a.s) AS n, round(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS jaccard FROM sh a JOIN sh b ON b.chunk_id = a.chunk_id + 1""")
def shingles(spark, d):
    """Each chunk against the next of its document; texts are dealt, their shingles, which take several times the room, are not."""
    c = v.kb_chunks(spark, d).select(F.col("chunk_id").alias("a"), "content")
    pairs = c.join(c.select((F.col("a") - 1).alias("a"), F.col("content").alias("next")), "a")
    return pairs.select("a", tx.shingles3("content").alias("sa"), tx.shingles3("next").alias("sb")).select("a", F.size("sa").alias("n"), F.round(tx.jaccard(F.col("sa"), F.col("sb")), 6).alias("jaccard"))


@query("ev_06_dynamic_threshold", """s AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE least(greatest(latency_ms / 100, 0), 1) END AS s FROM kb_events)
;; SELECT event_id, round(CASE WHEN s IS NULL THEN 0.82 WHEN s >= 0.75 THEN least(0.92, 0.82 + (s - 0.75) / 0.25 * 0.1)
    WHEN s < 0.5 THEN greatest(0.7, 0.82 - (0.5 - s) / 0.5 * 0.12) ELSE 0.82 END, 6) AS threshold FROM s""")
def threshold(spark, d):
    s = F.when(F.col("event_id") % 50 == 0, None).otherwise(F.col("latency_ms") / 100)
    return v.kb_events(spark, d).select("event_id", F.round(tx.dynamic_threshold(s), 6).alias("threshold"))


@query("ev_07_near_duplicate_pairs", SHINGLES + """,
  one AS (SELECT list_sort(s) AS s, min(chunk_id) AS id FROM sh GROUP BY 1),
  e AS (SELECT id, len(s) AS n, unnest(s) AS t FROM one),
  p AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.t = b.t AND a.id < b.id
    GROUP BY 1, 2)
;; SELECT a, b, round(c::DOUBLE / (na + nb - c), 6) AS similarity FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.82""")
def near_pairs(spark, d):
    return cx.near_duplicate_pairs(v.kb_chunks(spark, d))


@query("ev_07_near_duplicate_classes", SHINGLES + """,
  k AS (SELECT chunk_id, list_sort(s) AS s FROM sh),
  m AS (SELECT chunk_id, min(chunk_id) OVER w AS representative, count(*) OVER w AS class_size FROM k WINDOW w AS (PARTITION BY s)),
  e AS (SELECT k.chunk_id AS id, len(s) AS n, unnest(s) AS t FROM k JOIN m ON m.representative = k.chunk_id AND m.chunk_id = k.chunk_id),
  p AS (SELECT a.id AS a, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.t = b.t AND a.id <> b.id
    GROUP BY a.id, b.id),
  l AS (SELECT a, count(*) AS n FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.82 GROUP BY 1)
;; SELECT chunk_id, representative, class_size, coalesce(n, 0) AS n_links FROM m LEFT JOIN l ON a = representative""")
def near_classes(spark, d):
    return cx.near_duplicate_classes(v.kb_chunks(spark, d))


@query("ev_08_merge_adjoining", """g AS (SELECT document_id, page, chunk_index, content, chunk_index - row_number() OVER (PARTITION BY document_id, page ORDER BY chunk_index) AS island
    FROM kb_chunks)
;; SELECT document_id, page, min(chunk_index) AS first, count(*) AS n, string_agg(content, '' ORDER BY chunk_index) AS content FROM g
    GROUP BY document_id, page, island""")
def adjoining(spark, d):
    w = Window.partitionBy("document_id", "page").orderBy("chunk_index")
    g = v.kb_chunks(spark, d).withColumn("island", F.col("chunk_index") - F.row_number().over(w)).groupBy("document_id", "page", "island").agg(F.min("chunk_index").alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("x"))
    return g.select("document_id", "page", "first", "n", F.array_join(F.transform("x", lambda e: e["content"]), "").alias("content"))


@query("ev_09_text_overlap", """o AS (SELECT a.chunk_id, a.content AS a, right(a.content, (10 + a.chunk_id % 500)::BIGINT) || b.content AS b FROM kb_chunks a
    JOIN kb_chunks b ON b.chunk_id = a.chunk_id + 1)
;; SELECT chunk_id, coalesce(list_max(list_filter(range(16, least(length(a), length(b), 600) + 1), lambda n: right(a, n) = left(b, n))), 0)::BIGINT AS n FROM o""")
def overlap(spark, d):
    """Each chunk against the next of its document with some of its own end in front."""
    c = v.kb_chunks(spark, d).select("chunk_id", "content")
    after = c.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("content").alias("next"))
    o = c.join(after, "chunk_id").select("chunk_id", F.col("content").alias("a"), F.concat(F.right("content", (10 + F.col("chunk_id") % 500).cast("int")), "next").alias("b"))
    return o.select("chunk_id", tx.text_overlap("a", "b").cast("long").alias("n"))


@query("ev_10_token_budget", PACK + """,
  u AS (SELECT query_id, chunk_id, final_position, sum(ceil(length(snippet) / 4)::BIGINT + 24) OVER (PARTITION BY query_id ORDER BY final_position ROWS UNBOUNDED PRECEDING) AS used_tokens FROM pk)
;; SELECT query_id, chunk_id, used_tokens::BIGINT AS used_tokens FROM u WHERE used_tokens <= 2000 OR final_position = 1""")
def budget(spark, d):
    return cx.token_budget(_ranked(spark, d), "final_position", "snippet", 2000).select("query_id", "chunk_id", "used_tokens")


@query("ev_11_source_id", PACK + ";; SELECT query_id, chunk_id, 'source_' || lpad(final_position::VARCHAR, 2, '0') AS source_id FROM pk")
def source_ids(spark, d):
    return _ranked(spark, d).select("query_id", "chunk_id", cx.source_id(F.col("final_position")).alias("source_id"))


_esc = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("ev_12_render_context", PACK + f"""
;; SELECT query_id, string_agg('<evidence id="source_' || lpad(final_position::VARCHAR, 2, '0') || '" document="' || {_esc('filename')} || '" page="' || page || '">' || chr(10) || {_esc('snippet')} || chr(10) || '</evidence>', chr(10) || chr(10) ORDER BY final_position) AS context FROM pk GROUP BY 1""")
def rendered(spark, d):
    return cx.render(_ranked(spark, d), "final_position")


@query("ev_13_split_breadcrumb", r"""s AS (SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN '[Section: ' || tenant || ' > ' || filename || ']' || chr(10) || chr(10) || content
    ELSE content END AS t FROM kb_chunks)
;; SELECT chunk_id, CASE WHEN regexp_matches(t, '^\[Section:\s*([^\]]+)\]\s*') THEN regexp_extract(t, '^\[Section:\s*([^\]]+)\]\s*', 1) END AS section, regexp_replace(t, '^\[Section:\s*([^\]]+)\]\s*', '') AS body FROM s""")
def breadcrumb(spark, d):
    t = v.kb_chunks(spark, d).withColumn("t", F.expr("CASE WHEN chunk_id % 2 = 0 THEN concat('[Section: ', tenant, ' > ', filename, ']\n\n', content) ELSE content END"))
    section, body = tx.split_breadcrumb("t")
    return t.select("chunk_id", section.alias("section"), body.alias("body"))


@query("ev_14_evidence_locator", r"""s AS (SELECT chunk_id, filename, page, CASE chunk_id % 3 WHEN 0 THEN 'Sheet: Data' || chr(10) || content
    WHEN 1 THEN '[Section: ' || tenant || ']' || content ELSE content END AS s FROM kb_chunks)
;; SELECT chunk_id, CASE lower(list_last(string_split(filename, '.'))) WHEN 'pdf' THEN 'Page ' || page WHEN 'pptx' THEN 'Slide ' || page
    WHEN 'xlsx' THEN CASE WHEN regexp_matches(s, '^Sheet: ([^\n]+)') THEN regexp_extract(s, '^Sheet: ([^\n]+)', 0) ELSE 'Worksheet ' || page END ELSE
    CASE WHEN regexp_extract(s, '^\[Section:\s*([^\]]+)\]', 1) <> '' THEN regexp_extract(s, '^\[Section:\s*([^\]]+)\]', 1)
    ELSE 'Evidence excerpt' END END AS locator FROM s""")
def locators(spark, d):
    s = v.kb_chunks(spark, d).withColumn("s", F.expr("CASE chunk_id % 3 WHEN 0 THEN concat('Sheet: Data\n', content) WHEN 1 THEN concat('[Section: ', tenant, ']', content) ELSE content END"))
    return s.select("chunk_id", tx.locator("filename", "page", "s").alias("locator"))


def _statements(spark, d):
    """Evidence with statements, made of the thread's turns: each turn states its length."""
    m = v.kb_messages(spark, d)
    return m.selectExpr("thread_id AS query_id", "'what is the notice period' AS question", "concat('source_', lpad(CAST(turn + 1 AS STRING), 2, '0')) AS source_id", "turn AS document_id", "turn AS place", "concat('Intro words here. The notice period is ', length(text) % 3 + 30, ' days.\nFee: $', length(text) % 2 + 5) AS snippet")


CONFLICTS = """st AS (SELECT thread_id, turn, 30 + length(text) % 3 AS v, first_value(30 + length(text) % 3) OVER (PARTITION BY thread_id ORDER BY turn) AS f, first_value(turn) OVER (PARTITION BY thread_id ORDER BY turn) AS ft FROM kb_messages),
  cf AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn) AS n FROM st WHERE v <> f AND turn <> ft),
  cl AS (SELECT thread_id AS query_id, n, 'source_' || lpad((ft + 1)::VARCHAR, 2, '0') AS left_source, 'The notice period is ' || f || ' days.' AS left_statement, 'source_' || lpad((turn + 1)::VARCHAR, 2, '0') AS right_source, 'The notice period is ' || v || ' days.' AS right_statement FROM cf WHERE n <= 3)"""


@query("ev_15_find_conflicts", CONFLICTS + ";; SELECT * FROM cl")
def conflicts(spark, d):
    return cx.find_conflicts("question", _statements(spark, d))


@query("ev_16_conflict_answer", CONFLICTS + """
;; SELECT query_id, string_agg('The retrieved documents contain differing statements: "' || left_statement || '" [' || left_source || '] versus "' || right_statement || '" [' || right_source || '].', chr(10) || chr(10) ORDER BY n) AS answer FROM cl GROUP BY 1""")
def conflict_answers(spark, d):
    return cx.conflict_answer(cx.find_conflicts("question", _statements(spark, d)))


@query("ev_17_build_context")
def packed(spark, d):
    r = _ranked(spark, d).select("query_id", "chunk_id", "document_id", "page", "chunk_index", F.col("rerank_score").alias("score"), F.col("final_position").alias("position"))
    return cx.build_context(r, contents=v.kb_passages(spark, d))


@query("ev_18_dedupe_by_page", PACK + ";; SELECT query_id, document_id, page, arg_min(chunk_id, final_position) AS chunk_id FROM pk GROUP BY 1, 2, 3")
def by_page(spark, d):
    return _ranked(spark, d).groupBy("query_id", "document_id", "page").agg(F.min_by("chunk_id", "final_position").alias("chunk_id"))


@query("ev_19_marker_containment", PACK + ", cxt AS (SELECT query_id, string_agg('<evidence>' || " + _esc("snippet") + """ || '</evidence>', ' ' ORDER BY final_position) || CASE WHEN query_id % 100 = 0 THEN ' the end' ELSE '' END AS c FROM pk GROUP BY 1)
;; SELECT query_id, NOT contains(regexp_replace(c, '(?s)<evidence.*?</evidence>', '', 'g'), 'the') AS contained FROM cxt""")
def containment(spark, d):
    c = cx.render(_ranked(spark, d), "final_position").withColumn("c", F.concat("context", F.when(F.col("query_id") % 100 == 0, " the end").otherwise("")))
    return c.select("query_id", (~F.contains(F.regexp_replace("c", r"(?s)<evidence.*?</evidence>", ""), F.lit("the"))).alias("contained"))


@query("ev_20_evidence_ids_valid", RANKED + ", " + GATE + r""",
  ev AS (SELECT query_id, (query_id // 50) % 5 AS k, final_position AS p, document_id, chunk_id FROM ranked WHERE final_position <= 12),
 e AS (SELECT query_id, CASE WHEN k = 1 THEN 'source_01' WHEN k = 2 AND p = 1 THEN 'source_1'
    ELSE 'source_' || lpad(p::VARCHAR, 2, '0') END AS source_id, CASE WHEN k = 3 AND p = 1 THEN -1 ELSE chunk_id END AS chunk_id, document_id
    FROM ev),
 t AS (SELECT query_id, count(*) AS n, count(DISTINCT source_id) AS ids,
    count(DISTINCT e.chunk_id) AS chunks, bool_and(regexp_full_match(source_id, 'source_\d{2}')) AS formed, bool_and(EXISTS (SELECT 1 FROM ranked r
    WHERE r.query_id = e.query_id AND r.chunk_id = e.chunk_id AND r.document_id = e.document_id)) AS member FROM e GROUP BY 1)

;; SELECT v.query_id, CASE WHEN n IS NULL THEN reason <> 'ok' ELSE ids = n AND chunks = n AND formed AND member END AS valid FROM verdict v
    LEFT JOIN t USING (query_id)""")
def evidence_valid(spark, d):
    """The first twelve passages as evidence, made wrong for three questions in five: one id for all, an id without its zero, a chunk that isn't ranked."""
    ranked = files.written(ranked_passages(spark, d))
    k, first = F.expr("query_id DIV 50 % 5"), F.col("final_position") == 1
    name = F.when(k == 1, "source_01").when((k == 2) & first, "source_1").otherwise(cx.source_id(F.col("final_position")))
    evidence = ranked.filter("final_position <= 12").select("query_id", name.alias("source_id"), F.when((k == 3) & first, -1).otherwise(F.col("chunk_id")).alias("chunk_id"), "document_id")
    return cx.evidence_ids_valid(evidence, ranked, rt.evidence_gate(v.kb_questions(spark, d), ranked))


@query("ev_21_source_preview", r"""t AS (SELECT chunk_id, document_id, filename, page, chunk_index / 7 AS score, replace(regexp_replace(content, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS t FROM kb_chunks)
;; SELECT chunk_id, document_id, filename, page, round(score, 4) AS relevance_score, CASE WHEN length(t) > 320 THEN substr(t, 1, 320) || '...'
    ELSE t END AS snippet FROM t""")
def previews(spark, d):
    c = v.kb_chunks(spark, d)
    return c.select("chunk_id", "document_id", "filename", "page", F.round(F.col("chunk_index") / 7, 4).alias("relevance_score"), tx.preview("content").alias("snippet"))
