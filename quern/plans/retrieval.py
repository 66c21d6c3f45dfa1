"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import vectors as vx
from quern.operators import ann
from quern.operators import lexical as lx
from quern.operators import retrieval as rt
from quern.plans.registry import query
from quern.sources import views as v
from quern.sources.files import new_folder

#: Words of the topics that messages are held against; any lists will do.
TOPICS = [["price", "cost", "pay"], ["the", "and", "of"], ["time", "day", "week"], ["in", "on", "at"]]

_stop = lambda words: "[" + ",".join(f"'{w}'" for w in words) + "]"


def _terms(col: str, keep: str, stop: list[str]) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({col}), '[^a-z0-9\\s{keep}]', ' ', 'g'), '\\s+'), lambda t: length(t) > 2 AND NOT list_contains({_stop(stop)}, t))"


CONTENT, TERMS = (lambda c: _terms(c, ".-", tx.CONTENT_STOP)), (lambda c: _terms(c, "-", tx.TERM_STOP))
SIM = """sim AS (SELECT query_id, chunk_id, document_id, round(list_cosine_similarity(embedding::DOUBLE[], query_embedding::DOUBLE[]), 6) AS similarity
    FROM kb_corpus, kb_questions),
  elig AS (SELECT * FROM sim WHERE similarity >= 0.25)"""
#: Passages that may be searched.
VISIBLE = """vis AS (SELECT * FROM kb_passages WHERE status = 'ready' AND chunk_version = version AND (filename NOT LIKE '%.pptx' OR parser_version >= 2))"""


def _capped(rows: str, of: str, score: str, out: str) -> str:
    """The CTE ``out``: of each question (columns ``of``) at most eight rows of a document where several documents have some, the first sixty."""
    return f"""{out}r AS (SELECT *, row_number() OVER (PARTITION BY {of}, document_id ORDER BY {score} DESC, chunk_id) AS dr FROM {rows}),
  {out}m AS (SELECT {of}, count(DISTINCT document_id) AS docs FROM {rows} GROUP BY ALL),
  {out} AS (SELECT *, row_number() OVER (PARTITION BY {of} ORDER BY {score} DESC, chunk_id) AS position FROM {out}r JOIN {out}m USING ({of}) WHERE dr <= CASE WHEN docs > 1 THEN 8 ELSE 60 END
    QUALIFY position <= 60)"""


def _variants_merged(rows: str, score: str, out: str) -> str:
    """The CTE ``out``: the variants' lists as one, each passage by its best score."""
    return f"""{out}b AS (SELECT query_id, chunk_id, any_value(document_id) AS document_id, max({score}) AS {score} FROM {rows} GROUP BY 1, 2),
  {out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, chunk_id) AS position FROM {out}b)"""


def _asked(questions: str, of: str) -> str:
    """CTEs of web-search questions: tok (tokens with their part; ``or`` between two tokens begins one), un (units: words, phrases, excluded ones) and need (words of a part)."""
    return f"""tk0 AS (SELECT {of}, regexp_extract_all(lower(question), '(-?"[^"]*"|[^\\s"]+)', 1) AS l FROM {questions}),
  tk1 AS (SELECT {of}, unnest(l) AS tok, generate_subscripts(l, 1) AS i, len(l) AS last FROM tk0),
  tk2 AS (SELECT *, i - row_number() OVER (PARTITION BY {of}, tok = 'or' ORDER BY i) AS island FROM tk1),
  tk3 AS (SELECT *, min(i) OVER (PARTITION BY {of}, tok = 'or', island) AS first FROM tk2),
  tk4 AS (SELECT *, tok = 'or' AND i < last AND (i - first) % 2 = CASE WHEN first = 1 THEN 1 ELSE 0 END AS cut FROM tk3),
  tok AS (SELECT *, sum(cut::INT) OVER (PARTITION BY {of} ORDER BY i ROWS UNBOUNDED PRECEDING) AS part, starts_with(tok, '-') AS negative, contains(tok, '"') AS quoted,
    list_filter(regexp_split_to_array(tok, '[^a-z0-9]+'), lambda x: x <> '') AS w FROM tk4),
  un0 AS (SELECT DISTINCT {of}, part, negative, unnest(CASE WHEN negative OR quoted THEN [w] ELSE list_transform(w, lambda x: [x]) END) AS u FROM tok WHERE NOT cut AND len(w) > 0),
  un1 AS (SELECT *, sum(CASE WHEN negative THEN 0 ELSE len(u) END) OVER (PARTITION BY {of}, part) AS n FROM un0),
  un AS (SELECT *, row_number() OVER (PARTITION BY {of} ORDER BY part, negative, u) AS unit FROM un1 WHERE n > 0)"""


def _cover(questions: str, passages: str, of: str) -> str:
    """The CTE lexr: ranks by cover density of the passages that meet a part of the question. Of stretches with one end the latest counts."""
    return f"""post AS (SELECT chunk_id, document_id, unnest(w) AS term, generate_subscripts(w, 1) AS position
    FROM (SELECT chunk_id, document_id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {passages})),
  {_asked(questions, of)},
  ut AS (SELECT *, unnest(u) AS term, generate_subscripts(u, 1) - 1 AS place FROM un),
  df AS (SELECT DISTINCT chunk_id, term FROM post SEMI JOIN ut USING (term)),
  words AS (SELECT *, count(*) OVER (PARTITION BY {of}, part) AS k FROM (SELECT DISTINCT {of}, part, term FROM ut WHERE NOT negative)),
  holds AS (SELECT {of}, part, chunk_id FROM words JOIN df USING (term) GROUP BY {of}, part, chunk_id HAVING count(*) = any_value(k)),
  occ AS (SELECT {of}, part, unit, negative, n, chunk_id, document_id, len(u) AS size, position - place AS s FROM post JOIN ut USING (term) JOIN holds USING ({of}, part, chunk_id)
    GROUP BY {of}, part, unit, negative, n, chunk_id, document_id, len(u), position - place HAVING count(*) = len(u)),
  met AS (SELECT {of}, part, chunk_id FROM occ GROUP BY ALL HAVING NOT bool_or(negative)),
  units AS (SELECT {of}, part, count(*) AS units FROM un WHERE NOT negative GROUP BY ALL),
  whole AS (SELECT {of}, part, chunk_id, any_value(units) AS units FROM occ JOIN met USING ({of}, part, chunk_id) JOIN units USING ({of}, part) GROUP BY ALL HAVING count(DISTINCT unit) = any_value(units)),
  hits AS (SELECT {of}, part, unit, n, units, chunk_id, document_id, s, s + size - 1 AS e FROM occ JOIN whole USING ({of}, part, chunk_id)),
  ends AS (SELECT {of}, chunk_id, document_id, part, h.unit, h.n, h.units, h.e, h.s AS own, g.unit AS other, max(g.s) AS lasts FROM hits h JOIN hits g USING ({of}, chunk_id, document_id, part)
    WHERE g.e < h.e OR g.e = h.e AND (g.s < h.s OR g.s = h.s AND g.unit <= h.unit) GROUP BY ALL),
  st AS (SELECT {of}, chunk_id, document_id, e, own, unit, n, min(lasts) AS s FROM ends GROUP BY {of}, chunk_id, document_id, part, unit, n, units, e, own HAVING count(*) = units),
  latest AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY {of}, chunk_id ORDER BY e, s DESC, own, unit) = 1 OR e <> lag(e) OVER (PARTITION BY {of}, chunk_id ORDER BY e, s DESC, own, unit)),
  cov AS (SELECT *, coalesce(max(s) OVER (PARTITION BY {of}, chunk_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM latest),
  lexr AS (SELECT {of}, chunk_id, document_id, round(sum(0.1::DOUBLE / (1 + greatest(e - s + 1 - n, 0))), 6) AS lexical_rank FROM cov WHERE s > before GROUP BY ALL)"""


CAPPED = SIM + ", " + _capped("elig", "query_id", "similarity", "dense")
#: Of all variants, over the passages that may be searched.
DENSE = VISIBLE + """, simv AS (SELECT query_id, variant, chunk_id, document_id, round(list_cosine_similarity(embedding::DOUBLE[], query_embedding::DOUBLE[]), 6) AS similarity
    FROM vis JOIN embeddings ON vec_id = chunk_id, kb_variants WHERE query_embedding IS NOT NULL), eligv AS (SELECT * FROM simv WHERE similarity >= 0.25), """ + _capped("eligv", "query_id, variant", "similarity", "densev") + ", " + _variants_merged("densev", "similarity", "dense")
LEXICAL = _cover("kb_variants", "vis", "query_id, variant") + ", " + _capped("lexr", "query_id, variant", "lexical_rank", "lexicalv") + ", " + _variants_merged("lexicalv", "lexical_rank", "lexical")
POST = """post AS (SELECT chunk_id, document_id, unnest(w) AS term, generate_subscripts(w, 1) AS position
    FROM (SELECT chunk_id, document_id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM kb_passages))"""
COVER = _cover("kb_questions", "kb_passages", "query_id")
LISTS = DENSE + ", " + LEXICAL
FUSED = LISTS + """,
  f0 AS (SELECT query_id, chunk_id, d.position AS dense_position, d.similarity, l.position AS lexical_position, l.lexical_rank,
    round(coalesce(1.0::DOUBLE / (60 + d.position), 0) + coalesce(0.8::DOUBLE / (60 + l.position), 0), 8) AS fusion_score FROM dense d
    FULL JOIN lexical l USING (query_id, chunk_id)),
 fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, similarity DESC NULLS LAST, chunk_id) AS fused_position FROM f0) WHERE fused_position <= 32)"""
RANKED = FUSED + f""",
  tq AS (SELECT query_id, list_distinct({CONTENT('question')}) AS q FROM kb_questions),
  tc AS (SELECT chunk_id, document_id, list_distinct({CONTENT('content')}) AS c FROM kb_passages),
 rr AS (SELECT fused.*, document_id, round(0.6::DOUBLE * CASE WHEN len(q) = 0 THEN 0
    ELSE len(list_filter(q, lambda t: list_contains(c, t)))::DOUBLE / len(q) END + 0.4::DOUBLE * coalesce(similarity, 0), 4) AS rerank_score
    FROM fused JOIN tq USING (query_id) JOIN tc USING (chunk_id)),
 ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fusion_score DESC, chunk_id) AS final_position FROM rr) WHERE final_position <= 32)"""
GATE = """seen AS (SELECT query_id, count(*) AS n, count(*) FILTER (rerank_score >= 0.30) AS supporting_chunks,
    count(DISTINCT document_id) FILTER (rerank_score >= 0.30) AS distinct_documents, max(similarity) AS best_similarity, max(rerank_score) AS best_rerank_score FROM ranked GROUP BY 1),
 verdict AS (SELECT q.query_id, CASE WHEN n IS NULL THEN 'no_candidates' WHEN best_rerank_score < 0.35 OR best_similarity < 0.30 THEN 'weak_top_score'
    WHEN supporting_chunks < 1 THEN 'insufficient_support' ELSE 'ok' END AS reason, coalesce(supporting_chunks, 0) AS supporting_chunks, coalesce(distinct_documents, 0) AS distinct_documents, best_similarity, best_rerank_score FROM kb_questions q LEFT JOIN seen USING (query_id))"""


def ranked_passages(spark, d):
    """The flagship's ranked passages, by plain words: dense search over the vectors, full-text search over all documents, with the questions' variants."""
    return rt.retrieve(v.kb_variants(spark, d), v.kb_corpus(spark, d), v.kb_passages(spark, d), english=False)


def _lists(spark, d):
    """The dense and the lexical list that are fused."""
    q = v.kb_variants(spark, d)
    return rt.dense_lists(q, rt.visible(v.kb_corpus(spark, d))), rt.lexical_topk(q, rt.visible(v.kb_passages(spark, d)), english=False)


@query("ret_01_dense_topk", SIM + """
;; SELECT query_id, chunk_id, similarity, position FROM (SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS position FROM elig) WHERE position <= 20""")
def dense(spark, d):
    return rt.dense_topk(v.kb_questions(spark, d), v.kb_corpus(spark, d).select("chunk_id", "embedding"), 20).select("query_id", "chunk_id", "similarity", "position")


@query("ret_02_ann_topk")
def ann_topk(spark, d):
    """From a written index; these vectors have no near neighbours, so a question asks cells that hold most of them."""
    return ann.search(v.kb_questions(spark, d), ann.write_index(v.kb_corpus(spark, d), new_folder(spark, "vectors")), 10, share=0.8)


@query("ret_03_merge_variants", SIM + """,
  vr AS (SELECT query_id % 100 AS query_id, chunk_id, max(similarity) AS similarity FROM elig GROUP BY ALL)
;; SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS position FROM vr) WHERE position <= 60""")
def variants(spark, d):
    """Questions whose ids agree modulo 100 are taken as variants of one."""
    found = rt.similarities(v.kb_questions(spark, d), v.kb_corpus(spark, d).select("chunk_id", "embedding"), best=rt.POOL)
    return rt.merge_variants(found.withColumn("query_id", F.expr("query_id % 100")))


@query("ret_04_per_document_cap", CAPPED + ";; SELECT query_id, chunk_id, document_id, similarity, position FROM dense")
def capped(spark, d):
    corpus = v.kb_corpus(spark, d).select("chunk_id", "document_id", "embedding")
    return rt.per_document_cap(rt.similarities(v.kb_questions(spark, d), corpus, best=rt.POOL, cap=rt.PER_DOCUMENT)).select("query_id", "chunk_id", "document_id", "similarity", "position")


@query("ret_05_lexical_match", POST + """,
  q AS (SELECT query_id, list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM kb_questions),
  q1 AS (SELECT query_id, w[1] AS a, w[2] AS b, w[3] AS c, w[4] AS e, w[5] AS x FROM q WHERE len(w) >= 5),
 t AS (SELECT DISTINCT chunk_id, document_id, term FROM post),
  ph AS (SELECT DISTINCT q1.query_id, p.chunk_id FROM q1 JOIN post p ON p.term = c JOIN post r ON r.chunk_id = p.chunk_id AND r.term = e
    AND r.position = p.position + 1)

;; SELECT q1.query_id, t.chunk_id, t.document_id FROM q1 JOIN t ON t.term = b JOIN ph ON ph.query_id = q1.query_id
    AND ph.chunk_id = t.chunk_id WHERE NOT EXISTS (SELECT 1 FROM t n WHERE n.chunk_id = t.chunk_id AND n.term = x || 'zz') UNION SELECT q1.query_id, t.chunk_id, t.document_id FROM q1 JOIN t ON t.term = a""")
def matched(spark, d):
    """Asks: the first word, or the second with the phrase of the third and fourth and without the fifth (spelt wrong)."""
    w = F.filter(F.split(F.lower("question"), "[^a-z0-9]+"), lambda x: x != "")
    q = v.kb_questions(spark, d).withColumn("w", w).filter("size(w) >= 5").selectExpr("query_id", "concat(w[0], ' or ', w[1], ' \"', w[2], ' ', w[3], '\" -', w[4], 'zz') AS question")
    return rt.lexical_match(q, v.kb_passages(spark, d))


@query("ret_06_cover_density", COVER + ";; SELECT query_id, chunk_id, document_id, lexical_rank FROM lexr")
def cover(spark, d):
    return rt.cover_density(v.kb_questions(spark, d), v.kb_passages(spark, d))


@query("ret_06_cover_density_indexed", COVER + ";; SELECT query_id, chunk_id, document_id, lexical_rank FROM lexr")
def cover_indexed(spark, d):
    """The same from a written index of postings."""
    index = lx.write_index(v.kb_passages(spark, d), new_folder(spark, "postings"))
    return rt.cover_density(v.kb_questions(spark, d), index)


@query("ret_07_lexical_topk", VISIBLE + ", " + LEXICAL + ";; SELECT query_id, chunk_id, document_id, lexical_rank, position FROM lexical")
def lexical(spark, d):
    return rt.lexical_topk(v.kb_variants(spark, d), rt.visible(v.kb_passages(spark, d)), english=False)


@query("ret_07_lexical_topk_indexed", VISIBLE + ", " + LEXICAL + ";; SELECT query_id, chunk_id, document_id, lexical_rank, position FROM lexical")
def lexical_indexed(spark, d):
    """The same from a written index of all passages' postings, of which those that may be searched are found."""
    passages = v.kb_passages(spark, d)
    return rt.lexical_topk(v.kb_variants(spark, d), lx.write_index(passages, new_folder(spark, "postings")), english=False, within=rt.visible(passages))


@query("ret_07_lexical_topk_english")
def lexical_english(spark, d):
    return rt.lexical_topk(v.kb_variants(spark, d), rt.visible(v.kb_passages(spark, d)))


@query("ret_05_lexical_match_english")
def matched_english(spark, d):
    """Whole questions of eight words in web-search form, by their stems."""
    q = v.kb_questions(spark, d).selectExpr("query_id", "array_join(slice(split(question, ' '), 1, 8), ' ') AS question")
    return rt.lexical_match(q, v.kb_passages(spark, d), english=True)


@query("ret_06_cover_density_english")
def cover_english(spark, d):
    return rt.cover_density(v.kb_questions(spark, d), v.kb_passages(spark, d), english=True)


@query("ret_08_overlap_score", f"""t AS (SELECT a.document_id, a.chunk_index, {TERMS('a.content')} AS q, {TERMS('b.content')} AS c FROM kb_chunks a
    JOIN kb_chunks b ON b.document_id = a.document_id AND b.chunk_index = a.chunk_index + 1)
;; SELECT document_id, chunk_index, round(CASE WHEN len(q) = 0 THEN 0
    ELSE len(list_filter(q, lambda t: list_contains(c, t)))::DOUBLE / len(q) END, 6) AS score FROM t""")
def overlap(spark, d):
    """Each chunk is the question, and the next chunk of its document the content."""
    c = v.kb_chunks(spark, d).select("document_id", "chunk_index", "content")
    after = c.select("document_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("content").alias("next"))
    return c.join(after, ["document_id", "chunk_index"]).select("document_id", "chunk_index", F.round(tx.overlap_score("content", "next"), 6).alias("score"))


@query("ret_09_topic_vector", "t AS (SELECT thread_id, turn, [" + ", ".join(" + ".join(f"contains(lower(text), '{w}')::INT" for w in ws) for ws in TOPICS) + """]::DOUBLE[] AS t FROM kb_messages)
;; SELECT thread_id, turn, round(t[1] / greatest(sqrt(list_sum(list_transform(t, lambda x: x * x))), 1e-12), 6) AS t1,
    round(t[3] / greatest(sqrt(list_sum(list_transform(t, lambda x: x * x))), 1e-12), 6) AS t3 FROM t""")
def topics(spark, d):
    t = v.kb_messages(spark, d).withColumn("t", vx.topic_vector(F.col("text"), TOPICS))
    return t.select("thread_id", "turn", F.round(F.col("t")[0], 6).alias("t1"), F.round(F.col("t")[2], 6).alias("t3"))


@query("ret_10_cosine", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a
    JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosines(spark, d):
    e = v.kb_vectors(spark, d)
    b = e.selectExpr("vec_id AS b", "vec_id - 1 AS a", "embedding AS eb")
    return e.selectExpr("vec_id AS a", "embedding AS ea").join(b, "a").select("a", "b", F.round(vx.cosine(F.col("ea"), F.col("eb")), 6).alias("cosine"))


@query("ret_11_rrf_fuse", FUSED + ";; SELECT query_id, chunk_id, dense_position, lexical_position, similarity, lexical_rank, fusion_score, fused_position FROM fused")
def fuse(spark, d):
    dense, lexical = _lists(spark, d)
    return rt.rrf_fuse(dense, lexical).select("query_id", "chunk_id", "dense_position", "lexical_position", "similarity", "lexical_rank", "fusion_score", "fused_position")


@query("ret_12_heuristic_rerank", RANKED + ";; SELECT query_id, chunk_id, document_id, fusion_score, rerank_score, final_position FROM ranked")
def rerank(spark, d):
    return ranked_passages(spark, d).select("query_id", "chunk_id", "document_id", "fusion_score", "rerank_score", "final_position")


_CLAMP = lambda x: f"least(1, greatest(0, CASE WHEN {x} > 1 THEN {x} / 10 ELSE {x} END))"


@query("ret_13_parse_listwise_scores", f"""e AS (SELECT event_id AS query_id, event_id % 6 AS kind, latency_ms AS x FROM kb_events),
  s AS (SELECT query_id, CASE kind WHEN 0 THEN [0.5, {_CLAMP('x')}, 0] WHEN 1 THEN [{_CLAMP('x')}, 0.25, 0] WHEN 2 THEN NULL
    WHEN 3 THEN [1, 0.7, {_CLAMP('x')}] WHEN 4 THEN NULL ELSE [0.1, 0.3, 0] END AS scores FROM e)

;; SELECT query_id, k - 1 AS target, round(scores[k], 6) AS score FROM (SELECT query_id, scores, unnest([1, 2, 3]) AS k FROM s
    WHERE scores IS NOT NULL)""")
def listwise(spark, d):
    """Stored replies about three passages, made of the events' attributes: objects, bare lists, a mixture, none that can be used."""
    e = v.kb_events(spark, d).selectExpr("event_id AS query_id", """CASE event_id % 6
      WHEN 0 THEN concat('Here: {"scores":[{"index":1,"score":', latency_ms, '},{"index":0,"score":0.5},{"index":7,"score":0.9}]} done')
      WHEN 1 THEN concat('```json\n[', latency_ms, ', 0.25]\n```') WHEN 2 THEN 'no json' WHEN 3 THEN concat('[{"index":1,"score":"0.7"}, "none", {"score":', latency_ms, ', "index":2}, {"index":0,"score":1}]')
      WHEN 4 THEN '{"scores":[{"index":5,"score":1},{"index":0}]}' ELSE '{"scores":[{"index":1,"score":0.9},{"score":0.3},{"index":0,"score":0.1},{"score":2}]}' END AS reply""")
    return parse_listwise_scores(e, 3)


def parse_listwise_scores(replies, n: int):
    """(query_id, target, score) for every target below ``n`` of the stored reranker replies that have a usable entry.

    The first JSON block counts, an object's ``scores`` or a list. An entry has a score and an index, or is a number;
    without an index it is for the target that comes after as many entries as were usable before. A later entry for a target wins.
    Scores over 1 are divided by ten and held within 0 and 1; targets without an entry have 0.
    """
    block = F.regexp_extract("reply", r"(?s)(\{.*\}|\[.*\])", 1)
    entries = F.from_json(F.when(F.startswith(block, F.lit("{")), F.get_json_object(block, "$.scores")).otherwise(block), "array<string>")
    number = lambda x: F.when(F.abs(x.try_cast("double")) < float("inf"), x.try_cast("double"))

    def parsed(entry):
        place = number(F.get_json_object(entry, "$.index"))
        return F.struct(F.coalesce(number(F.get_json_object(entry, "$.score")), number(entry)).alias("score"), place.isNotNull().alias("placed"), F.coalesce(place, F.lit(-1)).cast("int").alias("index"))

    def take(state, entry):
        target = F.when(entry["placed"], entry["index"]).otherwise(state["seen"])
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(entry["score"] > 1, entry["score"] / 10).otherwise(entry["score"])))
        scores = F.transform(state["scores"], lambda s, i: F.when(i == target, score).otherwise(s))
        usable = entry["score"].isNotNull() & target.between(0, n - 1)
        return F.when(usable, F.struct((state["seen"] + 1).alias("seen"), scores.alias("scores"))).otherwise(state)

    start = F.struct(F.lit(0).alias("seen"), F.array_repeat(F.lit(0.0), n).alias("scores"))
    state = F.aggregate(F.transform(F.coalesce(entries, F.array().cast("array<string>")), parsed), start, take)
    return replies.select("query_id", state.alias("state")).filter("state.seen > 0").select("query_id", F.posexplode("state.scores").alias("target", "score")).withColumn("score", F.round("score", 6))


@query("ret_14_needs_expansion", f"""t AS (SELECT query_id, len({CONTENT('question')}) AS n, question FROM kb_questions)
;; SELECT query_id, n <= 6 OR (n <= 9 AND regexp_matches(question, '(?i)\\b(this|that|these|those|it)\\b')) AS expand FROM t""")
def expansion(spark, d):
    n = F.size(tx.content_terms("question"))
    return v.kb_questions(spark, d).select("query_id", ((n <= 6) | (F.rlike("question", F.lit(r"(?i)\b(this|that|these|those|it)\b")) & (n <= 9))).alias("expand"))


@query("ret_15_sanitize_variants", """m AS (SELECT thread_id, turn, trim(substr(trim(text), 1, 200)) AS t FROM kb_messages WHERE role = 'user' AND length(trim(text)) >= 3),
  f AS (SELECT thread_id, turn, t, row_number() OVER (PARTITION BY thread_id, lower(t) ORDER BY turn) AS r FROM m)
;; SELECT thread_id, t AS variant, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn) AS k FROM f WHERE r = 1)
    WHERE k <= 3""")
def sanitized(spark, d):
    """A thread's user turns are taken as its question (the first) and variants."""
    m = v.kb_messages(spark, d).filter("role = 'user'").select("thread_id", "turn", F.trim(F.substring(F.trim("text"), 1, 200)).alias("variant")).filter("length(variant) >= 3")
    first = m.withColumn("r", F.row_number().over(Window.partitionBy("thread_id", F.lower("variant")).orderBy("turn"))).filter("r = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("thread_id").orderBy("turn"))).filter("place <= 3").select("thread_id", "variant", "place")


@query("ret_16_embed_guard", "SELECT vec_id, len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS fits FROM embeddings")
def guard(spark, d):
    return v.kb_vectors(spark, d).select("vec_id", vx.fits(F.col("embedding"), 64).alias("fits"))


@query("ret_16_embed_batches")
def embedded(spark, d):
    from quern.operators.embed import embed_batches

    return embed_batches(v.kb_chunks(spark, d).select("chunk_id", "content"), "content").select("chunk_id", F.size("embedding").alias("dim"), F.round(vx.norm(F.col("embedding")), 4).alias("norm"))


@query("ret_17_retrieve", RANKED + ", " + GATE + ";; SELECT r.query_id, chunk_id, final_position, rerank_score, v.reason FROM ranked r JOIN verdict v USING (query_id)")
def flagship(spark, d):
    return rt.with_reason(ranked_passages(spark, d)).select("query_id", "chunk_id", "final_position", "rerank_score", "reason")


@query("ret_17_retrieve_english")
def flagship_english(spark, d):
    """The flagship as it is asked: by English stems, with stop words left out, from a written index."""
    passages = v.kb_passages(spark, d)
    index = lx.write_index(rt.visible(passages), new_folder(spark, "postings"), english=True)
    ranked = rt.retrieve(v.kb_variants(spark, d), v.kb_corpus(spark, d), passages, index=index)
    return rt.with_reason(ranked).select("query_id", "chunk_id", "final_position", "rerank_score", "reason")


@query("ret_18_retrieval_telemetry", RANKED + """
;; SELECT query_id, count(*) AS final_evidence, count(dense_position) AS dense_hits,
    count(lexical_position) AS lexical_hits, max(similarity) AS best_similarity, max(rerank_score) AS best_rerank FROM ranked GROUP BY 1""")
def telemetry(spark, d):
    return ranked_passages(spark, d).groupBy("query_id").agg(F.count("*").alias("final_evidence"), F.count("dense_position").alias("dense_hits"), F.count("lexical_position").alias("lexical_hits"), F.max("similarity").alias("best_similarity"), F.max("rerank_score").alias("best_rerank"))


@query("ret_19_filtered_vector_search", """sim AS (SELECT query_id, chunk_id, document_id, round(list_cosine_similarity(embedding::DOUBLE[], query_embedding::DOUBLE[]), 6) AS similarity
    FROM kb_corpus, kb_questions WHERE document_id % 2 = 0)
;; SELECT query_id, chunk_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM sim)
    WHERE r <= 5""")
def scoped(spark, d):
    c = v.kb_corpus(spark, d).select("chunk_id", "document_id", "embedding")
    scope = c.select("document_id").distinct().filter("document_id % 2 = 0")
    return rt.top(rt.similarities(v.kb_questions(spark, d), c.join(scope, "document_id", "left_semi"), -1.0, 5), "similarity", 5).select("query_id", "chunk_id", "similarity")


@query("ev_01_evidence_gate", RANKED + ", " + GATE + ";; SELECT query_id, reason = 'ok' AS grounded, reason, supporting_chunks, distinct_documents, best_similarity, best_rerank_score FROM verdict")
def gate(spark, d):
    return rt.evidence_gate(v.kb_questions(spark, d), ranked_passages(spark, d))


@query("jn_03_dense_lexical_merge", LISTS + """
;; SELECT query_id, chunk_id, coalesce(d.document_id, l.document_id) AS document_id, d.position AS dense_position, l.position AS lexical_position
    FROM dense d FULL JOIN lexical l USING (query_id, chunk_id)""")
def merged(spark, d):
    dense, lexical = _lists(spark, d)
    a = dense.select("query_id", "chunk_id", F.col("document_id").alias("da"), F.col("position").alias("dense_position"))
    b = lexical.select("query_id", "chunk_id", F.col("document_id").alias("db"), F.col("position").alias("lexical_position"))
    return a.join(b, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", F.coalesce("da", "db").alias("document_id"), "dense_position", "lexical_position")


@query("set_01_list_union", LISTS + """,
  u AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + position) AS c FROM dense
  UNION ALL SELECT query_id, chunk_id, 0.8::DOUBLE / (60 + position) FROM lexical)
;; SELECT query_id, chunk_id, round(sum(c), 8) AS fusion_score, count(*) AS lists FROM u GROUP BY 1, 2""")
def union(spark, d):
    dense, lexical = _lists(spark, d)
    part = lambda df, w: df.select("query_id", "chunk_id", (F.lit(w) / (60 + F.col("position"))).alias("c"))
    both = part(dense, 1.0).unionByName(part(lexical, 0.8))
    return both.groupBy("query_id", "chunk_id").agg(F.round(F.sum("c"), 8).alias("fusion_score"), F.count("*").alias("lists"))


@query("win_09_rank_shift", RANKED + ";; SELECT query_id, chunk_id, least(dense_position, lexical_position) - final_position AS shift FROM ranked")
def shift(spark, d):
    return ranked_passages(spark, d).select("query_id", "chunk_id", (F.least("dense_position", "lexical_position") - F.col("final_position")).alias("shift"))
