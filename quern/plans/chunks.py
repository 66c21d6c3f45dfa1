"""Queries of corpus preparation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quern.functions import policy as po
from quern.functions import text as tx
from quern.operators import chunking as ch
from quern.operators import rollups as ro
from quern.plans.registry import query
from quern.sources import views as v


def _pages(spark, d):
    """Pages of markdown, made of the documents' lines: every fifth line a heading, fenced stretches, rows of a table."""
    docs = v.kb_documents(spark, d).select("document_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    marked = docs.selectExpr("document_id", "i", "CASE i % 10 WHEN 0 THEN concat(repeat('#', CAST((document_id + i DIV 10) % 3 + 1 AS INT)), ' ', substring(t, 1, 20), ' #') WHEN 3 THEN '```' WHEN 5 THEN '```' WHEN 7 THEN '| a | b |' WHEN 8 THEN '|---|:-:|' ELSE t END AS t")
    g = marked.groupBy("document_id", (F.expr("CAST(i DIV 10 + 1 AS INT)")).alias("page")).agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("x"))
    return g.select("document_id", "page", F.array_join(F.transform("x", lambda e: e["t"]), "\n").alias("text"))


PAGES = """dl AS (SELECT document_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM kb_documents),
  pl0 AS (SELECT document_id, i // 10 + 1 AS page, i % 10 AS line, CASE i % 10
    WHEN 0 THEN repeat('#', (document_id + i // 10) % 3 + 1) || ' ' || substr(t, 1, 20) || ' #' WHEN 3 THEN '```' WHEN 5 THEN '```'
    WHEN 7 THEN '| a | b |' WHEN 8 THEN '|---|:-:|' ELSE t END AS text FROM dl),
  pl AS (SELECT document_id, page, line, replace(text, chr(13), '') AS text FROM pl0)"""
KIND = rf"""pk AS (SELECT *, regexp_matches(text, '{ch.FENCE}') AS fence FROM pl),
  pc AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY document_id, page ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS before FROM pk),
 kinds AS (SELECT document_id, page, line, text, CASE WHEN fence THEN 'fence' WHEN before % 2 = 1 THEN 'code'
    WHEN regexp_matches(text, '{ch.HEADING}') THEN 'heading' WHEN regexp_matches(text, '{ch.SEPARATOR}') THEN 'table-separator'
    WHEN regexp_matches(text, '{ch.ROW}') THEN 'table-row' ELSE 'text' END AS kind FROM pc)"""


@query("chk_01_page_lines", PAGES + ";; SELECT document_id, page, line, text FROM pl")
def lines(spark, d):
    return ch.page_lines(_pages(spark, d))


@query("chk_02_classify_lines", PAGES + ", " + KIND + ";; SELECT document_id, page, line, kind FROM kinds")
def kinds(spark, d):
    return ch.classify_lines(ch.page_lines(_pages(spark, d))).select("document_id", "page", "line", "kind")


HEAD = rf"""hd AS (SELECT document_id, page, line, length(regexp_extract(text, '{ch.HEADING}', 1)) AS level, trim(regexp_replace(regexp_extract(text, '{ch.HEADING}', 2), '\s*#+\s*$', '')) AS title FROM kinds WHERE kind = 'heading')"""


@query("chk_03_parse_heading", PAGES + ", " + KIND + ", " + HEAD + ";; SELECT document_id, page, line, level, title FROM hd")
def headings(spark, d):
    level, title = ch.parse_heading(F.col("text"))
    return ch.classify_lines(ch.page_lines(_pages(spark, d))).filter("kind = 'heading'").select("document_id", "page", "line", level.alias("level"), title.alias("title"))


@query("chk_04_breadcrumbs", PAGES + ", " + KIND + ", " + HEAD + """,
  o AS (SELECT document_id, page * 100 + line AS at, level, title FROM hd),
  nx AS (SELECT *, (SELECT min(b.at) FROM o b WHERE b.document_id = o.document_id AND b.at > o.at AND b.level <= o.level) AS ends FROM o),
  t AS (SELECT document_id, page * 100 + line AS at FROM kinds WHERE kind = 'text')

;; SELECT t.document_id, t.at, coalesce(string_agg(n.title, ' > ' ORDER BY n.level), '') AS path FROM t
    LEFT JOIN nx n ON n.document_id = t.document_id AND n.at <= t.at AND (n.ends IS NULL OR n.ends > t.at) GROUP BY 1, 2""")
def crumbs(spark, d):
    return ch.breadcrumbs(ch.classify_lines(ch.page_lines(_pages(spark, d)))).filter("kind = 'text'").select("document_id", (F.col("page") * 100 + F.col("line")).alias("at"), "path")


@query("chk_06_recursive_split")
def split(spark, d):
    return ch.split_documents(v.kb_documents(spark, d)).select("document_id", "chunk_index", F.length("content").alias("n_chars"))


@query("chk_08_chunk_documents")
def chunked(spark, d):
    return ch.chunk_documents(_pages(spark, d))


@query("chk_09_window_chunks", """SELECT doc_id, i AS chunk_index, substr(text, i * 800 + 1, 1000) AS content
    FROM (SELECT *, unnest(range(0, greatest(length(text) - 1, 0) // 800 + 1)) AS i FROM documents WHERE length(text) > 0)""")
def windows(spark, d):
    return ch.window_chunks(v.read(spark, d, "documents"), "doc_id", "text", 1000, 200)


@query("chk_10_chunk_uuid", """h AS (SELECT chunk_id, sha256(document_id || ':v' || version || ':' || chunk_index) AS h FROM kb_chunks)
;; SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8','9','a','b'])[1 + (strpos('0123456789abcdef', h[17]) - 1) % 4] || h[18:20] || '-' || h[21:32] AS uuid FROM h""")
def uuids(spark, d):
    return v.kb_chunks(spark, d).select("chunk_id", po.chunk_uuid(F.col("document_id"), F.col("version"), F.col("chunk_index")).alias("uuid"))


@query("chk_11_chunk_rows", "SELECT chunk_id, ceil(length(content) / 4)::BIGINT AS token_estimate, chunk_version, coalesce(model, 'none') AS model FROM kb_chunks")
def chunk_rows(spark, d):
    return v.kb_chunks(spark, d).select("chunk_id", tx.estimate_tokens("content").alias("token_estimate"), "chunk_version", F.coalesce("model", F.lit("none")).alias("model"))


@query("chk_12_document_chunk_stats", "SELECT document_id, count(*) AS chunks, max(page) AS pages, sum(length(content))::BIGINT AS chars FROM kb_chunks GROUP BY 1")
def stats(spark, d):
    return v.kb_chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("chunks"), F.max("page").alias("pages"), F.sum(F.length("content")).alias("chars"))


@query("chk_13_replace_document", """nw AS (SELECT document_id, chunk_index, 'v2 ' || content AS content FROM kb_chunks WHERE document_id % 4 = 0 AND chunk_index < 2),
  od AS (SELECT document_id, chunk_index, content FROM kb_chunks WHERE document_id % 4 <> 0)
;; SELECT * FROM nw
  UNION ALL SELECT * FROM od""")
def replaced(spark, d):
    """Documents chunked anew lose all their old chunks, those past the new end too."""
    c = v.kb_chunks(spark, d).select("document_id", "chunk_index", "content")
    new = c.filter("document_id % 4 = 0 AND chunk_index < 2").withColumn("content", F.concat(F.lit("v2 "), "content"))
    return ro.upsert(c, new, ["document_id"])


HEADER = "'| text |' || chr(10) || '|---|'"
FILL = f"""WITH RECURSIVE d AS (SELECT document_id, list_transform(string_split(text, chr(10)), lambda t: '| ' || t || ' |') AS w
    FROM ({v.SQL['kb_documents']})),
  t AS (SELECT document_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
 r AS (SELECT document_id, 0::BIGINT AS i, 0 AS piece, -1::BIGINT AS room FROM d UNION ALL
 SELECT r.document_id, t.i, CASE WHEN t.i = 1 THEN 0 WHEN length(t.x) + 1 <= room THEN piece ELSE piece + 1 END, CASE WHEN t.i > 1
    AND length(t.x) + 1 <= room THEN room ELSE 500 - 14 END - length(t.x) - 1 FROM r JOIN t ON t.document_id = r.document_id AND t.i = r.i + 1),
 n AS (SELECT document_id, sum(length(x) + 1) + 14 AS n FROM t GROUP BY 1)
SELECT r.document_id, CASE WHEN n <= 500 THEN 0 ELSE piece END AS i, {HEADER} || chr(10) || string_agg(x, chr(10) ORDER BY r.i) AS chunk FROM r
    JOIN t USING (document_id, i) JOIN n USING (document_id) GROUP BY r.document_id, 2"""


@query("chk_05_split_table", FILL)
def tables(spark, d):
    """Tables with a document's lines as rows, split by whole rows."""
    rows = v.kb_documents(spark, d).select("document_id", F.transform(F.split("text", "\n"), lambda t: F.concat(F.lit("| "), t, F.lit(" |"))).alias("rows"))

    @F.pandas_udf("array<string>")
    def cut(r: pd.Series) -> pd.Series:
        return r.map(lambda x: ch.split_table(["| text |", "|---|", *x], 500))

    return rows.select("document_id", F.posexplode(cut("rows")).alias("i", "chunk"))


#: Places behind white space in the last 320 characters, rated by kind and distance.
BOUNDARY = r"""c AS (SELECT chunk_id, content, right(content, 320) AS tail FROM kb_chunks),
  w AS (SELECT chunk_id, tail, regexp_extract_all(tail, '\s+|\S+') AS w FROM c),
  k AS (SELECT chunk_id, length(tail) AS n, w, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
 p AS (SELECT *, sum(length(x)) OVER (PARTITION BY chunk_id ORDER BY i) AS e, lag(x) OVER (PARTITION BY chunk_id ORDER BY i) AS before FROM k),
 q AS (SELECT chunk_id, n, e, x, before FROM p WHERE regexp_matches(x, '^\s') AND i < len(w)),
 f AS (SELECT chunk_id, 0 AS kind, n - e AS far, n - e AS cost FROM q WHERE right(before, 1) IN ('.', '!', '?') AND n - e BETWEEN 80 AND 320
 
  UNION ALL SELECT chunk_id, 1, z, z FROM (SELECT chunk_id, n - e + length(list_last(string_split(x, chr(10)))) AS z FROM q
    WHERE contains(x, chr(10))) WHERE z BETWEEN 80 AND 320
 
  UNION ALL SELECT chunk_id, 2, n - e, abs(n - e - least(200, n)) FROM q WHERE n - e BETWEEN 1 AND 320),
 b AS (SELECT chunk_id, arg_min(far, kind * 1000000 + cost * 1000 - far) AS far FROM f GROUP BY 1)"""


@query("chk_07_boundary_overlap", BOUNDARY + r"""
;; SELECT chunk_id, CASE WHEN length(content) <= 10 THEN '' ELSE regexp_replace(right(content, coalesce(far, 200)::BIGINT), '^\s+|\s+$', '', 'g') END AS overlap FROM c LEFT JOIN b USING (chunk_id)""")
def boundary(spark, d):
    @F.pandas_udf("string")
    def tail(t: pd.Series) -> pd.Series:
        return t.map(lambda x: ch.boundary_overlap(x or "", 200))

    return v.kb_chunks(spark, d).select("chunk_id", tail("content").alias("overlap"))
